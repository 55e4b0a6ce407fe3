"""A pull reader of markup: elements, schema components, inline bodies and what is wrong, with byte spans.

One pass over the bytes of a text gives events: start and end tags with their attributes,
text, CDATA, comments, and problems.  A stack of open elements carries what depends on
what is around: depth, parent, namespaces, the named component that owns another, so
none of it has a bound on nesting.  References to characters and entities are decoded, in
attribute values and in bodies.  No text makes a job fail: what is malformed is a row of
`problems` with its span, and reading goes on behind it.

As XML, names keep their meaning by case (they are given in lower case, as written
besides), and every element is closed.  As HTML, a tag's name has no case, void elements
hold nothing, an end tag closes what is open inside, attributes may be bare, and
script, style, textarea and title hold text up to their own end tag.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements that hold nothing, and elements that hold text alone
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title"}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
DECODED_RAW = {"textarea", "title"}

_NAME = re.compile(rb"[A-Za-z_:\x80-\xff][^\s/>=\"'<]*")
_ATTRIBUTE = re.compile(rb"\s*([^\s=/>\"'<]+)(\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'=<`]+)|()))?")
_REFERENCE = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);?")
_SPACE = re.compile(rb"\s*")


@dataclass
class Event:
    """kind: start, end, text, cdata, comment, instruction, doctype or problem; its bytes are data[begin:end]."""

    kind: str
    begin: int
    end: int
    name: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    empty: bool = False


def decode_reference(match: re.Match, html: bool) -> str | None:
    """The text of a reference, or None if it is none."""
    body = match[1]
    if body.startswith("#"):
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(code) if match[0].endswith(";") and 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    if html:
        text = _html.unescape(match[0])
        return text if text != match[0] else None
    return ENTITIES.get(body) if match[0].endswith(";") else None


def decoded(text: str, html: bool, problem: Callable[[str, int, int], None] | None = None, at: int = 0) -> str:
    """Text with its references decoded; what is no reference stays as it is and is told as a problem."""
    if "&" not in text:
        return text
    out, last = [], 0
    for m in _REFERENCE.finditer(text):
        value = decode_reference(m, html)
        if value is None:
            if problem:
                begin = at + len(text[: m.start()].encode())
                problem("unknown_reference", begin, begin + len(m[0].encode()))
            continue
        out += [text[last : m.start()], value]
        last = m.end()
    return "".join([*out, text[last:]])


def events(data: bytes, html: bool = False) -> Iterator[Event]:
    """The events of a text in order; each byte belongs to one event at most, problems lie beside them."""
    at, size, raw = 0, len(data), None
    told: list[Event] = []
    problem = lambda name, begin, end: told.append(Event("problem", begin, end, name))
    while at < size:
        if raw:  # text up to the end tag of an element that holds text alone
            close = re.compile(rb"</" + re.escape(raw) + rb"(?=[\s/>])", re.I).search(data, at)
            stop = close.start() if close else size
            if stop > at:
                yield Event("text", at, stop)
            if not close:
                yield Event("problem", at, size, "unclosed_element")
            at, raw = stop, None
            continue
        sign = data.find(b"<", at)
        if sign < 0:
            yield Event("text", at, size)
            break
        if sign > at:
            yield Event("text", at, sign)
            at = sign
        if data.startswith(b"<!--", at) or data.startswith(b"<![CDATA[", at) or data.startswith(b"<?", at):
            kind, opening, closing = ("comment", 4, b"-->") if data[at + 2 : at + 3] == b"-" else ("cdata", 9, b"]]>") if data[at + 1 : at + 2] == b"!" else ("instruction", 2, b"?>")
            stop = data.find(closing, at + opening)
            if stop < 0:
                yield Event("problem", at, size, f"unclosed_{kind}")
            end = size if stop < 0 else stop + len(closing)
            yield Event(kind, at, end)
            at = end
        elif data.startswith(b"<!", at):
            end, depth = at + 2, 0
            while end < size and not (data[end : end + 1] == b">" and depth <= 0):
                depth += {b"[": 1, b"]": -1}.get(data[end : end + 1], 0)
                end += 1
            if end >= size:
                yield Event("problem", at, size, "unclosed_doctype")
            yield Event("doctype", at, min(size, end + 1))
            at = min(size, end + 1)
        elif data.startswith(b"</", at) and (m := _NAME.match(data, at + 2)):
            end = data.find(b">", m.end())
            if end < 0:
                yield Event("problem", at, size, "unclosed_tag")
            end = size if end < 0 else end + 1
            yield Event("end", at, end, m[0].decode("utf-8", "replace"))
            at = end
        elif m := _NAME.match(data, at + 1):
            tag, attributes, here, empty = m[0].decode("utf-8", "replace"), {}, m.end(), False
            while True:
                here = _SPACE.match(data, here).end()
                if here >= size:
                    problem("unclosed_tag", at, size)
                    break
                if data[here : here + 1] == b">":
                    here += 1
                    break
                if data.startswith(b"/>", here):
                    here, empty = here + 2, True
                    break
                a = _ATTRIBUTE.match(data, here)
                if not a or data[here : here + 1] == b"<":
                    if data[here : here + 1] == b"<":
                        problem("unclosed_tag", at, here)
                        break
                    problem("unexpected_character", here, here + 1)
                    here += 1
                    continue
                name, begin = a[1].decode("utf-8", "replace"), here
                if html:
                    name = name.lower()
                value = next((v for v in a.groups()[2:5] if v is not None), None)
                here = a.end()
                if a[5] is not None and not html and value.endswith(b"/") and data[here : here + 1] == b">":
                    value, here = value[:-1], here - 1  # the element is empty
                if a[5] is not None and not html:
                    problem("unquoted_attribute", begin, here)
                if a[2] is None and not html:
                    problem("attribute_without_value", begin, here)
                if a[6] is not None and a[2] is not None:
                    quote = data[here : here + 1]
                    problem("unclosed_quote" if quote in (b'"', b"'") else "attribute_without_value", begin, min(size, here + 1))
                    here += quote in (b'"', b"'")
                if name in attributes:
                    problem("duplicate_attribute", begin, here)
                    continue  # the first counts
                attributes[name] = decoded((value or b"").decode("utf-8", "replace"), html, problem, begin)
            low = tag.lower()
            yield from told
            told.clear()
            empty = empty or (html and low in VOID)
            yield Event("start", at, here, tag, attributes, empty)
            at = here
            if html and low in RAW and not empty:
                raw = tag.encode()
        else:
            yield Event("problem", at, at + 1, "stray_less_than")
            yield Event("text", at, at + 1)
            at += 1


@dataclass
class Element:
    """An open or finished element; ``parent`` is its number, ``namespaces`` those declared up to it."""

    number: int
    start: Event
    name: str
    depth: int
    parent: int | None
    namespaces: dict[str, str]


class Reader:
    """Elements over events: what is open, and what is wrong with how elements nest."""

    def __init__(self, text: str | None, html: bool):
        self.data, self.html = (text or "").encode(), html
        self.open: list[Element] = []
        self.problems: list[tuple[str, int, int]] = []
        self.count = 0

    def walk(self) -> Iterator[tuple[str, Event, Element | None]]:
        """("start", event, element), ("text", event, element around) and ("end", event, element) in order; an element left open ends where another end tag or the text closes it."""
        for e in events(self.data, self.html):
            if e.kind == "problem":
                self.problems.append((e.name, e.begin, e.end))
            elif e.kind in ("text", "cdata"):
                yield "text", e, self.open[-1] if self.open else None
            elif e.kind == "start":
                around = self.open[-1] if self.open else None
                spaces = around.namespaces if around else {}
                own = {a.partition(":")[2]: v for a, v in e.attributes.items() if a == "xmlns" or a.startswith("xmlns:")}
                element = Element(self.count, e, e.name.lower(), len(self.open), around.number if around else None, {**spaces, **own} if own else spaces)
                prefix = element.name.rpartition(":")[0]
                if prefix and not self.html and not any(k.lower() == prefix for k in element.namespaces):
                    self.problems.append(("undeclared_prefix", e.begin, e.end))
                self.count += 1
                yield "start", e, element
                if e.empty:
                    yield "end", e, element
                else:
                    self.open.append(element)
            elif e.kind == "end":
                name = e.name if not self.html else e.name.lower()
                places = [k for k, x in enumerate(self.open) if (x.start.name if not self.html else x.name) == name] if self.open else []
                if not places:
                    self.problems.append(("unexpected_end_tag", e.begin, e.end))
                    continue
                while len(self.open) > places[-1] + 1:
                    left = self.open.pop()
                    if not self.html:
                        self.problems.append(("unclosed_element", left.start.begin, left.start.end))
                    yield "end", Event("end", e.begin, e.begin, left.name), left
                yield "end", e, self.open.pop()
        while self.open:
            left = self.open.pop()
            self.problems.append(("unclosed_element", left.start.begin, left.start.end))
            yield "end", Event("end", len(self.data), len(self.data), left.name), left


def namespace_of(element: Element) -> str | None:
    prefix = element.name.rpartition(":")[0]
    return next((v for k, v in element.namespaces.items() if k.lower() == prefix), None)


def _mapped(documents: DataFrame, key: str, text: str, rows_of: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """Rows (key, ...) that a function of one text gives."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                rows = [(doc, *r) for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in rows_of(value)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, *(types[k] for k in kinds)], strict=True)], [key, *names])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, {schema}")


ELEMENTS = "ordinal int, tag string, depth int, attributes string, byte_start long, byte_end long, parent int, role string, namespace string"


def elements(documents: DataFrame, key: str, text: str, html: bool = False) -> DataFrame:
    """Start tags of each document: ordinal, tag, depth by open tags, the ordinal of the element around (parent), attributes as JSON, byte range, role (empty for `<a/>`, else open), and the namespace of its name."""

    def rows(value: str | None) -> list[tuple]:
        out = []
        for what, e, x in Reader(value, html).walk():
            if what == "start":
                out.append((x.number, x.name, x.depth, json.dumps(e.attributes, sort_keys=True), e.begin, e.end, x.parent, "empty" if e.empty else "open", namespace_of(x)))
        return out

    return _mapped(documents, key, text, rows, ELEMENTS)


def problems(documents: DataFrame, key: str, text: str, html: bool = False) -> DataFrame:
    """(key, problem, byte_start, byte_end) of what is malformed in each document."""

    def rows(value: str | None) -> list[tuple]:
        reader = Reader(value, html)
        for what, e, _ in reader.walk():
            if what == "text" and e.kind == "text":
                decoded(reader.data[e.begin : e.end].decode("utf-8", "replace"), html, lambda *p: reader.problems.append(p), e.begin)
        return reader.problems

    return _mapped(documents, key, text, rows, "problem string, byte_start long, byte_end long")


# fixed values: components of a schema, and what gives a named type its base, by their tag without a prefix
COMPONENTS = {"element": "element", "complextype": "type", "simpletype": "type", "attribute": "attribute", "group": "group", "attributegroup": "group"}
DERIVATIONS = {"extension", "restriction"}


def component_rows(value: str | None) -> list[tuple]:
    rows: list[list] = []
    owners: dict[int, list] = {}  # row of each open component, by the element's number
    stack: list[tuple[int, list | None]] = []  # open elements: number, the named component that they are or lie in
    for what, e, x in Reader(value, False).walk():
        if what == "start":
            local, get = x.name.rpartition(":")[2], e.attributes.get
            around = stack[-1][1] if stack else None
            mine = around
            if local in COMPONENTS:
                named = get("name")
                if named is not None:
                    mine = [x.number, COMPONENTS[local], named, get("type") or get("ref") or get("base"), around[2] if around else None]
                    rows.append(mine)
                    owners[x.number] = mine
            elif local in DERIVATIONS and around is not None and around[3] is None and around[1] == "type":
                around[3] = get("base")
            stack.append((x.number, mine))
        elif what == "end":
            stack.pop()
    return [tuple(r) for r in rows]


def schema_components(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, component, name, type, owner) of the named components of schema documents, in order; the owner is the nearest named component around at any depth, type the one that is named, referred to, extended or restricted."""
    return _mapped(documents, key, text, component_rows, "ordinal int, component string, name string, type string, owner string")


def unit_of(reader: Reader, pieces: list[Event], plain: bool, only: str | None = None) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """Text of a body, and its segments (unit bytes from, to, file bytes from, to, exact): runs that are copied byte by byte, and references that stand for other text (of those, if given, the ones that ``only`` matches)."""
    out, segments, n = [], [], 0

    def add(text: bytes, begin: int, end: int, exact: bool) -> None:
        nonlocal n
        if text or end > begin:
            out.append(text)
            segments.append((n, n + len(text), begin, end, exact))
            n += len(text)

    for e in pieces:
        if e.kind == "cdata":
            add(reader.data[e.begin + 9 : e.end - 3], e.begin + 9, e.end - 3, True)
            continue
        if plain:
            add(reader.data[e.begin : e.end], e.begin, e.end, True)
            continue
        text, last, begin = reader.data[e.begin : e.end].decode("utf-8", "replace"), 0, e.begin
        for m in _REFERENCE.finditer(text):
            value = decode_reference(m, reader.html)
            if value is None or (only and not re.fullmatch(only, m[0])):
                continue
            run = text[last : m.start()].encode()
            add(run, begin, begin + len(run), True)
            begin += len(run)
            add(value.encode(), begin, begin + len(m[0].encode()), False)
            begin += len(m[0].encode())
            last = m.end()
        run = text[last:].encode()
        add(run, begin, begin + len(run), True)
    return b"".join(out).decode("utf-8", "replace"), segments


def bodies_of(value: str | None, tags: set[str], html: bool, only: str | None = None) -> Iterator[tuple[Element, str, list[tuple]]]:
    """Each element of these tags in the order in which they begin, with its own text and segments; what elements inside it hold is theirs."""
    reader, held, done = Reader(value, html), {}, []
    for what, e, x in reader.walk():
        if what == "start" and x.name in tags:
            held[x.number] = []
        elif what == "text" and x is not None and x.number in held:
            held[x.number].append(e)
        elif what == "end" and x.number in held:
            plain = html and x.name in RAW - DECODED_RAW
            done.append((x, *unit_of(reader, held.pop(x.number), plain, only)))
    yield from sorted(done, key=lambda d: d[0].number)


def inline_units(documents: DataFrame, key: str, text: str, tags: set[str], html: bool = False) -> DataFrame:
    """(key, unit, tag, attributes, body) of the bodies of some kinds of element, whatever their attributes; each is a unit of its own, numbered in the order in which they begin."""
    return _mapped(documents, key, text, lambda v: [(n, x.name, json.dumps(x.start.attributes, sort_keys=True), body) for n, (x, body, _) in enumerate(bodies_of(v, tags, html))], "unit int, tag string, attributes string, body string")


def unit_segments(documents: DataFrame, key: str, text: str, tags: set[str], html: bool = False, only: str | None = None) -> DataFrame:
    """(key, unit, from_start, from_end, to_start, to_end, exact): where the bytes of each unit lie in its document; ``only``: a pattern of the references that are decoded, if not all are."""
    return _mapped(documents, key, text, lambda v: [(n, *s) for n, (_, _, segments) in enumerate(bodies_of(v, tags, html, only)) for s in segments], "unit int, from_start long, from_end long, to_start long, to_end long, exact boolean")


def inline_bodies(documents: DataFrame, key: str, text: str, tag: str, html: bool = True) -> DataFrame:
    """(key, ordinal, body, shift, length) of the bodies of one kind of element that are one run of bytes: byte ``i`` of a unit is byte ``shift + i`` of its document, as long as i < length."""

    def rows(value: str | None) -> list[tuple]:
        return [(n, body, s[0][2] if s else x.start.end, len(body.encode())) for n, (x, body, s) in enumerate(bodies_of(value, {tag}, html)) if len(s) <= 1 and all(p[4] for p in s)]

    return _mapped(documents, key, text, rows, "ordinal int, body string, shift long, length long")


_BUCKET = 12  # bits of a coordinate that meet within one bucket


def _in_buckets(df: DataFrame, start: str, end: str) -> DataFrame:
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn("bucket", F.explode(F.sequence(F.shiftright(start, _BUCKET), F.shiftright(last, _BUCKET))))


def compose(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """The map from the coordinates before ``first`` to those behind ``second``: segments (from_start, from_end, to_start, to_end, exact) of both, those of one ``on`` overlapping in what is the end of the one and the beginning of the other.

    Where an exact segment meets one, the overlap is exact; where one of both stands for
    other text, it is mapped as a whole.  Other columns of ``first`` are kept.
    """
    a = _in_buckets(first.withColumnsRenamed({c: f"a_{c}" for c in ("from_start", "from_end", "to_start", "to_end", "exact")}), "a_to_start", "a_to_end")
    b = second.select(*on, *[F.col(c).alias(f"b_{c}") for c in ("from_start", "from_end", "to_start", "to_end", "exact")])
    b = _in_buckets(b, "b_from_start", "b_from_end")
    low, high = F.greatest("a_to_start", "b_from_start"), F.least("a_to_end", "b_from_end")
    met = a.join(b, [*on, "bucket"]).where((low < high) & (F.shiftright(low, _BUCKET) == F.col("bucket")))  # once, in the bucket where they first meet
    exact, a_exact, b_exact = F.col("a_exact") & F.col("b_exact"), F.col("a_exact"), F.col("b_exact")
    return met.select(
        *[c for c in first.columns if c not in ("from_start", "from_end", "to_start", "to_end", "exact")],
        F.when(a_exact, F.col("a_from_start") + low - F.col("a_to_start")).otherwise(F.col("a_from_start")).alias("from_start"),
        F.when(a_exact, F.col("a_from_start") + high - F.col("a_to_start")).otherwise(F.col("a_from_end")).alias("from_end"),
        F.when(b_exact, F.col("b_to_start") + low - F.col("b_from_start")).otherwise(F.col("b_to_start")).alias("to_start"),
        F.when(b_exact, F.col("b_to_start") + high - F.col("b_from_start")).otherwise(F.col("b_to_end")).alias("to_end"),
        exact.alias("exact"),
    )


def map_spans(spans: DataFrame, segments: DataFrame, on: list[str]) -> DataFrame:
    """Spans (on, start, end, ...) of units with file_start, file_end and ``relation``: mapped, through_reference where an end lies on text that stands for other text (the reference is included), outside_body, or missing_fact_relation where the unit has no map.

    The first and the last byte of a span are looked up; a span may run over several segments.
    """
    known = segments.select(*on).distinct().withColumn("known", F.lit(True))
    rows = spans.withColumn("!id", F.monotonically_increasing_id())
    ends = rows.select("!id", *on, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("byte")), F.struct(F.lit(1).alias("side"), F.greatest(F.col("end") - 1, F.col("start")).alias("byte")))).alias("e"))
    ends = ends.select("!id", *on, "e.side", "e.byte", F.shiftright("e.byte", _BUCKET).alias("bucket"))
    found = ends.join(_in_buckets(segments.select(*on, "from_start", "from_end", "to_start", "to_end", "exact"), "from_start", "from_end"), [*on, "bucket"])
    found = found.where((F.col("byte") >= F.col("from_start")) & (F.col("byte") < F.col("from_end")))
    place = F.when(F.col("side") == 0, F.when(F.col("exact"), F.col("to_start") + F.col("byte") - F.col("from_start")).otherwise(F.col("to_start"))).otherwise(F.when(F.col("exact"), F.col("to_start") + F.col("byte") + 1 - F.col("from_start")).otherwise(F.col("to_end")))
    both = found.select("!id", "side", place.alias("place"), "exact").groupBy("!id").agg(
        F.min(F.when(F.col("side") == 0, F.col("place"))).alias("low"), F.min(F.when(F.col("side") == 1, F.col("place"))).alias("high"), F.bool_and("exact").alias("exact")
    )
    out = rows.join(both, "!id", "left").join(known, on, "left")
    inside = F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("end") >= F.col("start"))
    relation = F.when(F.col("known").isNull(), "missing_fact_relation").when(~inside, "outside_body").when(F.col("exact"), "mapped").otherwise("through_reference")
    ok = relation.isin("mapped", "through_reference")
    file_end = F.when(F.col("end") == F.col("start"), F.col("low")).otherwise(F.col("high"))
    return out.select(*spans.columns, relation.alias("relation"), F.when(ok, F.col("low")).alias("file_start"), F.when(ok, file_end).alias("file_end"))
