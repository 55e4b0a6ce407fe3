"""The pull reader on fixtures, against the standard library's XML parser, and composed coordinate maps."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.sources import markup as K


def starts(text, html=False):
    return [(x.name, x.depth, x.parent, e.attributes, e.empty) for what, e, x in K.Reader(text, html).walk() if what == "start"]


def wrong(text, html=False):
    reader = K.Reader(text, html)
    for _ in reader.walk():
        pass
    return [(name, reader.data[a:b].decode()) for name, a, b in reader.problems]


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("<a><b/><c x='1' y=\"2\"/></a>", [("a", 0, None, {}, False), ("b", 1, 0, {}, True), ("c", 1, 0, {"x": "1", "y": "2"}, True)]),
        ("<a><![CDATA[<b>&lt;</b>]]></a>", [("a", 0, None, {}, False)]),
        ("<a t='&lt;&#65;&#x42;&amp;&apos;&quot;&gt;'/>", [("a", 0, None, {"t": "<AB&'\">"}, True)]),
        ("<!-- <b> --><?pi <c> ?><!DOCTYPE d [<!ELEMENT d ANY>]><a/>", [("a", 0, None, {}, True)]),
        ("<a u=5 v/>", [("a", 0, None, {"u": "5", "v": ""}, True)]),
        ("<a t='>'>x</a><b/>", [("a", 0, None, {"t": ">"}, False), ("b", 0, None, {}, True)]),
        ("<é ü='ö'/>", [("é", 0, None, {"ü": "ö"}, True)]),
        ("<a x='1' x='2'/>", [("a", 0, None, {"x": "1"}, True)]),
        ("", []), (None, []), ("no markup", []), ("a < b <3", []),
    ],
)
def test_elements(text, expect):
    assert starts(text) == expect


def test_html():
    text = "<P CLASS=x Checked>one<br><img src=a.png>two<Script type='t'>if (a<b) x('</p>')</SCRIPT><b>bold<p>"
    assert starts(text, True) == [("p", 0, None, {"class": "x", "checked": ""}, False), ("br", 1, 0, {}, True), ("img", 1, 0, {"src": "a.png"}, True), ("script", 1, 0, {"type": "t"}, False), ("b", 1, 0, {}, False), ("p", 2, 4, {}, False)]
    assert {n for n, _ in wrong(text, True)} == {"unclosed_element"}


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("<a", [("unclosed_tag", "<a"), ("unclosed_element", "<a")]),
        ("<a><b></a>", [("unclosed_element", "<b>")]),
        ("<a></b></a>", [("unexpected_end_tag", "</b>")]),
        ("<A></a>", [("unexpected_end_tag", "</a>"), ("unclosed_element", "<A>")]),
        ("<a u=5/>", [("unquoted_attribute", "u=5")]),
        ("<a u/>", [("attribute_without_value", "u")]),
        ("<a x='1' x='2'/>", [("duplicate_attribute", "x='2'")]),
        ("<a x='1/>", [("unclosed_quote", "x='"), ("attribute_without_value", "1")]),
        ("<a><!-- x</a>", [("unclosed_comment", "<!-- x</a>"), ("unclosed_element", "<a>")]),
        ("<a><![CDATA[x</a>", [("unclosed_cdata", "<![CDATA[x</a>"), ("unclosed_element", "<a>")]),
        ("<p:a/>", [("undeclared_prefix", "<p:a/>")]),
        ("<a xmlns:p='u'><p:b/></a>", []),
        ("é<a t='&nope;'/>", [("unknown_reference", "&nope;")]),
        ("a < b", [("stray_less_than", "<")]),
    ],
)
def test_problems_have_spans(text, expect):
    got = wrong(text)
    if expect and expect[0][0] == "unknown_reference":
        assert [n for n, _ in got] == ["unknown_reference"]
    else:
        assert got == expect


def test_a_malformed_text_never_fails_the_job(spark):
    rows = [(1, "<a><b x='1'/></a>"), (2, "<a <b x=' <![CDATA["), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc long, text string")
    assert {r.doc for r in K.elements(df, "doc", "text").collect()} == {1, 2}
    assert {r.doc for r in K.problems(df, "doc", "text").collect()} == {2}


def test_namespaces(spark):
    df = spark.createDataFrame([(1, "<a xmlns='one' xmlns:X='two'><b/><X:c xmlns='three'><d/></X:c><e/></a>")], "doc long, text string")
    assert [(r.tag, r.namespace) for r in K.elements(df, "doc", "text").collect()] == [("a", "one"), ("b", "one"), ("x:c", "two"), ("d", "three"), ("e", "one")]


NAMES = st.sampled_from(["a", "b", "cd", "é"])
VALUES = st.text(alphabet="ab<>&'\" é", max_size=6)


def tree(depth):
    inner = st.lists(tree(depth - 1), max_size=3) if depth else st.just([])
    return st.tuples(NAMES, st.dictionaries(NAMES, VALUES, max_size=2), VALUES, inner)


def element(t):
    e = ET.Element(t[0], t[1])
    e.text = t[2]
    e.extend(map(element, t[3]))
    return e


@settings(max_examples=150, deadline=None)
@given(tree(3))
def test_equals_the_standard_parser(t):
    text = ET.tostring(element(t), encoding="unicode")
    parsed = ET.fromstring(text)
    assert [(n, a) for n, _, _, a, _ in starts(text)] == [(e.tag, e.attrib) for e in parsed.iter()]
    assert wrong(text) == []
    bodies = [body for _, body, _ in K.bodies_of(text, {"a", "b", "cd", "é"}, False)]
    assert bodies == ["".join([e.text or "", *(c.tail or "" for c in e)]) for e in parsed.iter()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/='\"!-[]CDATA&;#x aé?", max_size=60), st.booleans())
def test_any_text_is_read(text, html):
    spans = []
    for what, e, _ in K.Reader(text, html).walk():
        if what == "start" or what == "text":
            spans.append((e.begin, e.end))
    assert all(a <= b for a, b in spans) and spans == sorted(spans)


def test_time_is_linear():
    import time

    for piece in ("<a x='", "<!--", "<![CDATA[", "<a ", "</a ", "<a>", "&x", "<", "<script>", "<!x ["):
        for html in (False, True):
            began = time.time()
            for _ in K.Reader(piece * 20_000, html).walk():
                pass
            assert time.time() - began < 5, (piece, html)


def test_owners_at_any_depth(spark):
    deep = "<s:schema xmlns:s='x'><s:element name='top'>" + "<s:complexType><s:sequence><s:choice>" * 40 + "<s:element name='low' type='t'/>" + "</s:choice></s:sequence></s:complexType>" * 40 + "</s:element></s:schema>"
    extended = "<schema><complexType name='c'><complexContent><extension base='b'><sequence><choice><element name='e'><simpleType><restriction base='r'/></simpleType></element></choice></sequence></extension></complexContent></complexType><element ref='q'/></schema>"
    df = spark.createDataFrame([(1, deep), (2, extended), (3, "<schema><element name='x'")], "doc long, text string")
    got = sorted((r.doc, r.component, r.name, r.type, r.owner) for r in K.schema_components(df, "doc", "text").collect())
    assert got == sorted([(1, "element", "top", None, None), (1, "element", "low", "t", "top"), (2, "type", "c", "b", None), (2, "element", "e", None, "c"), (3, "element", "x", None, None)], key=str)


def test_units_of_all_scripts(spark):
    page = "<html><script type='a'>f(1)</script><Script>f(2); '&lt;'</Script><script src='x'></script><p>f(3)</p><title>a &amp; b</title></html>"
    df = spark.createDataFrame([(1, page)], "doc long, text string")
    units = K.inline_units(df, "doc", "text", {"script", "title"}, True).orderBy("unit").collect()
    assert [(r.tag, r.body) for r in units] == [("script", "f(1)"), ("script", "f(2); '&lt;'"), ("script", ""), ("title", "a & b")]
    assert json.loads(units[0].attributes) == {"type": "a"}
    assert [(r.ordinal, page[r.shift : r.shift + r.length]) for r in K.inline_bodies(df, "doc", "text", "script").orderBy("ordinal").collect()] == [(0, "f(1)"), (1, "f(2); '&lt;'"), (2, "")]


def test_spans_through_decoded_bodies(spark):
    text = "<x><on>aé &lt; b<![CDATA[ <c> ]]>&#233;d</on><on/></x>"
    df = spark.createDataFrame([(1, text)], "doc long, text string")
    (_, body, segments), _ = K.bodies_of(text, {"on"}, False)
    assert body == "aé < b <c> éd"
    data, raw = body.encode(), text.encode()
    for a, b, c, d, exact in segments:
        assert not exact or data[a:b] == raw[c:d]
    spans = spark.createDataFrame([(1, 0, a, b) for a in range(len(data) + 1) for b in range(a, len(data) + 2)] + [(1, 5, 0, 1)], "doc long, unit int, start long, end long")
    got = {(r.unit, r.start, r.end): r for r in K.map_spans(spans, K.unit_segments(df, "doc", "text", {"on"}), ["doc", "unit"]).collect()}
    assert got[5, 0, 1].relation == "missing_fact_relation" and got[0, 0, len(data) + 1].relation == "outside_body"
    r = got[0, 0, 3]
    assert r.relation == "mapped" and raw[r.file_start : r.file_end].decode() == "aé"
    r = got[0, 2, 6]
    assert r.relation == "mapped" or r.relation == "through_reference"
    r = got[0, 4, 5]
    assert r.relation == "through_reference" and raw[r.file_start : r.file_end] == b"&lt;"
    at = data.index(b"<c>")
    r = got[0, at, at + 3]
    assert r.relation == "mapped" and raw[r.file_start : r.file_end] == b"<c>"


@pytest.mark.parametrize("seed", range(3))
def test_composed_maps(spark, seed):
    rng = random.Random(seed)

    def segments(size, to_first):
        at, to, out = 0, to_first, []
        while at < size:
            n = min(size - at, rng.choice([1, 3, 50, 9000]))
            exact = rng.random() < 0.7
            gap = rng.randint(0, 4)
            width = n if exact else rng.randint(1, 6)
            out.append((1, at, at + n, to + gap, to + gap + width, exact))
            at, to = at + n, to + gap + width
        return out

    first = segments(30_000, 5)
    second = segments(first[-1][4] + 10, 2)
    schema = "doc long, from_start long, from_end long, to_start long, to_end long, exact boolean"
    got = sorted(tuple(r) for r in K.compose(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema), ["doc"]).collect())
    want = []
    for _, a0, a1, b0, b1, x in first:
        for _, c0, c1, d0, d1, y in second:
            low, high = max(b0, c0), min(b1, c1)
            if low < high:
                want.append((1, a0 + low - b0 if x else a0, a0 + high - b0 if x else a1, d0 + low - c0 if y else d0, d0 + high - c0 if y else d1, x and y))
    assert got == sorted(want)
