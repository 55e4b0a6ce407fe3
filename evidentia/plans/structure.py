"""Facts that the texts of manifests and interface files state by themselves, without any code being run.

Manifests are read line by line: metadata (``## Key: value``), comments, and files in
their order.  Interface files are nested elements: an object element lies in the nearest
object around it, inherits from templates, and names or holds its script handlers; all of
them are read in one pass with a stack, so nesting has no bound.

Cases: null and empty texts state nothing; a key that is repeated states each value;
malformed markup is read as far as it goes (its problems are `markup.problems`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.sources import markup
from evidentia.sources.text import manifest_lines

# fixed values: metadata keys in lower case, and the fact that each value of theirs states
LISTS = {"dependencies": "dependency", "requireddeps": "dependency", "optionaldeps": "optional_dependency", "loadwith": "load_with", "savedvariables": "saved_variable", "savedvariablespercharacter": "saved_variable"}
SINGLE = {"title": "title", "version": "version", "interface": "interface"}
FLAGS = {"loadondemand": "load_on_demand"}


def manifest_facts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, fact, value, position): file with its place among files, dependencies and saved names with theirs in their list, saved_root (a saved name up to its first dot), flags that are 1, title and the like."""
    lines = manifest_lines(documents, key, text)
    head = F.regexp_extract("content", r"^##\s*([^:]+?)\s*:", 1)
    body = F.trim(F.regexp_extract("content", r"^##[^:]*:(.*)$", 1))
    meta = lines.where("kind = 'metadata'").select(key, "line", S.ascii_fold(F.regexp_replace(head, r"\s", "")).alias("k"), body.alias("body"))
    kinds = F.create_map(*[F.lit(x) for pair in LISTS.items() for x in pair])
    listed = meta.where(F.col("k").isin(*LISTS)).select(key, "line", kinds[F.col("k")].alias("fact"), F.posexplode(S.name_list(F.col("body"))).alias("position", "value"))
    roots = listed.where("fact = 'saved_variable'").select(key, "line", F.lit("saved_root").alias("fact"), F.split("value", "[.]")[0].alias("value"), F.lit(None).cast("int").alias("position"))
    roots = roots.groupBy(key, "fact", "value").agg(F.min("line").alias("line")).select(key, "line", "fact", "value", F.lit(None).cast("int").alias("position"))
    names = F.create_map(*[F.lit(x) for pair in {**SINGLE, **FLAGS}.items() for x in pair])
    single = meta.where(F.col("k").isin(*SINGLE) | (F.col("k").isin(*FLAGS) & (F.col("body") == "1"))).select(key, "line", names[F.col("k")].alias("fact"), F.col("body").alias("value"), F.lit(None).cast("int").alias("position"))
    files = lines.where("kind = 'file'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", F.trim("content").alias("path")))).alias("files"))
    files = files.select(key, F.posexplode("files").alias("position", "f")).select(key, "f.line", F.lit("file").alias("fact"), S.normal_path(F.col("f.path")).alias("value"), "position").where("value IS NOT NULL")
    out = listed.select(key, "line", "fact", "value", "position")
    for part in (roots, single, files):
        out = out.unionByName(part.select(key, "line", "fact", "value", "position"))
    return out


# fixed values: elements that hold or describe objects and are none themselves
CONTAINERS = {"ui", "frames", "layers", "layer", "scripts", "size", "anchors", "anchor", "offset", "absdimension", "keyvalues", "keyvalue", "animations", "include", "script", "attributes", "attribute"}


def _relations(value: str | None) -> list[tuple]:
    rows: list[tuple] = []
    stack: list[tuple[str, str | None, int | None]] = []  # tag, the object around or itself, and its ordinal
    bodies: dict[int, list[str]] = {}
    reader = markup.Reader(value, html=False)
    for what, e, x in reader.walk():
        if what == "start":
            around = next(((o, n) for _, o, n in reversed(stack) if n is not None), (None, None))
            get, tag = e.attributes.get, x.name.rpartition(":")[2]
            in_scripts = bool(stack) and stack[-1][0] == "scripts"
            mine: tuple[str | None, int | None] = (None, None)
            if in_scripts:
                target = get("function") or get("method")
                if target:
                    rows.append((x.number, tag, "sets_script", around[0], target, "derived"))
                else:
                    bodies[x.number] = []
            elif tag not in CONTAINERS:
                name = get("name")
                if name and "$parent" in name:
                    name = name.replace("$parent", around[0]) if around[0] else None
                mine = (name, x.number)
                if get("virtual", "").lower() == "true" and name:
                    rows.append((x.number, tag, "declares_template", None, name, "derived"))
                parent = get("parent") or around[0]
                if name and parent:
                    rows.append((x.number, tag, "parent_of", parent, name, "derived"))
                elif around[1] is not None or get("parent"):
                    rows.append((x.number, tag, "parent_of", parent, name, "unnamed_object"))
                for template in (t.strip() for t in get("inherits", "").split(",")):
                    if template:
                        rows.append((x.number, tag, "inherits", name, template, "derived" if name else "unnamed_object"))
            stack.append((tag, *mine))
        elif what == "text" and x is not None and x.number in bodies:
            bodies[x.number].append(reader.data[e.begin : e.end].decode("utf-8", "replace"))
        elif what == "end":
            tag, _, _ = stack.pop()
            if x.number in bodies:
                around = next((o for _, o, n in reversed(stack) if n is not None), None)
                body = "".join(bodies.pop(x.number)).strip()
                rows.append((x.number, tag, "sets_script", around, None, "inline_body" if body else "no_handler"))
    return sorted(rows, key=lambda r: r[0])


def interface_relations(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, tag, relation, source, target, state) of interface files: parent_of by nesting or by name, inherits, declares_template, sets_script with the handler's name or state inline_body; what has no name to be known by is unnamed_object."""
    return markup._mapped(documents, key, text, _relations, "ordinal int, tag string, relation string, source string, target string, state string")
