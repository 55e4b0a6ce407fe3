"""Manifests and interface files that state their own facts."""

from evidentia.plans import structure


def test_manifest(spark):
    text = "## Title : My | Thing\n##dependencies: A, B C\n## X-Other: 1\n## OptionalDeps:\n# note\n\nui\\main.xml\n./core.lua\n../bad.lua\n## SavedVariables: One.a, One.b, Two"
    rows = [(1, text), (2, None), (3, "")]
    got = sorted((r.doc, r.fact, r.value, r.position) for r in structure.manifest_facts(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").collect() if r.position is not None)
    assert got == [(1, "dependency", "A", 0), (1, "dependency", "B", 1), (1, "dependency", "C", 2), (1, "file", "core.lua", 1), (1, "file", "ui/main.xml", 0), (1, "saved_variable", "One.a", 0), (1, "saved_variable", "One.b", 1), (1, "saved_variable", "Two", 2)]
    rest = {(r.fact, r.value) for r in structure.manifest_facts(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").where("position IS NULL").collect()}
    assert rest == {("title", "My | Thing"), ("saved_root", "One"), ("saved_root", "Two")}


def test_interface_files():
    text = "<Ui><Frame name='A'>" + "<Frames><Frame name='$parentB'>" * 30 + "<Scripts><OnShow method='Go'/><OnHide/><OnLoad> x </OnLoad></Scripts>" + "</Frame></Frames>" * 30 + "<Texture/></Frame></Ui>"
    rows = structure._relations(text)
    deep = "A" + "B" * 30
    assert [r for r in rows if r[2] == "sets_script"] == [(31 * 2 + 1, "onshow", "sets_script", deep, "Go", "derived"), (64, "onhide", "sets_script", deep, None, "no_handler"), (65, "onload", "sets_script", deep, None, "inline_body")]
    assert sum(r[2] == "parent_of" and r[5] == "derived" for r in rows) == 30 and ("texture", "parent_of", "A", None, "unnamed_object") in {r[1:] for r in rows}
    assert structure._relations("<Ui><Frame name='a' inherits='T'")[0][2:5] == ("inherits", "a", "T") and structure._relations(None) == []
