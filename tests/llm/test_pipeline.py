"""The pipeline against a brute-force version of its deciding stages."""

import corpus_pipeline
from evidentia.llm import queries
from tests.llm.test_text_operators import components_by_force, corpus, labelled, removed_by_force


def test_stages_chain(spark, tmp_path):
    rows = [r for r in corpus(seed=8, n=60) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, node long").selectExpr("doc_id", "text", "lang", "cast(node as string) source", "cast(length(text) as long) n_chars")
    item = " ".join(f"bench{i}" for i in range(20))
    leak = spark.createDataFrame([(8000, f"some words {item} and more", "en", "s", 10)], docs.schema)
    folder = str(tmp_path)
    docs.unionByName(leak).write.parquet(f"{folder}/documents.parquet")
    labelled(spark)[1].where("doc_id is not null").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, frames = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == kept.columns
        out.write.parquet(f"{folder}/{name}")
        kept = frames[name] = spark.read.parquet(f"{folder}/{name}")
    before = [tuple(r) for r in frames["toxicity"].collect()]
    stay = {c for _, _, c in components_by_force(before)}
    assert {r.doc_id for r in frames["ngram_join"].collect()} == stay
    gone = {d: n for d, _, n, _ in removed_by_force([tuple(r) for r in frames["ngram_join"].collect()])}
    texts = {r.doc_id: r for r in frames["ngram_join"].collect()}
    for r in frames["substring_dedup"].collect():
        old = texts[r.doc_id].text
        assert (r.text == old) == (gone[r.doc_id] == 0) and (old is None or len(r.text.split()) == len(old.split()) - gone[r.doc_id])
    assert {r.doc_id for r in frames["substring_dedup"].collect()} - {r.doc_id for r in frames["decontamination"].collect()} == {8000}
    result = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert result == {r.doc_id: r.n_tokens for r in frames["bpe"].collect()} and set(result) == stay - {8000}


def test_every_operator_is_registered():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))
