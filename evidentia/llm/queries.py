"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import ann, bpe, conversations, decontaminate, html_extract, ngram_join, pieces, pitman_yor, quality, spelling, substrings, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item with a verified overlap."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_adaptive_scan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_vertical_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_tree_scoring_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_difference_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op11_lazy_determinised_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_range_reporting_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_merge_round_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seed_decontamination": op1_spaced_seed_decontamination,
    "op2_additive_quality": op2_additive_quality,
    "op3_adaptive_scan_neighbours": op3_adaptive_scan_neighbours,
    "op4_vertical_ngram_join": op4_vertical_ngram_join,
    "op5_pitman_yor_scores": op5_pitman_yor_scores,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_lexicon_toxicity": op7_lexicon_toxicity,
    "op8_tree_scoring_extraction": op8_tree_scoring_extraction,
    "op9_difference_cover_substrings": op9_difference_cover_substrings,
    "op10_bpe_transducer": op10_bpe_transducer,
    "op11_lazy_determinised_repair": op11_lazy_determinised_repair,
    "op12_range_reporting_variants": op12_range_reporting_variants,
    "op13_merge_round_pieces": op13_merge_round_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op4_vertical_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT DISTINCT doc_id, g FROM (
                 SELECT doc_id, array_to_string(w, ' ') AS g FROM d WHERE len(w) BETWEEN 1 AND 3
                 UNION ALL SELECT doc_id, array_to_string(w[i : i + 3], ' ') FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 4))),
             n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
             l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.o >= 85 * (a.n + b.n - p.o)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.doc_id)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.root) AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
    """,
    "op9_difference_cover_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k
                     FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
             f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
             gone AS (SELECT DISTINCT doc_id, i + o AS pos
                      FROM (SELECT win.doc_id, win.i FROM win JOIN f USING (k) WHERE f.m < win.doc_id), (SELECT unnest(generate_series(0, 12)) AS o)),
             word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS pos FROM d WHERE len(w) > 0),
             s AS (SELECT word.doc_id, count(gone.pos) AS n_removed, string_agg(word.x, ' ' ORDER BY word.pos) FILTER (WHERE gone.pos IS NULL) AS kept
                   FROM word LEFT JOIN gone USING (doc_id, pos) GROUP BY word.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM d LEFT JOIN s USING (doc_id)
    """,
}
