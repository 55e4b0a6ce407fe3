"""A positional inverted index of texts in Parquet, and phrase look-ups that read only the postings they need.

Documents are numbered as they are indexed; ``DOCS`` consecutive numbers are a block, and
``STRETCH`` consecutive positions of a text a stretch.  A posting is one row for a token,
a block and a stretch: the sorted codes (document in block, position in stretch) of all
its occurrences, small integers that Parquet stores as packed differences.  So no row is
larger than a block allows, however frequent a token is.  Postings lie in folders by bucket (hash of
the token), sorted by token, so a look-up opens the buckets of its tokens and skips the
row groups of others.

A phrase is found within a posting's block and stretch: the codes of its k-th word, less k,
are intersected.  A stretch also holds the first ``OVERLAP`` positions of the next, so a
phrase that goes over the edge is found in the stretch in which it begins; longer phrases
are found in parts of that many words, which are joined by document and place.

An index grows by segments: `add` writes the postings of further documents beside what is
there, `merge` rewrites all segments as one.  Each document is one row of the document table (segment,
row, key), so ids may repeat, be null, or have any type.

Cases: a null or empty text has no tokens; a phrase without tokens is found nowhere; very
long texts are stretches; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.shared import keep, new_folder

DOCS, STRETCH, OVERLAP, BUCKETS = 1 << 10, 1 << 12, 15, 64
_PLACE_BITS = 13  # of a code; more than STRETCH + 2 * OVERLAP places, so that code - k never is another document's code
_PLACE = (1 << _PLACE_BITS) - 1
_DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


def tokens(text: str) -> list[str]:
    """The tokens of a phrase, as those of texts."""
    return re.findall(r"[^\W_]+", text.lower())


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


class PostingIndex:
    """Postings and documents of an index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.segments: list[str] = []

    def add(self, documents: DataFrame, key: str, text: str) -> PostingIndex:
        """Index further documents as a segment of their own."""
        segment = f"{self.folder}/segment-{len(self.segments)}"
        # numbered once and stored, so that postings and documents agree whatever is computed again
        rows = keep(documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")))
        rows.select("row", "key").write.parquet(f"{segment}/documents")
        self._write(self._postings(rows), segment)
        self.segments.append(segment)
        return self

    def _postings(self, rows: DataFrame) -> DataFrame:
        """(token, block, stretch, codes) of numbered rows."""
        found = rows.select("row", F.posexplode(S.word_tokens(F.col("text"))).alias("at", "token"))
        stretch, place = F.floor(F.col("at") / STRETCH).cast("int"), F.col("at") % STRETCH
        own = F.struct(stretch.alias("stretch"), place.alias("place"))
        before = F.struct((stretch - 1).alias("stretch"), (place + STRETCH).alias("place"))
        spread = F.when((place < OVERLAP) & (stretch > 0), F.array(own, before)).otherwise(F.array(own))
        code = F.shiftleft(F.col("row") % DOCS, _PLACE_BITS).cast("int") + F.col("s.place")
        placed = found.select("token", F.shiftright("row", DOCS.bit_length() - 1).alias("block"), F.explode(spread).alias("s"), "row")
        placed = placed.select("token", "block", "s.stretch", code.alias("code"))
        return placed.groupBy("token", "block", "stretch").agg(F.array_sort(F.collect_list("code")).alias("codes"))

    def _write(self, postings: DataFrame, segment: str) -> None:
        order = ["bucket", F.substring("token", 1, 32), "block", "stretch"]
        ranged = postings.withColumn("bucket", bucket_of(F.col("token"), self.buckets)).repartitionByRange(*order)
        ranged.sortWithinPartitions("bucket", "token", "block", "stretch").write.options(**_DELTA).partitionBy("bucket").parquet(f"{segment}/postings")

    def merge(self) -> PostingIndex:
        """One segment in place of several: blocks are numbered on, postings stay as they are."""
        if len(self.segments) > 1:
            folder, first, documents, postings = new_folder(self.spark, "segment"), 0, [], []
            for segment in self.segments:
                rows, found = self.spark.read.parquet(f"{segment}/documents"), self._read(segment)
                documents.append(rows.withColumn("row", F.col("row") + first * DOCS))
                postings.append(found.withColumn("block", F.col("block") + first).drop("bucket"))
                first += (rows.agg(F.max("row")).collect()[0][0] or 0) // DOCS + 1
            reduce(DataFrame.unionByName, documents).write.parquet(f"{folder}/documents")
            self._write(reduce(DataFrame.unionByName, postings), folder)
            self.segments = [folder]
        return self

    def _read(self, segment: str) -> DataFrame:
        return self.spark.read.schema("token string, block long, stretch int, codes array<int>, bucket int").parquet(f"{segment}/postings")

    def documents(self) -> DataFrame:
        """(segment, row, key) of all documents."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{s}/documents").withColumn("segment", F.lit(n)) for n, s in enumerate(self.segments)])

    def postings(self, wanted: set[str]) -> DataFrame:
        """(segment, token, block, stretch, codes) of some tokens; buckets and row groups of others are not read."""
        listed = sorted(wanted)
        numbers = self.spark.createDataFrame([(t,) for t in listed], "token string").select(bucket_of(F.col("token"), self.buckets)).collect()
        pruned = F.col("bucket").isin(sorted({b for (b,) in numbers})) & F.col("token").isin(listed)
        return reduce(DataFrame.unionByName, [self._read(s).where(pruned).drop("bucket").withColumn("segment", F.lit(n)) for n, s in enumerate(self.segments)])

    def phrases(self, wanted: Mapping[str, str]) -> DataFrame:
        """(name, key, position) of every place where a phrase begins; ``wanted`` maps names to phrases."""
        parts: dict[tuple[str, ...], int] = {}
        uses: list[tuple[str, list[int]]] = []
        for name, phrase in wanted.items():
            words = tokens(phrase)
            if words:
                cut = [tuple(words[i : i + OVERLAP + 1]) for i in range(0, len(words), OVERLAP + 1)]
                uses.append((name, [parts.setdefault(p, len(parts)) for p in cut]))
        if not uses or not self.segments:
            return self.spark.createDataFrame([], "name string").select("name", *[F.lit(None).cast(t).alias(c) for c, t in (("key", self._key_type()), ("position", "int"))])
        met = self.postings({t for p in parts for t in p}).groupBy("segment", "block", "stretch")
        met = met.agg(F.map_from_entries(F.collect_list(F.struct("token", "codes"))).alias("m"))
        begins = F.array(*[F.struct(F.lit(n).alias("part"), self._begins(F.col("m"), p).alias("codes")) for p, n in parts.items()])
        hits = met.select("segment", "block", "stretch", F.explode(F.filter(begins, lambda b: F.size(b["codes"]) > 0)).alias("b"))
        hits = hits.select("segment", "block", "stretch", "b.part", F.explode("b.codes").alias("code")).select(
            "segment", "part", (F.col("block") * DOCS + F.shiftright("code", _PLACE_BITS)).alias("row"), (F.col("stretch") * STRETCH + F.col("code").bitwiseAND(_PLACE)).alias("position")
        )
        long = any(len(ids) > 1 for _, ids in uses)
        hits = keep(hits) if long else hits
        plain = self.spark.createDataFrame([(ids[0], name) for name, ids in uses if len(ids) == 1], "part int, name string")
        found = [hits.join(F.broadcast(plain), "part").select("name", "segment", "row", "position")]  # as many rows as the request names
        for name, ids in uses:
            if len(ids) > 1:
                rows = hits.where(F.col("part") == ids[0])
                for k, part in enumerate(ids[1:], 1):
                    later = hits.where(F.col("part") == part).select("segment", "row", (F.col("position") - k * (OVERLAP + 1)).alias("position"))
                    rows = rows.join(later, ["segment", "row", "position"], "left_semi")
                found.append(rows.select(F.lit(name).alias("name"), "segment", "row", "position"))
        return reduce(DataFrame.unionByName, found).join(self.documents(), ["segment", "row"]).select("name", "key", "position")

    def _key_type(self) -> str:
        return self.documents().schema["key"].dataType.simpleString() if self.segments else "string"

    @staticmethod
    def _begins(m: Column, words: tuple[str, ...]) -> Column:
        """Codes at which the words begin, in the stretch that is theirs; fewest occurrences can't be known here, so in the order of the phrase."""
        none = F.array().cast("array<int>")
        out = F.coalesce(m[words[0]], none)
        for k, word in enumerate(words[1:], 1):
            out = F.array_intersect(out, _moved(F.coalesce(m[word], none), k))
        return F.filter(out, lambda c: c.bitwiseAND(_PLACE) < STRETCH)


def _moved(codes: Column, k: int) -> Column:
    return F.transform(codes, lambda c: c - k)


def build(documents: DataFrame, key: str, text: str, folder: str | None = None, buckets: int = BUCKETS) -> PostingIndex:
    """The index of all documents, in a folder of the session's shared folder where none is given."""
    spark = documents.sparkSession
    return PostingIndex(spark, folder or new_folder(spark, "postings"), buckets).add(documents, key, text)
