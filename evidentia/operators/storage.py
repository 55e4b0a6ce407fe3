"""Content-addressed objects, operation journal, leases, collection, and versions in a shared folder."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators.graph import reachable


def objects(parts: DataFrame) -> DataFrame:
    """Objects addressed by the digest of their content."""
    return parts.withColumn("object_id", F.sha2(F.concat_ws(":", F.col("p_partkey").cast("string"), "p_name"), 256))


def replay(asked: DataFrame, journal: DataFrame) -> DataFrame:
    """new, replayed (same digest) or conflict (the operation was recorded with another digest)."""
    old = journal.select("operation", F.col("digest").alias("recorded"))
    state = F.when(F.col("recorded").isNull(), "new").when(F.col("recorded") == F.col("digest"), "replayed").otherwise("conflict")
    return asked.join(old, "operation", "left").select("operation", state.alias("outcome"))


def lease_state(expires_after: Column, now: Column) -> Column:
    return F.when(expires_after <= now, "expired").otherwise("held")


def unreferenced(rows: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows that no table of references names."""
    for r in references:
        rows = rows.join(r.select(key), key, "left_anti")
    return rows


class VersionStore:
    """Immutable versions of a table below a folder, with a current pointer moved by compare and set.

    A version is a directory written once; the pointer is the last of a row of numbered
    files that name one, each created only if it is not there.  So a crash leaves the
    former version current, never none, and of two drivers that publish at a time one is
    told so (as far as the store creates files atomically).  All files go through
    Hadoop's file system, so the folder can be in any store that Spark reaches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(path.toString()).collect()))  # one small file

    def _create(self, name: str, value: dict) -> bool:
        """Write a file that must not be there; False if it is.  No file is ever changed."""
        path = self._path(f"{self.folder}/{name}")
        if self._fs.exists(path):
            return False
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError:  # another driver was first
            return False
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        return True

    def _pointers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json"))

    def _pointer(self) -> tuple[int, str | None]:
        """Number and version of the last pointer that was written to its end; one that a crash cut short counts as never written."""
        for n in reversed(self._pointers()):
            try:
                return n, self._read(f"current-{n:012d}.json")["version"]
            except (ValueError, TypeError, KeyError):
                continue
        return 0, None

    def prepare(self, df: DataFrame) -> str:
        """Write an inactive version."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/v-{version}")
        self._create(f"m-{version}.json", {"version": version, "schema": df.schema.jsonValue()})
        return version

    def validate(self, version: str) -> int:
        """Check that an inactive version reads back with its schema; returns its rows."""
        manifest = self._read(f"m-{version}.json")
        df = self.read(version)
        if manifest is None or df.schema.simpleString() != type(df.schema).fromJson(manifest["schema"]).simpleString():
            raise ValueError(f"version {version} doesn't match its manifest")
        n = df.count()
        self._create(f"ok-{version}.json", {"rows": n})
        return n

    def current(self) -> str | None:
        return self._pointer()[1]

    def activate(self, version: str, expected: str | None) -> None:
        """Move the pointer if it is where the caller expects it: pointers are numbered, and of two drivers only one can create the next."""
        if self._read(f"ok-{version}.json") is None:
            raise ValueError(f"version {version} is not validated")
        current = self.current()
        if current != expected:
            raise ValueError(f"current is {current}, expected {expected}")
        following = max(self._pointers(), default=0) + 1
        if not self._create(f"current-{following:012d}.json", {"version": version}):
            raise ValueError("another driver moved the pointer")

    def read(self, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise ValueError("nothing is published")
        return self.spark.read.parquet(f"{self.folder}/v-{version}")

    def select(self, selector: str, version: str | None = None, key: dict | None = None) -> DataFrame:
        """One consistent version by selector: current, an exact one, or the records of the current one that hold these values; a version that was never validated can't be read."""
        chosen = self.current() if selector != "exact" else version
        if selector not in ("current", "exact", "record") or chosen is None or self._read(f"ok-{chosen}.json") is None:
            raise ValueError(f"no {selector} version {chosen}")
        rows = self.read(chosen)
        for name, value in (key or {}).items():
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        return rows

    def versions(self) -> list[str]:
        return sorted(s.getPath().getName()[2:] for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith("v-"))

    def collect(self, retained: set[str], most: int) -> tuple[list[str], bool]:
        """Delete at most ``most`` versions that are neither current nor retained, in order; whether more are left."""
        dead = [v for v in self.versions() if v not in retained | {self.current()}]
        for v in dead[:most]:
            self._fs.delete(self._path(f"{self.folder}/v-{v}"), True)
            for name in ("m", "ok"):
                self._fs.delete(self._path(f"{self.folder}/{name}-{v}.json"), False)
        return dead[:most], len(dead) > most


def write_batch(store: DataFrame, batch: DataFrame) -> DataFrame:
    """(batch_id, name, outcome) of mutations (batch_id, name, expected, digest) against a catalogue (name, digest).

    ``expected`` null means that the name must be absent, else it must hold exactly that
    digest.  A batch is applied as a whole: one conflict, or one name twice, and none of
    its mutations is; unchanged says that the name held the new digest already.
    """
    rows = batch.join(store.select("name", F.col("digest").alias("held")), "name", "left")
    twice = batch.groupBy("batch_id", "name").agg((F.count(F.lit(1)) > 1).alias("twice"))
    rows = rows.join(twice, ["batch_id", "name"])
    own = F.when(F.col("twice"), "repeated").when(~F.col("held").eqNullSafe(F.col("expected")), "conflict").when(F.col("held").eqNullSafe(F.col("digest")), "unchanged").otherwise("written")
    rows = rows.withColumn("own", own)
    bad = rows.groupBy("batch_id").agg(F.bool_or(F.col("own").isin("conflict", "repeated")).alias("bad"))
    rows = rows.join(bad, "batch_id")
    return rows.select("batch_id", "name", F.when(F.col("bad") & F.col("own").isin("written", "unchanged"), "rolled_back").otherwise(F.col("own")).alias("outcome"))


def lease_outcomes(leases: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, outcome, expires_after) of requests (request_id, resource, holder, action, now, seconds), one for each resource, against leases (resource, holder, expires_after).

    acquire: granted where nobody holds it any more, extended for its own holder, else
    refused.  renew: extended for its holder before it expires, else lost.  release:
    released by its holder, else not_held.
    """
    rows = requests.join(leases.select("resource", F.col("holder").alias("by"), F.col("expires_after").alias("until")), "resource", "left")
    live = F.col("by").isNotNull() & (F.col("until") > F.col("now"))
    mine = live & (F.col("by") == F.col("holder"))
    outcome = (
        F.when(F.col("action") == "acquire", F.when(mine, "extended").when(live, "refused").otherwise("granted"))
        .when(F.col("action") == "renew", F.when(mine, "extended").otherwise("lost"))
        .when(F.col("action") == "release", F.when(mine, "released").otherwise("not_held"))
        .otherwise("unknown_action")
    )
    return rows.withColumn("outcome", outcome).select("request_id", "outcome", F.when(F.col("outcome").isin("granted", "extended"), F.col("now") + F.col("seconds")).alias("expires_after"))


def retained(roots: DataFrame, references: DataFrame) -> DataFrame:
    """(generation, reason) of what must stay: roots (generation, reason) and all that they refer to (src, dst), by the least reason; reason referenced for what is no root itself."""
    held = reachable(references, roots.select(F.col("generation").alias("node_id")))
    named = roots.groupBy(F.col("generation").alias("node_id")).agg(F.min("reason").alias("reason"))
    return held.join(named, "node_id", "left").select(F.col("node_id").alias("generation"), F.coalesce("reason", F.lit("referenced")).alias("reason"))


def collection_plan(generations: DataFrame, protected: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(generation, bytes, total) of what a collection deletes next: unprotected ones in order, at most ``most`` of them and no more than ``most_bytes`` in sum; the first one that doesn't fit ends the plan."""
    dead = generations.join(protected.select("generation"), "generation", "left_anti").orderBy("generation").limit(most)
    total = F.sum("bytes").over(Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0))  # over at most ``most`` rows
    return dead.withColumn("total", total).where(F.col("total") <= most_bytes)


def recovery_scan(catalogue: DataFrame, found: DataFrame, now: int, grace: int) -> DataFrame:
    """(name, state) of what a crash may have left: entries (name, digest) against files (name, digest, written, temporary).

    missing: catalogued, not there; digest_mismatch; orphan: there, not catalogued, older
    than the grace period; recent: the same, but a writer may still be at work;
    stale_temporary; else intact.
    """
    rows = catalogue.select("name", F.col("digest").alias("expected"), F.lit(True).alias("listed")).join(found, "name", "full")
    old = F.col("written") < now - grace
    state = (
        F.when(F.col("temporary") & old, "stale_temporary").when(F.col("temporary"), "recent").when(F.col("digest").isNull(), "missing")
        .when(F.col("listed").isNull() & old, "orphan").when(F.col("listed").isNull(), "recent").when(F.col("digest") != F.col("expected"), "digest_mismatch").otherwise("intact")
    )
    return rows.select("name", state.alias("state"))
