"""Keyed collections with versions, written by buckets of keys; and JSON sources and sinks.

A collection lives under one folder. ``data/<write>/_bucket=<n>`` holds the rows of one bucket of keys, as one write left
them; such a folder is never changed. ``versions/<id>`` lists, for each bucket that has rows, the folder that holds them.
``manifest/<number>`` holds one JSON line, a publication: the last one names the version that readers see. So an upsert
reads and writes the buckets of its keys and takes over the others, a publication is one small file, and a failed run
changes nothing. ``vacuum`` removes what no kept publication reaches, ``changes`` compares two versions by the buckets in
which they differ. All paths go through Spark, so any file system that it reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import last_per_key, rebuilt, upsert

MANIFEST = "number long, version string, reason string, rows long, at string, streams map<string,long>"
LISTING = "bucket int, folder string, rows long, schema string"
BUCKET = "_bucket"


class Files:
    """Folders of one file system, as Hadoop sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self, path: str) -> dict[str, int]:
        """Names in a folder with their time of change in milliseconds; none where the folder is not there."""
        if not self.system.exists(self.make(path)):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self.system.listStatus(self.make(path))}

    def remove(self, path: str) -> None:
        self.system.delete(self.make(path), True)


class Collection:
    """A keyed table with versions. ``buckets`` counts for the first version; later ones keep it.

    A bucket should hold what one task can rewrite, some hundred megabytes: 100 TB ask for some hundred thousand."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.files = Files(spark, self.path)

    # Publications

    def manifest(self) -> DataFrame:
        if not self.files.listed(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/*")

    def current(self):
        """The last publication, or None; only its own file is read."""
        numbers = [n for n in self.files.listed(f"{self.path}/manifest") if n.isdigit()]
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/{max(numbers)}").first() if numbers else None

    def publish(self, version: str, reason: str, at: str, streams: dict[str, int] | None = None) -> int:
        """Make a staged version the current one; returns its number. ``streams`` tells the last batch of each stream that the
        version holds; by default it is that of the current version."""
        last = self.current()
        number = (last["number"] if last else 0) + 1
        rows = self.listing(version).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        streams = (last["streams"] or {} if last else {}) if streams is None else streams
        entry = self.spark.createDataFrame([(number, version, reason, rows, at, streams)], MANIFEST)
        entry.coalesce(1).write.json(f"{self.path}/manifest/{number:09d}")
        return number

    def has_backup(self) -> bool:
        return len(self.files.listed(f"{self.path}/manifest")) > 1

    def restore(self, at: str, steps: int = 1) -> int:
        """Publish the version of ``steps`` publications ago again, with what it held of each stream."""
        entries = self.manifest().orderBy(F.desc("number")).limit(steps + 1).collect()
        if len(entries) <= steps:
            raise LookupError("there is no earlier version")
        return self.publish(entries[steps]["version"], f"restore {entries[steps]['number']}", at, entries[steps]["streams"] or {})

    # Versions

    def listing(self, version: str) -> DataFrame:
        """LISTING: the folder of each bucket; one row with neither where a version is empty."""
        return self.spark.read.schema(LISTING).json(f"{self.path}/versions/{version}")

    def _folders(self, version: str) -> tuple[list, str]:
        """Bucket and folder pairs of a version, a few bytes a bucket, and its schema."""
        rows = self.listing(version).collect()
        return [r for r in rows if r["folder"]], rows[0]["schema"]

    def _load(self, folders: list, schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{r['folder']}" for r in folders))

    def read(self, version: str | None = None) -> DataFrame | None:
        entry = self.current() if version is None else None
        version = version or (entry["version"] if entry else None)
        return self._load(*self._folders(version)) if version else None

    def _bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, buckets: int) -> list[tuple]:
        """Writes rows by bucket; (bucket, folder, rows) of each that has some. Adaptive execution splits large buckets."""
        write = f"data/{uuid.uuid4().hex}"
        df.withColumn(BUCKET, self._bucket_of(buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{write}")
        if not any(n.startswith(BUCKET) for n in self.files.listed(f"{self.path}/{write}")):
            return []
        counts = self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/{write}").groupBy(BUCKET).count().collect()
        return [(r[BUCKET], f"{write}/{BUCKET}={r[BUCKET]}", r["count"]) for r in counts]

    def _list(self, folders: list[tuple], schema: str, buckets: int) -> str:
        version = uuid.uuid4().hex
        rows = [(*f, schema) for f in folders] or [(None, None, 0, schema)]
        listing = self.spark.createDataFrame(rows, LISTING).withColumn("buckets", F.lit(buckets))
        listing.coalesce(1).write.json(f"{self.path}/versions/{version}")
        return version

    def _buckets(self, version: str) -> int:
        return self.spark.read.schema("buckets int").json(f"{self.path}/versions/{version}").first()[0]

    def stage(self, df: DataFrame) -> str:
        """Write a whole version that nobody reads yet."""
        last = self.current()
        buckets = self._buckets(last["version"]) if last else self.buckets
        return self._list(self._write(df, buckets), df.schema.json(), buckets)

    def stage_upsert(self, delta: DataFrame, order: str | None = None) -> str:
        """Write a version in which rows of ``delta`` replace those of their keys or are added; nobody reads it yet.

        The delta is written by buckets first, so it is computed once and its buckets are known. Buckets that it has no key of
        stay as they are; the others are read, merged and written."""
        last = self.current()
        if last is None:
            return self.stage(last_per_key(delta, self.key, order) if order else delta)
        buckets = self._buckets(last["version"])
        folders, schema = self._folders(last["version"])
        names = [f["name"] for f in json.loads(schema)["fields"]]
        fresh = (last_per_key(delta, self.key, order) if order else delta).select(names)
        came = self._write(fresh, buckets)
        touched = {f[0] for f in came}
        base = self._load([r for r in folders if r["bucket"] in touched], schema)
        # Keys of several buckets do not meet, so one join serves all of them.
        merged = upsert(base, self.spark.read.schema(base.schema).parquet(*(f"{self.path}/{f[1]}" for f in came)), self.key) if came else base
        kept = [(r["bucket"], r["folder"], r["rows"]) for r in folders if r["bucket"] not in touched]
        version = self._list(kept + (self._write(merged, buckets) if came else []), schema, buckets)
        for write in {f[1].split("/")[1] for f in came}:
            self.files.remove(f"{self.path}/data/{write}")
        return version

    def upsert(self, delta: DataFrame, reason: str, at: str, order: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Replace and add rows by key, and publish. ``stream``: the name of a stream and the number of the batch."""
        version = self.stage_upsert(delta, order)
        last = self.current()
        streams = dict(last["streams"] or {}) if last else {}
        return self.publish(version, reason, at, streams | ({stream[0]: stream[1]} if stream else {}))

    def rebuild(self, old: DataFrame, enriched: DataFrame, at: str, content: str = "content") -> int:
        """Start anew from old chunks and enriched ones, and publish; the versions before stay for a restore."""
        return self.publish(self.stage(rebuilt(old, enriched, self.key, content)), "rebuild", at)

    def reset(self, at: str) -> int:
        """Publish an empty version of the same columns, which holds nothing of any stream."""
        return self.publish(self.stage(self.read().limit(0)), "reset", at, {})

    # Changes and retention

    def changes(self, older: str | None, newer: str) -> DataFrame:
        """(key, change: added, changed or removed) from one version to another, by a hash of each row's content.

        Only buckets whose folders differ are read. ``older`` None is the empty version. Keys are unique and not null."""
        after, schema = self._folders(newer)
        before, old_schema = self._folders(older) if older else ([], schema)
        same = {r["folder"] for r in before} & {r["folder"] for r in after}
        columns = sorted(f["name"] for f in json.loads(schema)["fields"])
        hashed = lambda folders, kind, name: self._hashed([r for r in folders if r["folder"] not in same], kind, columns).withColumnRenamed("hash", name)
        both = hashed(before, old_schema, "was").join(hashed(after, schema, "is"), self.key, "full_outer")
        change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
        return both.select(self.key, change.alias("change")).where("change is not null")

    def _hashed(self, folders: list, schema: str, columns: list[str]) -> DataFrame:
        rows = self._load(folders, schema)
        known = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns]
        return rows.select(self.key, F.md5(F.to_json(F.struct(*known))).alias("hash"))

    def vacuum(self, keep: int, grace_seconds: float, now: float) -> list[str]:
        """Retention: the last ``keep`` publications stay; publications before them, versions that none of these names, and
        folders of buckets that no kept version lists go, if they are older than the grace period (which spares staged
        versions of jobs that still run). ``now`` is in seconds since 1970. Returns what was removed.

        What comes to the driver are names of folders, a few bytes a bucket and version, no rows."""
        limit = (now - grace_seconds) * 1000
        entries = self.manifest().select("number", "version").orderBy(F.desc("number")).collect()
        kept = {e["version"] for e in entries[:keep]}
        versions = self.files.listed(f"{self.path}/versions")
        young = {v for v, at in versions.items() if at > limit}
        reached = set()
        if stay := [f"{self.path}/versions/{v}" for v in versions if v in kept | young]:
            reached = {r[0] for r in self.spark.read.schema(LISTING).json(stay).where("folder is not null").select("folder").distinct().collect()}
        gone = [f"manifest/{e['number']:09d}" for e in entries[keep:]]
        gone += [f"versions/{v}" for v in versions if v not in kept | young]
        for write, at in self.files.listed(f"{self.path}/data").items():
            if at > limit:
                continue
            inside = [f"data/{write}/{b}" for b in self.files.listed(f"{self.path}/data/{write}") if b.startswith(BUCKET)]
            lost = [f for f in inside if f not in reached]
            gone += [f"data/{write}"] if len(lost) == len(inside) else lost
        for path in gone:
            self.files.remove(f"{self.path}/{path}")
        return gone


def load_arrays(spark: SparkSession, path: str, embedding: str = "array<double>", metadata: str = "map<string,string>") -> DataFrame:
    """A collection kept as one JSON object of parallel arrays (ids, documents, metadatas, embeddings) as rows."""
    schema = f"ids array<string>, documents array<string>, metadatas array<{metadata}>, embeddings array<{embedding}>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode(F.arrays_zip("ids", "documents", "metadatas", "embeddings")).alias("r")).select(
        F.col("r.ids").alias("id"), F.col("r.documents").alias("document"), F.col("r.metadatas").alias("metadata"), F.col("r.embeddings").alias("embedding")
    )


def newest_json(spark: SparkSession, pattern: str, schema: str, nested: str) -> DataFrame:
    """Rows of the nested array in the newest of the files, by modification time."""
    files = spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_path"))
    last = files.agg(F.max(F.struct("_at", "_path")).alias("m")).first()["m"]
    return files.where(F.col("_path") == (last["_path"] if last else None)).select(F.explode(nested).alias("r")).select("r.*")


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)
