"""Stored tables: Parquet buckets under a manifest, or a catalog whose tables can MERGE."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: A bucket is merged when so many changes lie on it; buckets are doubled when they hold more than so many bytes on average.
MOST_CHANGES, BUCKET_BYTES = 8, 256 << 20


def scratch_root(spark: SparkSession) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or a temporary one of a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/ledger-{uuid.uuid4().hex}"


class ParquetStore:
    """Tables under a root folder. A table is the files that its manifest names; a commit replaces the manifest.

    Rows lie in hash buckets of the key. An upsert writes its rows alone, as a change on each bucket that it touches;
    a reader puts the latest change over what lies below, so a load costs what it brings, not what is stored. A bucket
    with more than MOST_CHANGES is merged by the upsert that finds it so. The number of buckets doubles as a table grows past
    BUCKET_BYTES a bucket. A table whose first layout column belongs to its key is partitioned by that column instead: a
    load touches the values that it brings, and read() can be given those it is to open. A reader sees the manifest before or after a commit, never a mixture; files that a commit
    leaves out are removed by the commit after it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, table: str) -> dict | None:
        fs, path = self._fs(f"{self.root}/{table}/_manifest.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, table: str, schema: T.StructType, files: dict[str, list[str]], keys: list[str], buckets: int, old: dict | None, merged: dict[str, list[str]] | None = None, partition: str | None = None) -> None:
        """Make files the table's: {bucket: paths, oldest first}. merged: those that this commit has merged into them."""
        now = {p for of in files.values() for p in of}
        retired = sorted({p for held in ((old or {}).get("files", {}), merged or {}) for of in held.values() for p in of} - now)
        fs, path = self._fs(f"{self.root}/{table}/_manifest.json")
        _, draft = self._fs(f"{self.root}/{table}/_manifest-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"schema": schema.jsonValue(), "files": files, "keys": keys, "buckets": buckets, "partition": partition, "retired": retired}).encode()))
        stream.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else self.spark._jvm.java.net.URI("file:///"), self.spark._jsc.hadoopConfiguration())
        renames = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = options
        context.rename(draft, path, renames)
        for gone in (old or {}).get("retired", []):  # a reader of the manifest before this one may still hold those of `old`
            fs.delete(self._fs(gone)[1], True)

    def exists(self, table: str) -> bool:
        return self._manifest(table) is not None

    def read(self, table: str, only: list[str] | None = None) -> DataFrame:
        """The table's rows; only: of a partitioned table, the values of its partition column to read, as texts."""
        held = self._manifest(table)
        if held is None:
            raise LookupError(f"no table {table!r}")
        if only is not None and not held.get("partition"):
            raise ValueError(f"{table} is not partitioned")
        return self._read(held, held["files"] if only is None else {b: of for b, of in held["files"].items() if b in only})

    def _read(self, held: dict, files: dict[str, list[str]]) -> DataFrame:
        schema, keys = T.StructType.fromJson(held["schema"]), held["keys"]
        load = lambda paths: self.spark.read.schema(schema).parquet(*paths)
        first = [of[0] for of in files.values()]
        later = [p for of in files.values() for p in of[1:]]
        if not first:
            return self.spark.createDataFrame([], schema)
        if not keys or not later:
            return load(first + later)
        # A change's folder is named by the time of its write; of a key's changes the last counts.
        folder = F.regexp_extract("_metadata.file_path", r"/data-(\d+)-", 1)
        changes = load(later).withColumn("__at", folder)
        known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__at").desc()))
        newest = changes.where(known).withColumn("__n", rank).where("__n = 1").drop("__n", "__at")
        below = load(first).join(newest.select(*keys), list(keys), "left_anti").select(*schema.names)
        return below.unionByName(newest.select(*schema.names)).unionByName(changes.where(~known).select(*schema.names))

    def create(self, table: str, schema: T.StructType, keys: list[str] = ()) -> None:
        if not self.exists(table):
            self._commit(table, schema, {}, list(keys), self.buckets, None)

    def _write(self, table: str, df: DataFrame, keys: list[str], sort: list[str], buckets: int, partition: str | None = None, split: int = 8) -> dict[str, list[str]]:
        """Bucket folders that df has been written to. Files are sorted by the layout columns, so their statistics prune."""
        path = f"{self.root}/{table}/data-{time.time_ns():020d}-{uuid.uuid4().hex}"
        by_key = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)
        out = df.withColumn("__b", F.coalesce(F.col(partition).cast("string"), F.lit("none")) if partition else by_key)
        spread = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(split)) if keys else None
        out = out.repartition("__b", spread) if keys else out
        out.sortWithinPartitions("__b", *sort).write.partitionBy("__b").parquet(path)
        fs, p = self._fs(path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {unquote(n.removeprefix("__b=")): [f"{path}/{n}"] for n in names if n.startswith("__b=")}

    def _bytes(self, files: dict[str, list[str]]) -> int:
        total = 0
        for path in (p for of in files.values() for p in of):
            fs, p = self._fs(path)
            total += fs.getContentSummary(p).getLength()
        return total

    def replace(self, table: str, df: DataFrame, keys: list[str] = (), sort: list[str] = ()) -> None:
        old = self._manifest(table)
        buckets, partition = (old or {}).get("buckets", self.buckets), next((c for c in sort[:1] if c in keys), None)
        files = self._write(table, df, list(keys), list(sort), buckets, partition, split=1 if partition else 8)
        self._commit(table, df.schema, files, list(keys), buckets, old, partition=partition)

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to a table without keys."""
        held = self._manifest(table) or {"files": {}, "keys": [], "buckets": self.buckets}
        if held["keys"]:
            raise ValueError(f"{table} has keys {held['keys']}: rows are upserted into it")
        files = dict(held["files"])
        for b, paths in self._write(table, df, [], [], held["buckets"]).items():
            files[b] = files.get(b, []) + paths
        self._commit(table, df.schema, files, [], held["buckets"], held)

    def upsert(self, table: str, source: DataFrame, keys: list[str], sort: list[str] = ()) -> None:
        """Rows of source replace those of equal keys, and others are added. Keys occur once in source; null keys never match."""
        held, keys = self._manifest(table), list(keys)
        if held is None or not held["files"]:
            return self.replace(table, source, keys, sort)
        if held["keys"] != keys:
            raise ValueError(f"{table} is bucketed by {held['keys']}")
        schema, buckets, partition = T.StructType.fromJson(held["schema"]), held.get("buckets", self.buckets), held.get("partition")
        files = dict(held["files"])
        write = lambda df, split: self._write(table, df.select(*schema.names), keys, list(sort), buckets, partition, split)
        for b, paths in write(source, 1).items():
            files[b] = files.get(b, []) + paths
        size, written = 0 if partition else self._bytes(files), dict(files)
        if size > 2 * buckets * BUCKET_BYTES:
            while size > buckets * BUCKET_BYTES:
                buckets *= 2
            files = write(self._read(held, files), 8)
        elif full := {b: of for b, of in files.items() if len(of) > MOST_CHANGES + 1}:
            files |= write(self._read(held, full), 1 if partition else 8)
        self._commit(table, schema, files, keys, buckets, held, written, partition)


class CatalogStore:
    """Tables of a catalog with row-level operations (a lakehouse format): the same operations by its own MERGE."""

    def __init__(self, spark: SparkSession, namespace: str, provider: str):
        self.spark, self.namespace, self.provider = spark, namespace, provider

    def _name(self, table: str) -> str:
        return ".".join(f"`{p.replace('`', '``')}`" for p in [*self.namespace.split("."), table])

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._name(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def create(self, table: str, schema: T.StructType, keys: list[str] = ()) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self._name('').rsplit('.', 1)[0]}")
        if not self.exists(table):
            self.spark.createDataFrame([], schema).writeTo(self._name(table)).using(self.provider).create()

    def replace(self, table: str, df: DataFrame, keys: list[str] = (), sort: list[str] = ()) -> None:
        writer = df.writeTo(self._name(table)).using(self.provider)
        (writer.partitionedBy(*map(F.col, sort)) if sort else writer).createOrReplace()

    def append(self, table: str, df: DataFrame) -> None:
        df.writeTo(self._name(table)).append()

    def upsert(self, table: str, source: DataFrame, keys: list[str], sort: list[str] = ()) -> None:
        on = [F.col(f"source.{k}") == F.col(f"{self._name(table)}.{k}") for k in keys]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        source.alias("source").mergeInto(self._name(table), condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()
