"""Keyed tables that change by whole keys, one atomic commit at a time.

A store is a folder: Parquet in ``version=N-...`` (what commit N replaced) and ``snapshot=N`` (all that was live
before it), and ``commits/N.json`` that names the live folders. Data is written first; the commit's
name appears by one rename, so a job that dies leaves the old state. Readers merge: of each key, the newest version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a rebalanced partition follow spark.sql.adaptive.advisoryPartitionSizeInBytes.
BUCKETS, COMPACT_EVERY = 64, 32


class Store:
    """Tables of one key: ``tables`` maps names to schemas, all of which hold the columns of ``key``.

    Keys may not be null. One writer at a time: a second one's commit fails, and it may try again.
    """

    def __init__(self, spark: SparkSession, path: str, key: Iterable[str], tables: dict[str, T.StructType | str], buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.key, self.buckets, self.compact_every = spark, path.rstrip("/"), list(key), buckets, compact_every
        self.tables = {n: T._parse_datatype_string(s) if isinstance(s, str) else s for n, s in tables.items()}
        self.tables["_keys"] = T.StructType([f for f in next(iter(self.tables.values())).fields if f.name in self.key])
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # -- files -----------------------------------------------------------------------------------

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._files().listStatus(at)) if self._files().exists(at) else []

    def state(self) -> dict:
        """The newest commit: version, tag and parts; version -1 without any."""
        names = [n for n in self._names("commits") if n.endswith(".json")]
        if not names:
            return {"version": -1, "tag": None, "parts": []}
        stream = self._files().open(self._at(f"commits/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """The commit appears whole or not at all; another of the same number makes it fail."""
        name = f"commits/{state['version']:012d}.json"
        draft = self._at(f"commits/.{uuid.uuid4().hex}")
        out = self._files().create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        rename = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        target = self._files().makeQualified(self._at(name))
        self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._files().makeQualified(draft), target, how)

    def _forget(self, below: int) -> None:
        """Folders and commits of numbers below ``below``; nothing reads them but readers of commits before the last two snapshots."""
        for name in self._names(""):
            kind, _, number = name.partition("=")
            if kind in ("version", "snapshot") and int(number[:12]) < below:
                self._files().delete(self._at(name), True)
        for name in self._names("commits"):
            if name.endswith(".json") and int(name[:12]) < below:
                self._files().delete(self._at(f"commits/{name}"), False)

    # -- rows ------------------------------------------------------------------------------------

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, table: str, folder: str, version: F.Column) -> None:
        names = self.tables[table].names
        out = rows.select(*names, version.alias("_version"), self.bucket().alias("_bucket"))
        # a bucket is one file where it is small and several where it is large, hot keys included
        out.hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}/{table}")

    def _parts(self, table: str, parts: list[str], buckets: list[int] | None) -> DataFrame:
        fields = [*self.tables[table].fields, T.StructField("_version", T.LongType()), T.StructField("_bucket", T.IntegerType())]
        schema, rows = T.StructType(fields), None
        for p in parts:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{p}/{table}")
            part = part if buckets is None else part.where(F.col("_bucket").isin(buckets))
            rows = part if rows is None else rows.unionByName(part)
        return (self.spark.createDataFrame([], schema) if rows is None else rows).drop("_bucket")

    def _live(self, table: str, parts: list[str], buckets: list[int] | None) -> DataFrame:
        rows = self._parts(table, parts, buckets)
        if len(parts) < 2:
            return rows
        newest = self._parts("_keys", parts, buckets).groupBy(*self.key).agg(F.max("_version").alias("_version"))
        return rows.join(newest.hint("merge"), [*self.key, "_version"], "left_semi")

    def read(self, table: str, buckets: list[int] | None = None, version: bool = False) -> DataFrame:
        """The live rows of a table; of some buckets only, if given. ``version`` adds _version, the commit they are from."""
        live = self._live(table, self.state()["parts"], buckets)
        return live if version else live.drop("_version")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: so many numbers at most."""
        return [r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def replace(self, rows: dict[str, DataFrame], keys: DataFrame, tag: int | str | None = None) -> int:
        """Replace all rows of ``keys`` in all tables by ``rows`` (of these keys; none: deleted) and commit; returns the version.

        Tables that aren't named lose the rows of the keys too. A commit whose ``tag`` is the last one's has
        happened already and changes nothing. Every ``compact_every`` commits a snapshot of all that is live is
        written, which bounds what a reader merges, and folders before the last snapshot but one go.
        """
        before = self.state()
        if tag is not None and before["tag"] == tag:
            return before["version"]
        number = before["version"] + 1
        folder, parts = f"version={number:012d}-{uuid.uuid4().hex[:8]}", before["parts"]
        self._write(keys.select(*self.key).distinct(), "_keys", folder, F.lit(number).cast("long"))
        for name, schema in self.tables.items():
            if name != "_keys":
                given = rows[name] if name in rows else self.spark.createDataFrame([], schema)
                self._write(given, name, folder, F.lit(number).cast("long"))
        if number and number % self.compact_every == 0:
            snapshot = f"snapshot={number:012d}"
            for name in self.tables:
                self._write(self._live(name, parts, None), name, snapshot, F.col("_version"))
            parts = [snapshot]
        self._commit({"version": number, "tag": tag, "parts": [*parts, folder]})
        if parts != before["parts"]:
            self._forget(number - self.compact_every)
        return number
