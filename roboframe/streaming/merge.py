"""A table that streams merge batches into: each batch makes a new version, whole or not at all, and takes effect once.

Rows lie in buckets by a hash of their key; a batch rewrites the buckets that it touches, in folders of its own. A version is
one small file in the log, which names the folder of each bucket and, for each stream, the last batch that is in it; it is
written last, under a number that must be free. A batch that comes again finds its number in the ledger and does nothing;
one that broke off before its version was written left folders that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import file_system

How = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Version:
    number: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)


def newest(keys: list[str], order: list[str]) -> How:
    """Of the rows of a key the one with the greatest order stays, be it the old one or one of the batch; of equal ones the
    first by all columns, so that the result doesn't hang on the order of rows."""

    def how(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in keys]
        rows = old.unionByName(new).groupBy(*keys)
        rows = rows.agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
        return rows.select(*keys, "_r.*").select(*old.columns)

    return how


class MergedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: list[str], buckets: int = 32):
        self.spark, self.root, self.keys, self.n = spark, root.rstrip("/"), keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.fs, self.path = file_system(spark, self.root)

    def version(self) -> Version:
        """The newest version; the empty one of a table that has none."""
        log = self.path(f"{self.root}/log")
        if not self.fs.exists(log):
            return Version()
        names = [x.getPath().getName() for x in self.fs.listStatus(log)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return Version()
        text = self.spark.read.text(self._log(max(numbers)), wholetext=True).first()[0]
        return Version(**json.loads(text))

    def _log(self, number: int) -> str:
        return f"{self.root}/log/{number:020d}.json"

    def read(self, version: Version | None = None) -> DataFrame:
        return self._rows((version or self.version()).buckets.values())

    def _rows(self, folders) -> DataFrame:
        folders = list(folders)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int, stream: str, how: How) -> bool:
        """Bring a batch of a stream into the table; whether it did anything. how(old rows, new rows) -> rows, for the buckets
        of the batch's keys together; it keeps each key in its bucket, for it makes rows of the keys it is given."""
        now = self.version()
        if now.ledger.get(stream, -1) >= number:
            return False
        own = f"{self.root}/data/{now.number + 1}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")
        batch.select(*self.schema.names).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{own}/new")
        new = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])).parquet(f"{own}/new")
        touched = sorted(str(r[0]) for r in new.select("_bucket").distinct().collect())
        old = self._rows(now.buckets[b] for b in touched if b in now.buckets)
        rows = how(old, new.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", bucket)
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{own}/all")
        there = {b for b in touched if self.fs.exists(self.path(f"{own}/all/_bucket={b}"))}
        buckets = {b: f for b, f in now.buckets.items() if b not in touched} | {b: f"{own}/all/_bucket={b}" for b in there}
        self.fs.delete(self.path(f"{own}/new"), True)
        self._commit(Version(now.number + 1, buckets, now.ledger | {stream: number}))
        return True

    def _commit(self, version: Version) -> None:
        """Write a version under its number, which must be free."""
        self.fs.mkdirs(self.path(f"{self.root}/log"))
        held, target = self.path(f"{self.root}/log/.{uuid.uuid4().hex}"), self.path(self._log(version.number))
        out = self.fs.create(held, False)
        out.write(bytearray(json.dumps(vars(version)).encode()))
        out.close()
        if self.fs.exists(target) or not self.fs.rename(held, target):
            self.fs.delete(held, False)
            raise RuntimeError(f"another writer has made version {version.number}")

    def sink(self, stream: str, how: How) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def into(batch: DataFrame, number: int) -> None:
            self.merge(batch, number, stream, how)

        return into

    def vacuum(self) -> int:
        """Delete what the newest version doesn't name: older versions and batches that broke off. Not while a batch is being
        merged or an older version is read."""
        now = self.version()
        kept = {f.rsplit("/all/", 1)[0].rsplit("/", 1)[1] for f in now.buckets.values()}
        data, gone = self.path(f"{self.root}/data"), 0
        for x in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if x.getPath().getName() not in kept:
                gone += self.fs.delete(x.getPath(), True)
        for x in self.fs.listStatus(self.path(f"{self.root}/log")) if now.number else []:
            name = x.getPath().getName()
            if name.endswith(".json") and int(name.removesuffix(".json")) < now.number:
                self.fs.delete(x.getPath(), False)
        return gone
