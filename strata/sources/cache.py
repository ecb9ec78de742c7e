"""A cache of results as a Parquet table: keys, values, expiry, hits. Reads are joins, writes replace the table's rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import staged

#: Seconds that an entry of each family of keys lives.
TTL = {"index": 7 * 86400, "llm": 3600, "search": 1800}

SCHEMA = "key string, value string, created_at timestamp, expires_at timestamp, hit_count bigint"


def lookup(requests: DataFrame, entries: DataFrame, now) -> DataFrame:
    """requests (…, key, at) with hit and value: an entry counts until it expires; ``now`` is the time of a request."""
    e = entries.select(F.col("key").alias("k"), "value", "expires_at")
    j = requests.join(e, F.col("key") == F.col("k"), "left")
    live = F.col("k").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    return j.select(*requests.columns, live.alias("hit"), F.when(live, F.col("value")).alias("value"))


def expiry(key, created_at):
    """When an entry of a key made at a time expires, by the family that the key begins with; of no family: never."""
    out = F.lit(None).cast("timestamp")
    for family, seconds in TTL.items():
        out = F.when(F.startswith(key, F.lit(f"{family}:")), created_at + F.expr(f"interval {seconds} seconds")).otherwise(out)
    return out


def evicted(entries: DataFrame, max_size: int) -> DataFrame:
    """The entries that stay when only ``max_size`` may: those of most hits, of equals the younger, then the larger key."""
    return entries.orderBy(F.col("hit_count").desc(), F.col("created_at").desc(), F.col("key").desc()).limit(max_size)


class ParquetCache:
    """get, set, delete, exists and clear over a table at ``path``; each write makes a new version, the last one counts.

    A read appends its hits beside the version, so that it costs what it found; the next write adds them up.
    """

    def __init__(self, spark: SparkSession, path: str, max_size: int | None = None):
        self.spark, self.path, self.max_size = spark, path.rstrip("/"), max_size
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def entries(self) -> DataFrame:
        have = self._versions()
        if not have:
            return self.spark.createDataFrame([], SCHEMA)
        table, hits = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{have[-1]}"), f"{self.path}/v{have[-1]}-hits"
        if not self._fs.exists(self._at(hits)):
            return table
        more = self.spark.read.schema("key string, more bigint").parquet(hits).groupBy("key").agg(F.sum("more").alias("more"))
        return table.join(more, "key", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("more", F.lit(0))).drop("more")

    def _write(self, df: DataFrame) -> None:
        old = self._versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{(old[-1] if old else 0) + 1}")
        for v in old:
            for name in (f"v{v}", f"v{v}-hits"):
                self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def set_many(self, rows: DataFrame, ttl_seconds: int | None = None) -> None:
        """Puts (key, value) rows in; entries with these keys are replaced."""
        now = F.current_timestamp()
        expires = (now + F.make_dt_interval(secs=F.lit(ttl_seconds))) if ttl_seconds else F.lit(None).cast("timestamp")
        new = rows.dropDuplicates(["key"]).select("key", "value", now.alias("created_at"), expires.alias("expires_at"), F.lit(0).cast("bigint").alias("hit_count"))
        kept = self.entries().join(new.select("key"), "key", "left_anti")
        both = kept.unionByName(new)
        if self.max_size:  # the new ones are the last to go, but more of them than there is room for don't stay either
            fresh = both.withColumn("new", F.col("created_at") == now).orderBy(F.col("new").desc(), F.col("hit_count").desc(), F.col("created_at").desc(), F.col("key").desc())
            both = fresh.limit(self.max_size).drop("new")
        self._write(both)

    def get_many(self, keys: DataFrame) -> DataFrame:
        """keys (key) with hit and value; the hits are counted."""
        have = self._versions()
        result = staged(lookup(keys, self.entries(), F.current_timestamp()), "found")  # a later write drops the version it reads
        if have:
            result.filter("hit").groupBy("key").agg(F.count(F.lit(1)).alias("more")).write.mode("append").parquet(f"{self.path}/v{have[-1]}-hits")
        return result

    def delete(self, keys: DataFrame) -> None:
        self._write(self.entries().join(keys.select("key"), "key", "left_anti"))

    def exists(self, keys: DataFrame) -> DataFrame:
        live = self.entries().filter("expires_at is null or expires_at >= current_timestamp()")
        return keys.join(live.select("key"), "key", "left_semi")

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))

    def stats(self) -> DataFrame:
        return self.entries().agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits")).withColumn("max_size", F.lit(self.max_size))


def least_hit_kept(entries: DataFrame, by: str, most: int) -> DataFrame:
    """Eviction within each group: the ``most`` entries of most hits."""
    w = W.partitionBy(by).orderBy(F.col("hit_count").desc(), F.col("created_at").desc(), F.col("key").desc())
    return entries.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")
