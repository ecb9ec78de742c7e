"""Operator 8: a two-pass external shuffle into shards.

First pass: records are scattered by a seeded hash of all their columns into buckets small enough for memory; their
number follows from the bytes there are, and so does that of the partitions they go to. Second pass: each bucket is put
into a Fisher-Yates order by a generator seeded with the bucket's number, and its records get their places in one order
of all records. The shards are equal runs of that order, so that their counts differ by one at most (law ``rows``).
The order depends on seed and records alone, not on partitions, tasks, retries or the order of rows.

Defined results: a null text has no bytes (size 8); a null id is hashed like any other; rows that agree in all columns
fall into one bucket and can't be told apart; rows that tie in id and text are told apart by their other columns; a very
long text makes its bucket as much larger; with no rows there are no shards; all columns are kept, new ones get the names
asked for (``shard``, ``slot``) and a clash, in any case, raises ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh

BUCKET_BYTES = 24 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    """A uniform order of range(n)."""
    order = list(range(n))
    draws = rng.integers(0, np.arange(1, n + 1)) if n else []
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(df: DataFrame, shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The rows of ``df`` with the shard each goes to and its place in there."""
    if {shard.lower(), slot.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {shard} or {slot} already")
    spark = df.sparkSession
    h, b = fresh(df, "hash"), fresh(df, "bucket")
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()
    schema = T.StructType([*df.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])
    if not n:
        return spark.createDataFrame([], schema)
    buckets = max(-(-size // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = lambda c, kind: F.to_json(F.array_sort(F.map_entries(c))) if kind.startswith("map<") else F.col(c)  # noqa: E731 (maps have no hash)
    hashed = df.withColumn(h, F.xxhash64(F.lit(seed), *[plain(c, kind) for c, kind in df.dtypes]))
    dealt = hashed.withColumn(b, F.pmod(F.col(h), F.lit(buckets)))
    counts = np.zeros(buckets, np.int64)  # 8 bytes for each bucket of bucket_bytes
    for k, c in dealt.groupBy(b).count().toLocalIterator():
        counts[k] = c
    first = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(counts)[:-1]]))
    own = df.columns

    def second(table: pa.Table) -> pa.Table:
        k = table.column(b)[0].as_py()
        steady = pc.sort_indices(table.select([key, h]), sort_keys=[(key, "ascending"), (h, "ascending")])  # whatever order tasks sent rows in
        order = steady.take(pa.array(fisher_yates(table.num_rows, np.random.default_rng([seed, k])), pa.int64()))
        out = table.select(own).take(order)
        rank = int(first.value[k]) + np.arange(table.num_rows)
        to = rank * shards // n
        return out.append_column(shard, pa.array(to.astype(np.int32))).append_column(slot, pa.array(rank - -(-to * n // shards)))

    return dealt.repartition(buckets, b).groupBy(b).applyInArrow(second, schema)


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder of Parquet files for each shard, in the shuffled order."""
    shuffled.repartition(shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(documents(spark, sf_dir).select("doc_id", "text"), 24)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_external_shuffle": query}
ORACLES: dict = {}
