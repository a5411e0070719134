"""Streams into keyed and first-seen tables, and streams drained once.

Output of a micro-batch goes to a place named by its number, so a batch which is run again replaces
its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.ranking import first_per_key
from tidemark.operators.trend import bucket_spans
from tidemark.session import new_state_dir


#: Buckets by key of the tables which are merged when read.
BUCKETS = 32
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks_db(spark: SparkSession) -> None:
    """State on local disk, of which a batch writes its changes only."""
    spark.conf.set(STORE, ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over parquet files of one layout; a path to a single file works too."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # the last letter as a pattern, since a stream source wants a folder or a pattern
    return reader.parquet(f"{path[:-1]}[{path[-1]}]" if path.endswith(".parquet") else path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> list:
    """Run a stream over everything which is there now; the progress of its batches."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", new_state_dir(spark, "stream"))
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()
    return list(query.recentProgress)


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def _with_bucket(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


# ---- first seen ------------------------------------------------------------------------------
def first_seen(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, as the batch that brings it arrives: write it in ``update`` mode.

    Within a batch the first by ``order`` counts, across batches the first to arrive. What was seen lies in the state store by
    key, so a batch touches the keys it brings and no history; rows of a repeated key combine before the shuffle.
    """
    rocks_db(stream.sparkSession)
    rest = [c for c in stream.columns if c not in (*keys, *order)]
    first = F.min(F.struct("_at", *order, F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))).alias("_first")
    held = stream.withColumn("_at", F.current_timestamp()).groupBy(*keys).agg(first)
    # a key that was there before is in the batch too, but with the moment of an earlier one
    fresh = held.filter(F.col("_first._at") == F.current_timestamp())
    return fresh.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order], *[F.col(f"_first._rest.{c}").alias(c) for c in rest]).select(
        stream.columns)


def seen_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


# ---- keyed tables ----------------------------------------------------------------------------
#: Deltas of a bucket after which it is written anew.
DELTAS = 16
ABOUT = "keys array<string>, keep_if_null array<string>, fields array<string>"


def upsert_into(
    path: str, initial: DataFrame | None, keys: Sequence[str], order: Sequence[Column], keep_if_null: Sequence[str] = (), deltas: int = DELTAS
) -> Callable[[DataFrame, int], None]:
    """A keyed table that is merged when it is read; of a key's rows in a batch the first in order counts.

    A batch writes its own rows only, in buckets by key. A bucket with as many deltas as ``deltas`` is written anew with all its
    rows; what lies below the version before goes, so readers of the last two versions lose nothing. A batch that
    is run again replaces its delta and the versions it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = _with_bucket(first_per_key(batch, keys, order) if order else batch, keys)
        if number == 0:
            about = [(list(keys), list(keep_if_null), [c for c in rows.columns if c not in (*keys, "_bucket")])]
            spark.createDataFrame(about, ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
            start = rows.limit(0) if initial is None else _with_bucket(initial, keys).select(rows.columns)
            start.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/base/upto=-1")
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/delta/batch={number}")
        _compact(spark, path, rows.schema, number, deltas)

    return each


def _parts(spark: SparkSession, path: str, schema: StructType, last: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Newest base of each bucket (one row a bucket), all bases and all deltas, with those of batches up to ``last``."""
    base = spark.read.schema(StructType([*schema.fields]).add("upto", "integer")).parquet(f"{path}/base")
    delta = spark.read.schema(StructType([*schema.fields]).add("batch", "integer")).parquet(f"{path}/delta")
    if last is not None:
        base, delta = base.filter(F.col("upto") < last), delta.filter(F.col("batch") <= last)
    newest = base.groupBy("_bucket").agg(F.max("upto").alias("_upto"))  # at most BUCKETS rows
    return newest, base, delta


def _merged(newest: DataFrame, base: DataFrame, delta: DataFrame, keys: Sequence[str], fields: Sequence[str], keep_if_null: Sequence[str]) -> DataFrame:
    """One row per key: the newest base and the deltas after it, in one aggregate."""
    few = F.broadcast(newest)
    old = base.join(few, "_bucket").filter(F.col("upto") == F.col("_upto")).withColumn("_seq", F.col("upto")).drop("upto", "_upto")
    new = delta.join(few, "_bucket", "left").filter(F.col("batch") > F.coalesce("_upto", F.lit(-1))).withColumn(
        "_seq", F.col("batch")).drop("batch", "_upto")

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c)

    whole = [c for c in fields if c not in keep_if_null]
    rows = old.unionByName(new).groupBy("_bucket", *keys).agg(
        F.max_by(F.struct(F.lit(0).alias("_"), *whole), "_seq").alias("_last"), *[latest(c) for c in keep_if_null])
    return rows.select("_bucket", *keys, *[F.col(f"_last.{c}").alias(c) if c in whole else F.col(c) for c in fields])


def _compact(spark: SparkSession, path: str, schema: StructType, number: int, deltas: int) -> None:
    newest, base, delta = _parts(spark, path, schema, number)
    files = delta.select("_bucket", "batch").distinct().join(F.broadcast(newest), "_bucket", "left")
    open_ = files.filter(F.col("batch") > F.coalesce("_upto", F.lit(-1))).groupBy("_bucket").agg(F.count("*").alias("n"))
    due = [r["_bucket"] for r in open_.filter(F.col("n") >= deltas).collect()]  # at most BUCKETS
    if not due:
        return
    about = spark.read.parquet(f"{path}/about").first()
    mine = lambda df: df.filter(F.col("_bucket").isin(due))
    merged = _merged(mine(newest), mine(base), mine(delta), about["keys"], about["fields"], about["keep_if_null"])
    merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/base/upto={number}")
    # the version before stays readable: what lies below it goes
    gone = mine(files).filter(F.col("batch") <= F.col("_upto")).select(
        F.concat(F.lit("delta/batch="), F.col("batch").cast("string")).alias("at"), "_bucket")
    older = mine(base).select("_bucket", "upto").distinct().join(F.broadcast(newest), "_bucket").filter("upto < _upto").select(
        F.concat(F.lit("base/upto="), F.col("upto").cast("string")).alias("at"), "_bucket")
    for r in gone.unionByName(older).collect():  # a few versions of at most BUCKETS buckets
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['at']}/_bucket={r['_bucket']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last batch."""
    about = spark.read.parquet(f"{path}/about").first()
    found = [spark.read.option("mergeSchema", True).option("basePath", f"{path}/{d}").parquet(f"{path}/{d}") for d in _written(spark, path)]
    schema = StructType([f for f in found[0].schema.fields if f.name not in ("upto", "batch")])
    newest, base, delta = _parts(spark, path, schema, None)
    return _merged(newest, base, delta, about["keys"], about["fields"], about["keep_if_null"]).drop("_bucket")


def _written(spark: SparkSession, path: str) -> list[str]:
    """Which of bases and deltas have any row."""
    out = []
    for d in ("base", "delta"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{d}/*/_bucket=*")
        if len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)):
            out.append(d)
    return out


def trend_stream(snapshots: DataFrame, keys: Sequence[str] = ("role_id",), late_days: int = 7) -> DataFrame:
    """Running sum and count of known rates per key, grain and bucket.

    Sums and counts merge exactly, whatever the order of arrival. A bucket leaves the state once it ended before the
    watermark, which follows the ends of buckets: those lie up to a month ahead of a snapshot, so a bucket stays open for that
    month and ``late_days`` more. In ``append`` mode a bucket comes once, closed; in ``update`` mode whenever it grew.
    """
    known = snapshots.filter(F.col("rate").isNotNull())
    return (
        known.select(*keys, "rate", F.inline(bucket_spans(F.col("snapshot_at"))))
        .withWatermark("bucket_end", f"{31 + late_days} days")
        .groupBy(*keys, "grain", "bucket", "bucket_end")
        .agg(F.sum(F.col("rate").cast("long")).alias("total"), F.count("rate").alias("points"))
        .drop("bucket_end")
    )


def trend_rates(totals: DataFrame) -> DataFrame:
    from tidemark.functions.rates import round_half_up

    rate = round_half_up(F.col("total").cast("double") / F.col("points"))
    return totals.withColumn("average_rate", rate).drop("total")
