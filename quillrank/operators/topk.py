"""Best rows per group in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.sources.workspace import store

#: Up to this many first rows go through one task.
SELECTED_ROWS = 10_000


def merge_width(df: DataFrame) -> int:
    """How many reducers share the first merge of one group.

    A single reducer per group would receive ``k`` rows from every task of the
    scan, which is a lot when a few queries meet a very large corpus.
    """
    return min(256, max(1, df.sparkSession.sparkContext.defaultParallelism // 16))


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by a total ``order``, for any ``n``.

    Few rows are selected in each task and merged. Many are sorted in ranges over all
    tasks; the ranges are counted, whole ones are kept and the last one is cut, so
    no task holds more than a range.
    """
    if n <= SELECTED_ROWS:
        return df.orderBy(*order).limit(n)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    placed = store(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")),
        "first-rows").df
    left, whole = n, -1
    # One row per range.
    for row in placed.groupBy("_range").count().orderBy("_range").collect():
        if row["count"] > left:
            break
        left, whole = left - row["count"], row["_range"]
    following = placed.where(F.col("_range") > whole).agg(F.min("_range").alias("_cut"))
    cut = placed.join(F.broadcast(following), placed["_range"] == following["_cut"], "left")
    kept = (F.col("_range") <= whole) | (F.col("_cut").isNotNull() & (F.col("_place") < left))
    return cut.where(kept).select(*[F.col(f"`{c}`") for c in df.columns])


def top_k(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
    width: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of every group by a total ``order``, ranked from 1.

    ``k`` is a literal, so Spark cuts every task to ``k`` rows per group before
    the shuffle.
    """
    salts = merge_width(df) if width is None else width
    if salts > 1:
        spread = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        first = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            spread.withColumn("_first", F.row_number().over(first))
            .where(F.col("_first") <= k)
            .drop("_salt", "_first")
        )
    final = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)
