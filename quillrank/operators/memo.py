"""Results and embeddings remembered in a table with expiry.

The table is append-only: the newest entry of a key counts, and an entry counts
until the second it expires. The current time is always an argument. Stored entries
are in folders by the hour they were written in. Where no entry lives longer than a
known time, neither a live entry nor one that replaces it can have been written before
that, so look-ups list and read the folders of that time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.embedders import QUERY, Embedder
from quillrank.functions.keys import embedding_key


def entries(
    rows: DataFrame, key: Column, payload: Column, written_at: Column, ttl: int | Column
) -> DataFrame:
    """Cache rows ``(key, payload, written_at, expires_at)`` ready to be appended; ``ttl`` in seconds."""
    return rows.select(
        key.alias("key"), payload.alias("payload"), written_at.alias("written_at"),
        (written_at + F.make_dt_interval(secs=ttl if isinstance(ttl, Column) else F.lit(ttl))).alias("expires_at"),
    )


WRITTEN_HOUR = "written_hour"


def _hour(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600).cast("long")


def append(cache: DataFrame, path: str) -> None:
    """Add entries to a stored cache; their hour of writing becomes their folder."""
    cache.withColumn(WRITTEN_HOUR, _hour(F.col("written_at"))).write.mode("append").partitionBy(WRITTEN_HOUR).parquet(path)


def written_within(cache: DataFrame, now: Column, longest: int | None) -> DataFrame:
    """Entries written up to ``now`` and, if no entry lives longer than ``longest`` seconds, not before that time."""
    recent = F.col("written_at") <= now
    if longest is not None:
        first = now - F.make_dt_interval(secs=F.lit(longest))
        recent = recent & (F.col("written_at") >= first)
        if WRITTEN_HOUR in cache.columns:
            recent = recent & F.col(WRITTEN_HOUR).between(_hour(first), _hour(now))
    return cache.where(recent)


def newest(cache: DataFrame) -> DataFrame:
    """The last written entry of every key; equal times are decided by the payload."""
    entry = F.struct("written_at", "payload", "expires_at")
    return cache.groupBy("key").agg(F.max(entry).alias("_entry")).select("key", "_entry.*")


def live(cache: DataFrame, now: Column, longest: int | None = None) -> DataFrame:
    """Newest entries that have not expired at ``now``, whatever their time to live.

    An entry that was written later replaces an earlier one, even if it expires
    sooner. ``longest`` is the longest time to live in the cache, in seconds; without it
    all entries written so far are looked at.
    """
    return newest(written_within(cache, now, longest)).where(F.col("expires_at") > now)


def purge(cache: DataFrame, path: str, now: Column) -> None:
    """Write what can still be asked for to a new folder: live entries and those written after ``now``."""
    later = cache.where(F.col("written_at") > now).select("key", "payload", "written_at", "expires_at")
    append(live(cache, now).select("key", "payload", "written_at", "expires_at").union(later), path)


def lookup(requests: DataFrame, cache: DataFrame, now: Column, longest: int | None = None) -> DataFrame:
    """Requests that have a live entry, with its payload. ``requests`` has a ``key`` column."""
    return requests.join(live(cache, now, longest).select("key", "payload", "expires_at"), "key")


def hits(requests: DataFrame, cache: DataFrame, now: Column, longest: int | None = None) -> DataFrame:
    return requests.join(live(cache, now, longest), "key", "left_semi")


def misses(requests: DataFrame, cache: DataFrame, now: Column, longest: int | None = None) -> DataFrame:
    return requests.join(live(cache, now, longest), "key", "left_anti")


def memo_embeddings(
    texts: DataFrame, cache: DataFrame, embedder: Embedder, now: Column, namespace: str | None = None,
    longest: int | None = None,
) -> DataFrame:
    """``(text, vector, source)`` for distinct texts; only unknown ones are embedded."""
    wanted = texts.select("text").distinct().withColumn("key", embedding_key(F.col("text"), namespace))
    known = lookup(wanted, cache, now, longest).select(
        "text", F.from_json("payload", "array<float>").alias("vector"), F.lit("cache").alias("source")
    )
    fresh = misses(wanted, cache, now, longest).select(
        "text", embedder.column(F.col("text"), QUERY).alias("vector"), F.lit("model").alias("source")
    )
    return known.unionByName(fresh)
