"""Structured Streaming twins: deduplicated intake, windows with late data, rate limits, streamed dimension rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataleaf.session import new_path


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over the Parquet files at ``path``, a folder or a single file, with their own schema."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    stream = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    return stream.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString())) if one else stream.parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there in micro-batches and return the result as a table in the shared folder. Batches are
    written to folders by their number, so a batch that is repeated after a failure replaces itself; in complete
    mode the last batch is the result."""
    spark = stream.sparkSession
    base = new_path(spark, f"stream-{name}")

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={no if mode == 'append' else 0}")

    job = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*")


def deduplicated(stream: DataFrame, key: list[str], at: str, late: str = "30 days") -> DataFrame:
    """The first arrival of each key; state is kept for ``late`` after the event time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, at: str, width: str, by: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Tumbling windows with late rows up to the watermark: (window_from, *by, n, total)."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_from"), *by, "n", "total")


def limiter(most: int, seconds: float) -> Callable:
    """Sliding-window limit per key: a request is allowed if fewer than ``most`` allowed ones lie within the
    ``seconds`` before it; a refused one isn't recorded. State: the times of allowed requests, at most ``most``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        allowed = []
        for us in rows["us"]:
            while seen and us - seen[0] >= seconds * 1e6:
                seen.popleft()
            allowed.append(len(seen) < most)
            if allowed[-1]:
                seen.append(us)
        state.update((list(seen),))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "key": key[0], "allowed": allowed})

    return run


def rate_limited(stream: DataFrame, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """(id, key, allowed) for requests (id bigint, key bigint, us bigint); within a micro-batch in order of time."""
    return stream.groupBy("key").applyInPandasWithState(
        limiter(most, seconds), "id long, key long, allowed boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout
    )


def ttl_cache(ttl_us: int, most: int | None = None) -> Callable:
    """A cache of which an entry lives ``ttl_us`` from when it was set; a read that finds none sets it. With ``most`` the cache
    of a state's key holds that many entries and drops the one that was read longest ago."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries: dict[str, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        hits = []
        for us, name in zip(rows["us"], rows["entry"], strict=True):
            was = entries.pop(name, None)
            hits.append(was is not None and us - was < ttl_us)
            entries[name] = was if hits[-1] else us
            if most is not None and len(entries) > most:
                del entries[next(iter(entries))]
        state.update((list(entries), list(entries.values())))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "hit": hits})

    return run


def cached_reads(stream: DataFrame, ttl_us: int, most: int | None = None) -> DataFrame:
    """(id, hit) of reads (id bigint, key, entry string, us bigint) of a cache a key; in a micro-batch in order of time."""
    return stream.groupBy("key").applyInPandasWithState(
        ttl_cache(ttl_us, most), "id long, hit boolean", "entries array<string>, set_us array<long>", "append", GroupStateTimeout.NoTimeout
    )
