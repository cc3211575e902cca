"""Writers. Every asset goes to its own run-stamped folder and is never rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends events, one folder per day, so that reading a period prunes folders."""
    day = F.to_date(F.timestamp_seconds(ts))
    events.withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(
        path
    )


def write_assets(assets: dict[str, DataFrame], root: str, run: str, fmt: str = "parquet") -> None:
    """Each asset under root/<name>/run=<run>."""
    for name, df in assets.items():
        df.write.format(fmt).mode("error").save(f"{root}/{name}/run={run}")


def inventory(spark, root: str, names: list[str], fmt: str = "parquet") -> DataFrame:
    """(asset, run, n) of what was written."""
    counts = [
        spark.read.format(fmt)
        .load(f"{root}/{name}")
        .groupBy(F.lit(name).alias("asset"), F.col("run").cast("string").alias("run"))
        .agg(F.count(F.lit(1)).alias("n"))
        for name in names
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
