"""Trace steps: what each stage saw and answered, as an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE_TYPE = (
    "array<struct<node:string,step:string,model:string,input:string,output:string,"
    "latency_ms:double,cost:string>>"
)


def trace_step(
    node: str, step: Column | str, model: str, text: Column, output: Column, cost: str = "zero"
) -> Column:
    """One step. A batch plan has no latency per row, so that field is null."""
    return F.struct(
        F.lit(node).alias("node"),
        (F.lit(step) if isinstance(step, str) else step).alias("step"),
        F.lit(model).alias("model"),
        F.substring(F.coalesce(text, F.lit("")), 1, 200).alias("input"),
        F.to_json(output).alias("output"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit(cost).alias("cost"),
    )


def no_steps() -> Column:
    return F.array().cast(TRACE_TYPE)


def joined(*traces: Column) -> Column:
    """Steps of several stages in order; a stage without any may be null."""
    return F.concat(*[F.coalesce(t.cast(TRACE_TYPE), no_steps()) for t in traces])
