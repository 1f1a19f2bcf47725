"""Which traces to export: a share of all, and every trace with a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import SAMPLE_RATE


def within_ratio(trace_id: Column, rate: float = SAMPLE_RATE) -> Column:
    """True for the traces whose low 64 bits lie below ``rate`` of the range; null without an id.

    Ids are up to 32 hexadecimal digits; filled up with zeros in front, the
    comparison of numbers is one of texts.
    """
    bound = round(rate * 2**64)
    if bound >= 2**64:
        return F.lit(True)
    return F.lower(F.right(F.lpad(trace_id, 32, "0"), F.lit(16))) < F.lit(f"{bound:016x}")


def sampled_spans(spans: DataFrame, rate: float = SAMPLE_RATE) -> DataFrame:
    """Spans of sampled traces.

    The ratio is decided on each row. Only the rest has to look for a forced
    span of its trace; a trace may hold any share of the spans, and the adaptive
    planner splits the large side of that semi join. A span without a trace is a
    trace of its own: it stays if it is forced.
    """
    chosen = F.coalesce(within_ratio(F.col("trace_id"), rate), F.lit(False))
    forced = F.coalesce(F.col("force_sample"), F.lit(False))
    names = spans.where(forced & ~chosen).select("trace_id").distinct()
    rescued = spans.where(~chosen & F.col("trace_id").isNotNull()).join(names, "trace_id", "left_semi")
    alone = spans.where(~chosen & F.col("trace_id").isNull() & forced)
    return spans.where(chosen).unionByName(rescued.select(*spans.columns)).unionByName(alone)
