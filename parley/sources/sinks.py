"""Write telemetry: metric text, span logs, sampled spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import METRIC_HELP, SAMPLE_RATE
from parley.operators.instruments import LABELS
from parley.operators.sampling import sampled_spans


def _number(value: Column) -> Column:
    """Whole numbers without a fraction, +Inf for infinity."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(value == float("inf"), F.lit("+Inf")).when(
        whole, F.concat(F.floor(value).cast("string"), F.lit(".0"))
    ).otherwise(value.cast("string"))


def _labels(*more: Column) -> Column:
    pairs = [
        F.concat(F.lit(f'{n}="'), _escaped(F.col(n)), F.lit('"')) for n in LABELS if n != "metric"
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs, *more), F.lit("}"))


def _escaped(label: Column) -> Column:
    doubled = F.replace(label, F.lit("\\"), F.lit("\\\\"))
    quoted = F.replace(doubled, F.lit('"'), F.lit('\\"'))
    return F.replace(quoted, F.lit("\n"), F.lit("\\n"))


def exposition_lines(histograms: DataFrame) -> DataFrame:
    """(metric, line) in the text format of metric scrapers, for histogram rows.

    Sums have three decimals, so that the order of adding does not change their text.
    """
    infinite = F.col("le") == float("inf")
    bucket = F.concat(
        F.col("metric"), F.lit("_bucket"),
        _labels(F.concat(F.lit('le="'), _number(F.col("le")), F.lit('"'))),
        F.lit(" "), F.col("bucket_count").cast("string"),
    )
    count = F.concat(F.col("metric"), F.lit("_count"), _labels(), F.lit(" "), F.col("count").cast("string"))
    total = F.concat(F.col("metric"), F.lit("_sum"), _labels(), F.lit(" "), F.col("sum").cast("decimal(38,3)").cast("string"))
    lines = F.array_compact(F.array(bucket, F.when(infinite, count), F.when(infinite, total)))
    return histograms.select("metric", F.explode(lines).alias("line"))


def counter_lines(errors: DataFrame, metric: str) -> DataFrame:
    labels = F.concat_ws(
        ",", *[F.concat(F.lit(f'{n}="'), _escaped(F.col(n)), F.lit('"')) for n in ("model", "streaming")]
    )
    return errors.select(
        F.lit(metric).alias("metric"),
        F.concat(F.lit(metric + "{"), labels, F.lit("} "), F.col("errors").cast("string")).alias("line"),
    )


def with_headers(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Put the help and type lines of each metric in front of its samples.

    Only the distinct metric names are aggregated for it, ten at most.
    """
    texts = F.create_map(
        *[x for m, k in kinds.items() for x in (F.lit(m), F.array(
            F.lit(f"# HELP {m} {METRIC_HELP[m]}"), F.lit(f"# TYPE {m} {k}")))]
    )
    heads = (
        lines.select("metric").distinct()
        .select("metric", F.posexplode(F.try_element_at(texts, F.col("metric"))).alias("rank", "line"))
    )
    return heads.unionByName(lines.withColumn("rank", F.lit(2)))


def write_exposition(lines: DataFrame, path: str) -> None:
    """One text file; its size depends on metrics and label sets, not on the number of spans.

    The lines are computed in parallel and only then brought together.
    """
    lines.repartition(1).sortWithinPartitions("metric", "rank", "line").select(F.col("line").alias("value")).write.text(path)


def write_span_logs(records: DataFrame, path: str) -> None:
    records.write.json(path)


def export_sampled(spans: DataFrame, path: str, rate: float = SAMPLE_RATE) -> None:
    sampled_spans(spans, rate).write.parquet(path)
