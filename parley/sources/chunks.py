"""Read chunk streams: recorded tables, live folders, and server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.schemas import CHUNK, CHUNK_BODY

DATA_PREFIX = "data: "
END_MARK = "[DONE]"
EVENT_END = "\n\n"


def read_chunks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CHUNK).format(fmt).load(path)


def stream_chunks(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
    )


def chunk_json() -> Column:
    """Payload of a chunk as it goes over the wire."""
    return F.to_json(F.struct("id", "object", "created", "model", "choices"))


def encode_events(chunks: DataFrame, payload: Column) -> DataFrame:
    """(stream_id, seq, event): one event per chunk and the end mark of each stream.

    The end mark follows the highest ``seq``; finding it combines before the shuffle.
    """
    events = chunks.select("stream_id", "seq", F.concat(F.lit(DATA_PREFIX), payload).alias("event"))
    ends = chunks.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).withColumn(
        "event", F.lit(DATA_PREFIX + END_MARK)
    )
    return events.unionByName(ends)


def write_events(events: DataFrame, path: str, streams_per_file: int | None = None) -> None:
    """Text files with the events in order of stream and ``seq``.

    Ranges of (stream, seq) form the files, so a long stream goes over several
    of them, in order of the file names.
    """
    parts = events.repartitionByRange(streams_per_file, "stream_id", "seq") if streams_per_file else (
        events.repartitionByRange("stream_id", "seq")
    )
    (
        parts.sortWithinPartitions("stream_id", "seq")
        .select(F.col("event").alias("value"))
        .write.option("lineSep", EVENT_END)
        .text(path)
    )


def decode_events(events: DataFrame, column: str = "event") -> DataFrame:
    """Chunk records of events: prefix removed, end marks dropped, bad JSON in ``_corrupt``."""
    text = F.substring(F.col(column), len(DATA_PREFIX) + 1, F.length(column))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    schema = CHUNK_BODY.replace("struct<", "struct<_corrupt:string,", 1)
    return (
        events.where(F.col(column).startswith(DATA_PREFIX))
        .withColumn("_data", text)
        .where(F.trim("_data") != END_MARK)
        .withColumn("_record", F.from_json("_data", schema, options))
        .select(*[c for c in events.columns if c != column], "_record.*")
    )


def chunk_records(spark: SparkSession, path: str, live: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """(stream_id, seq, record, file, arrived) of JSON lines, whole records as variants: recorded, or live as files come in."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if live else spark.read
    lines = reader.schema("record variant").option("singleVariantColumn", "record").format("json").load(path)
    return lines.select(
        F.try_variant_get("record", "$.stream_id", "string").alias("stream_id"), F.try_variant_get("record", "$.seq", "bigint").alias("seq"), "record",
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"),
    )


def _others(value: Column, *read: str) -> Column:
    """The fields of an object that are not read, as a variant; null for what is no object."""
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.to_variant_object(F.map_filter(F.when(is_object, value).cast("map<string,variant>"), lambda k, _: ~k.isin(*read)))


def flat_chunks(records: DataFrame, ends_on_finish: bool = True) -> DataFrame:
    """Flat chunks of (stream_id, seq, record): role, content, finish_reason, has_delta and done, and, as variants, all that is not read.

    ``rest`` holds the other fields of the record, those of its first choice (``choice``) and its further choices (``more``);
    ``delta_rest`` the other fields of the first delta. ``done`` is set on a record with ``"done": true`` and, if asked, on a finishing one.
    """
    first, delta = (F.try_variant_get("record", p, "variant") for p in ("$.choices[0]", "$.choices[0].delta"))
    more = F.try_variant_get("record", "$.choices", "array<variant>")
    finish = F.nullif(F.try_variant_get("record", "$.choices[0].finish_reason", "string"), F.lit(""))
    rest = F.map_concat(
        F.coalesce(_others(F.col("record"), "stream_id", "seq", "choices", "done").cast("map<string,variant>"), F.create_map().cast("map<string,variant>")),
        F.create_map(F.lit("choice"), _others(first, "delta", "finish_reason"), F.lit("more"), F.to_variant_object(F.slice(more, F.lit(2), F.greatest(F.size(more), F.lit(1))))),
    )
    marked = F.coalesce(F.try_variant_get("record", "$.done", "boolean"), F.lit(False))
    return records.select(
        "stream_id", "seq", F.try_variant_get("record", "$.choices[0].delta.role", "string").alias("role"),
        F.try_variant_get("record", "$.choices[0].delta.content", "string").alias("content"), finish.alias("finish_reason"),
        F.coalesce(~F.is_variant_null(delta) & delta.isNotNull(), F.lit(False)).alias("has_delta"),
        (marked | (finish.isNotNull() if ends_on_finish else F.lit(False))).alias("done"),
        F.to_variant_object(F.map_filter(rest, lambda _, v: v.isNotNull())).alias("rest"), _others(delta, "role", "content").alias("delta_rest"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of event files, in order: (stream_id, seq, record, done, unreadable).

    A stream is told by the ``id`` of its chunks; an end mark and an event that cannot be read belong to the stream of the event
    before them, in the same file or, where a file begins with them, in the one before by name. ``seq`` counts the events of a stream. Files
    may hold several streams, and a stream may go over several files: rows are ordered by (file, split, place in the split), and what crosses a split is
    carried by one small row for each split, so that neither a file nor a stream has to be read by one task.
    """
    lines = spark.read.option("lineSep", EVENT_END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    data = F.substring("value", len(DATA_PREFIX) + 1, F.length("value"))
    events = lines.where(F.col("value").startswith(DATA_PREFIX)).withColumn("data", data)
    is_end = F.trim("data") == END_MARK
    events = events.select("file", "split", "at", is_end.alias("done"), F.when(~is_end, F.try_parse_json("data")).alias("record"))
    events = events.withColumn("own", F.try_variant_get("record", "$.id", "string"))
    of_split = Window.partitionBy("file", "split").orderBy("at")
    in_split = events.withColumn("near", F.last("own", ignorenulls=True).over(of_split))
    last = events.groupBy("file", "split").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("last_own"))
    earlier = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "split", F.last("last_own", ignorenulls=True).over(earlier).alias("carried"))
    named = in_split.join(carried, ["file", "split"]).withColumn("stream_id", F.coalesce("near", "carried"))
    # Numbers inside a split, and how many events the stream has in earlier ones.
    local = F.row_number().over(Window.partitionBy("stream_id", "file", "split").orderBy("at")) - 1
    counts = named.groupBy("stream_id", "file", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stream_id").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stream_id", "file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = named.withColumn("local", local).join(counts, ["stream_id", "file", "split"])
    return numbered.select(
        "stream_id", (F.col("local") + F.col("before")).cast("long").alias("seq"), "record", "done", (~F.col("done") & F.col("record").isNull()).alias("unreadable")
    )
