"""Word counts over a whole corpus: words in lower case (A-Z), cut at ASCII white space."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import release, small_batches

#: Most words that a task counts before it hands them on.
HELD = 400_000


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: exactly A-Z, and the white space 0x20 and 0x09 to 0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame, once_per_text: bool = False) -> DataFrame:
    """First column of ``texts`` -> (word binary, n long). ``once_per_text`` gives document frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                held.update(set(words) if once_per_text else words)
                if len(held) > HELD:
                    yield table(held)
                    held.clear()
        if held:
            yield table(held)
            held.clear()
        release()

    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The most frequent words by falling count, ties by code: as many whole steps of counts as make at most ``size`` words.

    A step is a sixteenth of a doubling, so few rows tell where to stop, and no
    task sends more than its share of the result.
    """
    stepped = counts.withColumn("step", F.floor(F.log2("n") * 16))
    total, least = 0, None
    for row in sorted(stepped.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # at most 16 * 63 rows
        total += row["count"]
        if total > size:
            break
        least = row["step"]
    if least is None:
        return []
    found = [(bytes(r["word"]), r["n"]) for r in stepped.filter(F.col("step") >= least).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))
