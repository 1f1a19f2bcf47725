"""Document fingerprints by I-Match, in DataFrame expressions only.

The lexicon holds the terms whose inverse document frequency lies in a chosen
band: they occur in at least ``least`` and at most ``most`` of all documents. Of a
text, its distinct terms of the lexicon are sorted (by their 64-bit hashes) and hashed once for each of
48 randomised parts of the lexicon. The parts have different sizes (of class j,
a part holds 2^-j of the terms): small parts stay the same under large edits,
large parts tell similar texts apart. A part of which the text
has no term gives ``-``.

Likeness of two fingerprints: of the parts that are not ``-`` in both, the share
that is equal; where all are ``-`` in both, 1 if the fingerprints are equal. A text
none of whose terms is in the lexicon falls back to all its distinct terms, so
that short or odd texts differ from one another; a text without any term gives
only ``-``. Null texts count as empty. Equal texts have equal fingerprints, and so
have repeated rows. Texts of any length are read as a whole; an empty table gives an empty one.

How the lexicon is looked up: terms fall into 2^20 slots by hash; a table of one byte
for each slot says which hold a term of the band. It takes 1 MiB for any corpus
and stands in the expression itself, so texts are read where they lie; a term
outside the band that shares its slot with one inside is taken along, for every
text alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS, WORD_BITS = 1 << 20, 32
#: A class of parts takes the terms whose mark starts with a given row of bits: how many bits, and how many such parts.
CLASSES = ((3, 8), (5, 8), (7, 16), (9, 16))


def terms_of(text: Column) -> Column:
    spaced = F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")
    return F.array_distinct(F.array_remove(F.split(spaced, " "), ""))


def slot_of(term_hash: Column) -> Column:
    return F.pmod(term_hash, F.lit(SLOTS)).cast("int")


def lexicon(docs: DataFrame, text: str = "text", least: float = 0.0005, most: float = 0.1) -> bytes:
    """The table of slots that hold a term of the band. Document frequencies are counted over all rows."""
    seen = docs.select(F.explode(terms_of(F.col(text))).alias("term"))
    counts = seen.groupBy(F.xxhash64("term").alias("term")).agg(F.count("*").alias("df"))
    rows = docs.count()
    kept = counts.filter((F.col("df") >= max(2.0, least * rows)) & (F.col("df") <= max(2.0, most * rows)))
    kept = kept.select(slot_of(F.col("term")).alias("slot"))
    mask = F.expr(f"shiftleft(1L, slot % {WORD_BITS})")
    packed = kept.groupBy((F.col("slot") / WORD_BITS).cast("int").alias("at")).agg(F.bit_or(mask).alias("bits"))
    table = bytearray(SLOTS)
    for row in packed.collect():  # at most 2^20 / 32 rows
        for bit in range(WORD_BITS):
            table[row["at"] * WORD_BITS + bit] = row["bits"] >> bit & 1
    return bytes(table)


def with_fingerprints(rows: DataFrame, texts: dict[str, Column], table: bytes) -> DataFrame:
    """``rows`` with a fingerprint for each of ``texts``."""
    columns, steps = rows.columns, 0

    def step(value: Column) -> Column:
        nonlocal rows, steps
        steps += 1
        rows = rows.withColumn(f"_step{steps}", value)
        return F.col(f"_step{steps}")

    for name, text in texts.items():
        terms = step(terms_of(F.coalesce(text, F.lit(""))))
        inside = F.filter(terms, lambda t: F.substring(F.lit(table), slot_of(F.xxhash64(t)) + 1, F.lit(1)) == F.lit(b"\x01"))
        marked = step(F.array_sort(F.transform(inside, lambda t: F.xxhash64(t, F.lit("term")))))
        parts: list[Column] = []
        source = marked
        for bits, many in CLASSES:
            if bits > 3:  # all parts of a class start with the same zero bits
                source = step(starting_with(source, 64 - bits + many.bit_length() - 1, 0))
            for r in range(many):
                own = starting_with(source, 64 - bits, r) if bits else source
                parts.append(F.transform(F.array(own), part_hash(len(parts)))[0])
        whole = F.xxhash64(terms)
        lone = [short_hash(whole, k) for k in range(len(parts))]
        nothing = F.array_repeat(F.lit("-"), len(parts))
        made = F.when(F.size(marked) > 0, F.array(*parts)).when(F.size(terms) > 0, F.array(*lone)).otherwise(nothing)
        columns = [*[c for c in columns if c != name], name]
        rows = rows.withColumn(name, F.concat_ws(",", made))
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def part_hash(salt: int):
    return lambda own: F.when(F.size(own) > 0, short_hash(own, salt)).otherwise("-")


def starting_with(marked: Column, shift: int, bits: int) -> Column:
    """The terms whose hash, but for its last ``shift`` bits, is ``bits``."""
    return F.filter(marked, lambda m: F.shiftrightunsigned(m, shift) == bits)


def short_hash(value: Column, salt: int) -> Column:
    return F.right(F.lpad(F.lower(F.hex(F.xxhash64(value, F.lit(salt)))), 16, "0"), F.lit(8))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(F.split(a, ",").alias("x"), F.split(b, ",").alias("y"))
    told = F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-"))
    same = F.size(F.filter(told, lambda p: p["x"] == p["y"]))
    return F.when(F.size(told) > 0, same / F.size(told)).otherwise((a == b).cast("double"))


def with_next(docs: DataFrame, per_slice: int = 2000) -> DataFrame:
    """doc_id, text, ``next_text`` (that of the next document by descending id, after the last the first), home, place, guest.

    ``home`` and ``place`` identify a row; rows marked ``guest`` are the copies that only lend their text to the last row of a home.

    Null ids come last; among equal ids the text decides. Ids are cut into slices
    of about ``per_slice`` rows; texts are shuffled once, by slice, together with a
    copy of the first row of each slice for the slice before it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    n = max(1, -(-total // per_slice))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] if n > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    bounds = F.array(*map(F.lit, cuts)).cast("array<long>") if cuts else None
    # The number of cuts at or above an id is its slice; null ids come after all.
    at = F.size(F.filter(bounds, lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("slice", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(at).cast("int"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    firsts = rows.groupBy("slice").agg(F.max(F.struct(F.col("doc_id"), F.col("digest"))).alias("first"))
    before = F.lag("slice").over(W.orderBy("slice"))
    last = F.max("slice").over(W.partitionBy())
    firsts = firsts.select(F.col("slice").alias("of"), "first", F.coalesce(before, last).alias("guest_of"))  # one row for each slice
    rows = rows.join(F.broadcast(firsts), F.col("slice") == F.col("of"))
    is_first = F.struct(F.col("doc_id"), F.col("digest")).eqNullSafe(F.col("first"))
    homes = F.when(is_first, F.array(F.struct(F.lit(False).alias("guest"), F.col("slice").alias("home")), F.struct(F.lit(True).alias("guest"), F.col("guest_of").alias("home"))))
    homes = homes.otherwise(F.array(F.struct(F.lit(False).alias("guest"), F.col("slice").alias("home"))))
    rows = rows.select("doc_id", "text", "digest", F.explode(homes).alias("h")).select("doc_id", "text", "digest", "h.guest", "h.home")
    order = W.partitionBy("home").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("digest"))
    placed = rows.withColumns({"next_text": F.lead("text").over(order), "place": F.row_number().over(order)})
    return placed.select("home", "place", "guest", "doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
