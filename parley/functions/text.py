"""Text helpers that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, one rule: Unicode white space in
# the basic plane. ``trim`` alone would only take the plain blank.
WHITESPACE = "".join(
    chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()
)

# The same set as a character class that Java and RE2 regular expressions share.
SPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# For splitting, a Java-only form: the wide blanks sit behind one range test,
# so that ordinary letters are decided by a bit set and that test alone.
_NARROW = "".join(f"\\x{ord(c):02x}" for c in WHITESPACE if ord(c) < 256)
_WIDE = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE if ord(c) >= 256)
SPLIT_SPACES = f"[{_NARROW}[\\x{{1680}}-\\x{{3000}}&&[{_WIDE}]]]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def has_visible(c: Column) -> Column:
    """True when the text holds anything but white space."""
    return F.length(lstrip(c)) > 0


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Inside higher-order functions Catalyst shares no common sub-expressions, so
    a value that is needed twice would be computed twice.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """Split on runs of white space, no empty words."""
    return bind(
        strip(c),
        lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, SPLIT_SPACES)),
    )


def count_of(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are in ``chars``."""
    return sum(F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit(""))) for ch in chars)


def round_half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def text_statistics(c: Column) -> dict[str, Column]:
    return {
        "words": F.size(words(c)).cast("long"),
        "chars": F.length(c).cast("long"),
        "chars_no_spaces": F.length(F.replace(c, F.lit(" "), F.lit(""))).cast("long"),
        "sentence_marks": count_of(c, ".!?").cast("long"),
    }


def two_decimals(number: Column) -> Column:
    """A double below 2^53 rounded by its exact binary value, ties to even. ``format_string`` rounds its shortest decimal form up
    instead, which gives 1.01 for 1.005 and 0.13 for 0.125."""
    return F.call_function("format_number", number, F.lit("0.00"))


def number_text(number: Column) -> Column:
    """A number in its shortest digits, with an exponent only below 1e-4 and from 1e16 on (``1e-05``); Spark writes 1.0E7 for 10000000.0."""
    text, size = number.cast("string"), F.abs(number)
    plain = F.regexp_replace(number.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.substring_index(text, "E", -1).cast("int")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    raised = F.concat(digits, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.format_string("%02d", F.abs(power)))
    return F.when(~F.contains(text, F.lit("E")), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(raised)


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """Convert a measure and describe it as text; unknown pairs give an error text."""
    src, dst = F.lower(source), F.lower(target)

    def pair(a: str, b: str) -> Column:
        return (src == a) & (dst == b)

    def told(result: Column, unit_in: str, unit_out: str) -> Column:
        return F.concat(number_text(value), F.lit(unit_in + " = "),
                        two_decimals(result), F.lit(unit_out))

    return (
        F.when(pair("meters", "feet"), told(value * 3.28084, " meters", " feet"))
        .when(pair("feet", "meters"), told(value / 3.28084, " feet", " meters"))
        .when(pair("celsius", "fahrenheit"), told(value * 9 / 5 + 32, "°C", "°F"))
        .when(pair("fahrenheit", "celsius"), told((value - 32) * 5 / 9, "°F", "°C"))
        .when(pair("kg", "pounds"), told(value * 2.20462, " kg", " pounds"))
        .when(pair("pounds", "kg"), told(value / 2.20462, " pounds", " kg"))
        .otherwise(F.concat(F.lit("Error: Conversion from "), source, F.lit(" to "), target,
                            F.lit(" not supported")))
    )
