"""Column expressions over text, findings and values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Matches that are placeholders rather than credentials.
PLACEHOLDERS = (
    r"\$\{[^}]*\}",
    r"\{\{[^}]*\}\}",
    r"<your[^>]*>",
    r"^(.)\1*$",
)


def shannon_entropy(value: Column) -> Column:
    """Shannon entropy in bits: characters are counted, the total is the byte length; 0 for empty text."""
    total = F.octet_length(value).cast("double")

    def take_off(acc, ch):
        # What is left gets shorter with each character; bytes are counted, since a string knows how many it has.
        rest = F.replace(acc["rest"], ch, F.lit(""))
        p = (F.octet_length(acc["rest"]) - F.octet_length(rest)) / F.octet_length(ch) / total
        return F.struct(rest.alias("rest"), (acc["bits"] - p * F.log2(p)).alias("bits"))

    none = F.struct(value.alias("rest"), F.lit(0.0).alias("bits"))
    summed = F.aggregate(F.array_distinct(F.split(value, "")), none, take_off, lambda acc: acc["bits"])
    return F.when(F.octet_length(value) == 0, F.lit(0.0)).otherwise(summed)


def first_line(content: Column, value: Column) -> Column:
    """1-based line of the first occurrence of a ``value`` that does occur: line feeds in what comes before it."""
    before = F.call_function("substring_index", content, value, F.lit(1))
    return (F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_number(content: Column, value: Column) -> Column:
    """1-based line of the first occurrence of ``value`` in ``content``; null when it does not occur."""
    return F.when(F.contains(content, value), first_line(content, value))


def distinct_values(values: Column) -> Column:
    """Values in the order in which they are found, each once. A rule may match nothing at all; that is no value."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def is_false_positive(value: Column, deny: Iterable[str] | None = None) -> Column:
    """True when one of the ``deny`` regexes (default: placeholders) is found in the value."""
    deny = list(PLACEHOLDERS if deny is None else deny)
    if not deny:
        return F.lit(False)
    found = F.lit(False)
    for regex in deny:
        found = found | value.rlike("(?s)" + regex)
    return found


def detector_label(severity: Column) -> Column:
    return F.format_string("Template (%s)", severity)


def mask_value(value: Column) -> Column:
    """First four characters and a digest, for findings that go to shared tables."""
    return F.concat(F.left(value, F.lit(4)), F.lit("..."), F.sha2(value, 256))
