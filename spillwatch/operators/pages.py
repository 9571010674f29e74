"""Stored pages ``(page_id, url, html)`` as sources of script URLs and of scannable scripts.

A page is read by one pattern, tag by tag: a comment, a script with its body, or a start tag with its attributes. What it reads as one piece hides
what stands inside: tags in comments, in scripts or in quoted values are none. Attributes are read the same way inside a start tag.
Groups are possessive, so the JVM matcher neither recurses nor goes back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolve_url

# How a page is written.
BLANK = r"[\t\n\f\r ]"
NAME = r"[^\t\n\f\r />=][^\t\n\f\r />=]*+"
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >\"'][^\t\n\f\r >]*+"
ATTRIBUTE = rf"({NAME})(?:{BLANK}*+={BLANK}*+({VALUE})?+)?+"
ATTRIBUTES = rf"(?:[\t\n\f\r /=]++|{NAME}(?:{BLANK}*+={BLANK}*+(?:{VALUE})?+)?+)*+"
COMMENT = r"<!--(?:[\s\S]*?-->|[\s\S]*+)"
SCRIPT_OPEN = rf"<script(?:[\t\n\f\r /]{ATTRIBUTES})?+>"
SCRIPT_CLOSE = r"</script[\t\n\f\r />]"
START_TAG = rf"<[a-zA-Z]{ATTRIBUTES}>"
# A script that nothing closes hides the rest of the page.
PIECE = rf"(?i)(?:{COMMENT}|{SCRIPT_OPEN}[\s\S]*?(?:{SCRIPT_CLOSE}|\z)|{START_TAG})"
NAMED_CHARACTERS = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _pieces(html: Column) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(PIECE), F.lit(0)), lambda t: ~t.startswith("<!--"))


def decoded_entities(text: Column) -> Column:
    """Numbered characters and the few named ones that every page may use, decoded once."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});"), F.lit(0)))

    def character(entity):
        hexed = F.regexp_extract(entity, "(?i)x([0-9a-f]+)", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(entity, "([0-9]+)", 1)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)

    out = F.aggregate(numbers, text, lambda done, entity: F.replace(done, entity, character(entity)))
    return reduce(lambda done, name: F.replace(done, F.lit(f"&{name};"), F.lit(NAMED_CHARACTERS[name])), NAMED_CHARACTERS, out)


def _references(piece: Column) -> Column:
    """Values of ``src`` and ``href`` of one tag."""
    tag = F.regexp_extract(piece, rf"(?i)^(?:{SCRIPT_OPEN}|{START_TAG})", 0)
    both = F.arrays_zip(
        F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)).alias("name"), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)).alias("value")
    )
    wanted = F.filter(both, lambda a: F.lower(a["name"]).isin("src", "href") & (a["value"] != ""))
    return F.transform(wanted, lambda a: F.trim(decoded_entities(F.regexp_replace(a["value"], r"^[\"']|[\"']$", ""))))


def page_references(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, url)``: every ``src`` and ``href`` value as an absolute URL, in the order of the page.

    A relative one is resolved against the first ``<base href>`` of the page, or else its own URL.
    """
    pieces = pages.select("page_id", F.col("url").alias("page_url"), _pieces(F.col("html")).alias("pieces"))
    found = pieces.select(
        "page_id",
        "page_url",
        F.get(F.flatten(F.transform(F.filter("pieces", lambda t: t.rlike(rf"(?i)^<base{BLANK}")), _references)), F.lit(0)).alias("base"),
        F.flatten(F.transform("pieces", _references)).alias("references"),
    )
    rows = found.select("page_id", F.coalesce(resolve_url(F.col("base"), F.col("page_url")), "page_url").alias("base"), F.posexplode("references").alias("pos", "reference"))
    return rows.select("page_id", "pos", resolve_url(F.col("reference"), F.col("base")).alias("url"))


def page_script_urls(pages: DataFrame) -> DataFrame:
    """The references of :func:`page_references` that are scripts."""
    from .url_lists import only_js

    return only_js(page_references(pages))


def inline_scripts(pages: DataFrame) -> DataFrame:
    """``(url, file, content)``: each non-blank inline script as a file of its own."""
    scripts = F.filter(_pieces(F.col("html")), lambda t: t.rlike(rf"(?i)^{SCRIPT_OPEN}"))
    bodies = F.transform(scripts, lambda t: F.regexp_extract(t, rf"(?is)^{SCRIPT_OPEN}(.*){SCRIPT_CLOSE}\z", 1))
    return (
        pages.select("page_id", "url", F.posexplode(bodies).alias("pos", "content"))
        .where(F.trim("content") != "")
        .select("url", F.concat_ws("_", F.lit("page"), "page_id", "pos").alias("file"), "content")
    )
