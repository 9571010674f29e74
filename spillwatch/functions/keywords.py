"""Which literals are selective enough to index a rule by."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to be an index, in any case.
COMMON_WORDS = (
    "http",
    "https",
    "application",
    "password",
    "username",
    "token",
    "key",
    "auth",
    "bearer",
    "private",
    "public",
    "secret",
    "access",
)
MIN_KEYWORD_BYTES = 4
# Bytes are compared, so only a single-byte character counts.
_ONE_CHARACTER = r"^([\x00-\x7f])\1*$"


def is_valid_keyword(keyword: Column) -> Column:
    """At least four bytes, not a common word, not one character over and over."""
    keyword = F.coalesce(keyword, F.lit(""))
    return (
        (F.octet_length(keyword) >= MIN_KEYWORD_BYTES)
        & ~F.lower(keyword).isin(*COMMON_WORDS)
        & ~keyword.rlike(_ONE_CHARACTER)
    )


def is_valid_keyword_text(keyword: str | None) -> bool:
    """The same test for one string, used while rules are compiled on the driver."""
    keyword = keyword or ""
    return (
        len(keyword.encode()) >= MIN_KEYWORD_BYTES
        and keyword.lower() not in COMMON_WORDS
        and not re.match(_ONE_CHARACTER, keyword)
    )
