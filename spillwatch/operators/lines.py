"""From the values found in each text to one row per value with its line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_values, first_line


def explode_lined(files: DataFrame, values: Column, keep: list[str]) -> DataFrame:
    """``(*keep, value, line)``: each distinct value of each row's ``content`` once; the text is gone from here on."""
    content = F.col("content")
    lined = F.transform(distinct_values(values), lambda v: F.struct(v.alias("value"), first_line(content, v).alias("line")))
    return files.select(*keep, F.inline(lined))
