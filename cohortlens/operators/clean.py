"""Column normalisation, string cleaning and de-duplication."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.domain import COLUMN_ALIASES

_NAME_CHARS = frozenset(string.ascii_lowercase + string.digits)
_GROUP_RE = r"^group ([a-e])$"


def normalised_name(raw: str) -> str:
    """A declared alias, else the name's ASCII letters and digits in lower case, other characters as word breaks."""
    name = raw.lower()
    if name.strip() in COLUMN_ALIASES:
        return COLUMN_ALIASES[name.strip()]
    return "_".join("".join(ch if ch in _NAME_CHARS else " " for ch in name).split())


def normalise_columns(df: DataFrame) -> DataFrame:
    """Alias map, else lower-case with non-alphanumeric runs → ``_``."""
    return df.toDF(*[normalised_name(c) for c in df.columns])


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim + lower-case every string column; ``group x`` keeps an upper-case letter."""
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            c = F.lower(F.regexp_replace(F.col(f.name), r"^\s+|\s+$", ""))
            if f.name == "race_ethnicity":
                c = F.when(c.rlike(_GROUP_RE),
                           F.concat(F.lit("group "), F.upper(F.regexp_extract(c, _GROUP_RE, 1)))
                           ).otherwise(c)
            exprs[f.name] = c
    return df.withColumns(exprs) if exprs else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN → NULL in floating columns, so NaN is 'missing' as in pandas."""
    exprs = {f.name: F.when(~F.isnan(f.name), F.col(f.name))
             for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(exprs) if exprs else df


def clean(df: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """C2 + C3: clean strings, NaN → NULL, drop exact duplicate rows.

    ``dropDuplicates`` is a hash aggregate over all columns with a map-side
    partial step, so a row repeated millions of times collapses before the
    shuffle.
    """
    out = nan_to_null(clean_strings(df))
    return out.dropDuplicates() if drop_duplicates else out


def duplicate_report(raw: DataFrame) -> DataFrame:
    """C3 report: rows before / after cleaning and the number dropped (one row)."""
    cleaned = clean(raw, drop_duplicates=False)
    counted = cleaned.groupBy(*cleaned.columns).count()
    return counted.agg(
        F.sum("count").alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
    ).select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_dropped"))
