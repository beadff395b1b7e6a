"""Column expressions for cleaning: missing values, numbers and truth values in text, names, ratios and labels of effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that a reader with NA inference takes as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def number(c: str | Column) -> Column:
    """A double where the text holds a finite one, else null."""
    return finite(F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double"))


def known(c: str | Column) -> Column:
    """Null where the text is one that stands for a missing value."""
    return F.when(~col(c).isin(*NA_TOKENS), col(c))


def plain(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def respelled(c: str | Column, spellings: dict[str, str] | None = None) -> Column:
    """Plain text with other spellings of a name replaced."""
    out = plain(c)
    for wrong, right in (spellings or {"epitheliod": "epithelioid"}).items():
        out = F.when(out == wrong, right).otherwise(out)
    return out


def folded(c: str | Column) -> Column:
    """Lower case, runs of blanks and underscores as one underscore."""
    return F.lower(F.regexp_replace(col(c), r"[\s_]+", "_"))


def or_unknown(c: str | Column) -> Column:
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit("unknown"))


def truth(c: str | Column) -> Column:
    return F.coalesce(plain(c) == "true", F.lit(False))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def slashes(c: str | Column) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def contains_any(c: str | Column, parts, fold: bool = False) -> Column:
    """Whether the text holds any of the substrings, in any case; with fold, separators count alike. Blank parts don't
    count, a null text holds none."""
    text = folded(c) if fold else F.lower(col(c))
    parts = [p.lower() for p in parts if p]
    if fold:
        import re

        parts = [re.sub(r"[\s_]+", "_", p) for p in parts]
    return F.coalesce(reduce(lambda x, y: x | y, (F.contains(text, F.lit(p)) for p in parts), F.lit(False)), F.lit(False))


def half_even(c: str | Column, digits: int) -> Column:
    return F.bround(col(c), digits)


def stars(q: str | Column) -> Column:
    q = col(q)
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("")


def violations(df: DataFrame, c: str) -> DataFrame:
    """Rows whose label isn't a whole number from 0 on."""
    n = number(c)
    return df.where(n.isNull() | (n < 0) | (n != F.floor(n)))
