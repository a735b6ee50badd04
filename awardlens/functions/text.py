"""Cleaning of names and codes; missing values of every guise become NULL."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COMPETITIVE, LEGAL_SUFFIXES, PLACEHOLDERS, REGIONAL_MARKERS, EngineConfig

ASCII = "^[\\x00-\\x7F]*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """NULL for empty and blank strings."""
    c = col(c)
    return F.when(F.regexp_replace(c, "(?U)\\s+", "") != "", c)


def known_number(c: Column | str) -> Column:
    """NULL for NaN."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends; NULL if nothing is left."""
    c = F.trim(F.regexp_replace(col(c), "(?U)\\s+", " "))
    return F.when(c != "", c)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compose(df: DataFrame, *names: str) -> DataFrame:
    """NFKC of these string columns.

    ASCII is left as it is by NFKC. Spark has no such function, so rows with any other character are a branch of their
    own, and only they go to Python.
    """
    types = dict(df.dtypes)
    names = tuple(n for n in names if types.get(n) == "string")
    if not names:
        return df
    plain = reduce(lambda a, b: a & b, (F.coalesce(F.col(n).rlike(ASCII), F.lit(True)) for n in names))
    other = df.filter(~plain)
    return df.filter(plain).unionByName(other.withColumns({n: _nfkc(F.col(n)) for n in names}))


def text(c: Column | str) -> Column:
    """A text of composed characters with its white space collapsed."""
    return collapse(c)


def country_code(c: Column | str) -> Column:
    return F.upper(collapse(c))


def supplier_name(c: Column | str) -> Column:
    """The name in capitals, without punctuation and legal forms.

    Forms are taken off the end one by one, the first of the list that fits first, until none fits or none of the name
    would be left.
    """
    name = F.upper(collapse(c))
    name = collapse(F.regexp_replace(name, "(?U)[^\\w\\s&]", " "))
    pattern = "(?U)\\b(" + "|".join(LEGAL_SUFFIXES) + ")\\b\\.?\\s*$"

    def strip(x: Column, _: Column) -> Column:
        short = F.trim(F.regexp_replace(x, pattern, ""))
        return F.when(short != "", short).otherwise(x)

    return F.aggregate(F.array_repeat(F.lit(0), 6), name, strip)


def is_placeholder(name: Column | str) -> Column:
    """Whether a normalised name names no one; true of NULL."""
    return F.coalesce(col(name).isin(*PLACEHOLDERS), F.lit(True))


def supplier_key(name: Column | str) -> Column:
    return F.when(~is_placeholder(name), col(name))


def practices(c: Column | str) -> Column:
    """The parts of a list with semicolons."""
    return F.filter(F.transform(F.split(col(c), ";"), lambda x: collapse(x)), lambda x: x.isNotNull())


def primary_practice(c: Column | str) -> Column:
    return F.get(practices(c), F.lit(0))


def many_practices(c: Column | str) -> Column:
    return F.coalesce(F.size(practices(c)) > 1, F.lit(False))


def is_regional(name: Column | str, code: Column | str) -> Column:
    """A borrower without a code whose name has a marker."""
    upper = F.upper(F.coalesce(col(name), F.lit("")))
    return col(code).isNull() & reduce(lambda a, b: a | b, (F.contains(upper, F.lit(m)) for m in REGIONAL_MARKERS))


def method_key(c: Column | str) -> Column:
    return F.upper(collapse(c))


def method_class(c: Column | str, config: EngineConfig) -> Column:
    """COMPETITIVE or NON_COMPETITIVE; NULL for a missing or unknown method."""
    pairs = [F.lit(x) for name, (kind, _) in config.methods.items() for x in (" ".join(name.split()).upper(), kind)]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(method_key(c), F.lit("")))


def is_competitive(kind: Column | str) -> Column:
    return col(kind) == COMPETITIVE


def is_domestic(regional: Column | str, borrower_code: Column | str, supplier_code: Column | str) -> Column:
    """NULL for regional borrowers and where a code is missing."""
    return F.when(~col(regional), col(supplier_code) == col(borrower_code))


def in_secrecy(country: Column | str, config: EngineConfig) -> Column:
    return col(country).isin(*config.secrecy) if config.secrecy else F.when(col(country).isNotNull(), F.lit(False))


_NUMBER = "^\\s*[+-]?(\\d+(_\\d+)*\\.?(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)([eE][+-]?\\d+)?\\s*$"


def amount(c: Column | str) -> Column:
    """The number in a text with thousands' commas and dollar signs; NULL if there is none."""
    bare = F.regexp_replace(col(c).cast("string"), "[,$]", "")
    return F.when(bare.rlike(_NUMBER), F.regexp_replace(F.trim(bare), "_", "").try_cast("double"))
