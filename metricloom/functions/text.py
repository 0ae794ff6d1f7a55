"""Keys, labels and list texts as column expressions, and injected normalisers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def list_length(text: Column) -> Column:
    """The length of a list written as text; 1 for anything that is not one."""
    return F.coalesce(F.size(F.from_json(text, "array<double>")), F.lit(1))


def target_key(key: Column, value: Column, decimals: int = 10) -> Column:
    return F.concat_ws("||", key, F.format_string(f"%.{decimals}f", value))


def sentinel(value: Column, source: Column, prefix: str) -> Column:
    return F.coalesce(value, F.concat(F.lit(prefix), source))


def normaliser(f: Callable[[str], str | None], kind: str = "string"):
    """An Arrow function over an injected text normaliser; null or failing texts give null.

    Each distinct text of a batch is normalised once.
    """

    def one(x: str):
        try:
            return f(x)
        except Exception:
            return None

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known = {x: one(x) for x in s.dropna().unique()}
        return pd.Series([known.get(x) for x in s], dtype=object)

    return run


def key_parts(f: Callable[[str], tuple[str | None, str | None, str | None]]):
    """An Arrow function whose struct result holds three keys of a text."""

    @F.pandas_udf("can string, ik string, ik_ns string")
    def run(s: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for x in s.dropna().unique():
            try:
                known[x] = f(x)
            except Exception:
                known[x] = (None, None, None)
        return pd.DataFrame([known.get(x, (None, None, None)) for x in s], columns=["can", "ik", "ik_ns"])

    return run
