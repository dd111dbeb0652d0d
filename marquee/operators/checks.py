"""Argument checks that cost no job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, *columns: str, error: type[Exception] = KeyError) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise error(f"columns are missing: {', '.join(lacking)}")
    return df
