"""Column pruning shared by readers and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without columns that hold no value; one aggregation."""
    names = df.columns
    if not names:
        return df
    n, *filled = df.agg(F.count("*"), *[F.count(F.col("`" + c.replace("`", "``") + "`")) for c in names]).first()
    return df if not n else df.select(*[F.col("`" + c.replace("`", "``") + "`") for c, k in zip(names, filled, strict=True) if k])
