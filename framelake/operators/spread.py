"""Tasks that grow in number, not in size, with what they sort."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task, about.
ROWS = 2_000_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` over so many partitions that each has about ``rows`` rows; as it is if ``spark.sql.shuffle.partitions`` is enough for that."""
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
