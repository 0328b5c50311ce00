"""Reading tables whose columns drift: aliases, lenient casts, missing columns as null, required keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lenient(x: Column, kind: str) -> Column:
    """The value as that type, null where it isn't one; blanks around it don't count."""
    text = F.trim(x.cast("string"))
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)
    return F.try_to_timestamp(text) if kind == "timestamp" else text if kind == "string" else text.try_cast("double").cast(kind) if kind in ("bigint", "int") else text.try_cast(kind)


def contracted(df: DataFrame, columns: Mapping[str, str], aliases: Mapping[str, Sequence[str]] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """The contract's columns in its order and types, each from its own name or the first alias that df has, else null.

    Rows without a required key go. Whole numbers may be written with decimals. Other columns are left behind.
    """
    have, picked = set(df.columns), []
    for name, kind in columns.items():
        source = next((c for c in (name, *(aliases or {}).get(name, ())) if c in have), None)
        picked.append((lenient(F.col(f"`{source}`"), kind) if source else F.lit(None).cast(kind)).alias(name))
    return df.select(*picked).dropna(subset=list(required)) if required else df.select(*picked)


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], **how) -> DataFrame:
    """CSV files with a header, read as text and then held to the contract; files may differ in their columns."""
    from functools import reduce

    files = sorted({r["f"] for r in spark.read.format("binaryFile").load(path).select(F.col("path").alias("f")).collect()})
    frames = [contracted(spark.read.csv(f, header=True, inferSchema=False), columns, **how) for f in files]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in columns.items()))
