"""Orders over whole tables or hot keys without a task that holds them: rows are dealt to ranges, and only a range's edges and totals meet others."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df, in the shared folder."""
    folder = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle and sort: sizes of exploded, grouped and compressed rows are estimated far too low, and a broadcast planned on them passes whole through the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df in as many ranges of an order as shuffles have partitions, for work on few bytes that the size of the files would leave to few tasks."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)


def ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df dealt to ranges of an order, with their number in _range; rows equal in the order share one."""
    return kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with `name`: 1, 2, 3... within each key (none: in all), in an order that tells all rows of a key apart."""
    dealt = ranges(df, [*map(F.col, by), *order])
    sizes = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a key and range
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return dealt.withColumn("_here", here).join(offsets, [*by, "_range"]).withColumn(name, F.col("_here") + F.col("_before")).drop("_here", "_before", "_range")


def filled(df: DataFrame, by: Sequence[str], order: Sequence[Column], values: dict[str, Column], forward: bool = False, own: bool = True, bucket: Column | None = None) -> DataFrame:
    """df with, for each name, the last value that isn't null before a row of its key in the order, or the first after it (forward); with `own` the row itself counts.

    bucket, which never falls along the order (a month of a time), parts a key's rows in place of sampled ranges, which need df twice and a written copy of it.
    """
    dealt = ranges(df, [*map(F.col, by), order[0]]) if bucket is None else df.withColumn("_range", bucket)
    dealt = dealt.withColumns({f"_{n}": c for n, c in values.items()})
    # forward is backward in the order turned round: a frame from each row to the end is worked out anew a row, one from the start goes along
    turned = (lambda c: c.desc()) if forward else (lambda c: c)
    rows = Window.partitionBy(*by, "_range").orderBy(*[turned(c) for c in order])
    upto = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    near = dealt.withColumns({f"_near_{n}": F.last(f"_{n}", ignorenulls=True).over(upto(rows, 0 if own else -1)) for n in values})
    at = F.struct(*[F.row_number().over(rows).alias("n")])
    edges = dealt.withColumn("_at", at).groupBy(*by, "_range").agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("_at"))).alias(f"_edge_{n}") for n in values])
    far = upto(Window.partitionBy(*by).orderBy(turned(F.col("_range"))), -1)  # a row a key and range or bucket
    carried = edges.select(*by, "_range", *[F.last(f"_edge_{n}", ignorenulls=True).over(far).alias(f"_far_{n}") for n in values])
    out = near.join(carried, [*by, "_range"])
    return out.withColumns({n: F.coalesce(f"_near_{n}", f"_far_{n}") for n in values}).select(*[c for c in df.columns if c not in values], *values)


def percentiles(df: DataFrame, value: str, shares: Sequence[float], how: Sequence[str] | None = None) -> DataFrame:
    """One row with the exact percentiles p0, p1..., each interpolated ("linear") or the next observed value ("higher", "lower"): ranks of distinct values by running counts over ranges."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = ranges(counted, [F.col(value)])
    totals = dealt.groupBy("_range").agg(F.sum("_n").alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy(value)) + F.col("_before")
    placed = dealt.join(F.broadcast(offsets), "_range").withColumn("_upto", upto)
    whole = counted.agg(F.sum("_n").alias("_all"))
    placed = placed.join(F.broadcast(whole))  # one row
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col(value).cast("double")))
    place = [(F.col("_all") - 1) * F.lit(float(s)) for s in shares]
    found = placed.agg(F.first("_all").alias("_all"), *[at(F.floor(p)).alias(f"l{k}") for k, p in enumerate(place)], *[at(F.ceil(p)).alias(f"h{k}") for k, p in enumerate(place)])
    of = {"linear": lambda k, p: F.col(f"l{k}") + (p - F.floor(p)) * (F.col(f"h{k}") - F.col(f"l{k}")), "higher": lambda k, p: F.col(f"h{k}"), "lower": lambda k, p: F.col(f"l{k}")}
    return found.select(*[of[how[k] if how else "linear"](k, p).alias(f"p{k}") for k, p in enumerate(place)])
