"""What the corpus operators share: text constants, scratch tables in the shared folder, hot-key splits and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters 0x20 and 0x09 to 0x0D, as a regex class body for Java and Python.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{WS}]+"
#: At most this many keys can each hold more than 1/HOT_KEYS of all rows, so a broadcast of such keys is bounded.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, in full (a path without a scheme is one of the default file system).

    Where it is unset, a local session (tests) gets a temporary folder, and a cluster an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a parquet table in the shared folder: lineage ends here and any executor can read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, so that they clash with no other name on the way."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns])


def row_hash(df: DataFrame) -> Column:
    """A hash of all values of a row (but maps and variants, which have none), to order rows that are equal in everything else."""
    told = [F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[x for c in told for x in (c.isNull(), c)]) if told else F.lit(0).cast("long")


def dealt_by_id(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt to ranges of ascending doc_id (null first), then a hash of the text, then `place`, which only tells equal rows apart: a range of them may hold a part of the rows of an id, however many share it. Sorted within each range."""
    keyed = rows.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.col("h"), F.col("place")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with a column for each of `sums`: its sum over all rows up to and with this one, in an order that tells all rows apart.

    Rows are dealt to ranges of the order and summed there; of a range only its totals meet others, so no task holds all rows.
    """
    ranges = written(df.withColumns({f"_{c}": x for c, x in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranges.groupBy("_range").agg(*[F.sum(f"_{c}").alias(f"_before_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_before_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranges.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, *[(F.sum(f"_{c}").over(here) + F.col(f"_before_{c}")).alias(c) for c in sums])


def frequent(df: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Candidates for keys that hold more than n_rows / HOT_KEYS rows, by the Misra-Gries counters of freqItems: at most HOT_KEYS rows, none of the true ones missing."""
    found = df.select(F.col(key).alias("k")).freqItems(["k"], support=1.0 / HOT_KEYS)
    return found.select(F.explode("k_freqItems").alias(key)).where(F.col(key).isNotNull())


# -- vectorised hashing of words --------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_STEP = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_SPACE = np.zeros(256, bool)
_SPACE[list(WS_CHARS.encode())] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with well-spread bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2**64, n at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_STEP[which]), -1, 2**64))
        ups, downs = np.full(size, _STEP[which]), np.full(size, inverse)
        ups[0] = downs[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    return have


class Words:
    """The words of a run of texts: where each starts and ends in the bytes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        full = ~_SPACE[data] if n else np.zeros(0, bool)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = full[:-1], full[1:]
            firsts, lasts = offsets[:-1], offsets[1:]
            before[firsts[firsts < n]] = False
            after[lasts[lasts > 0] - 1] = False
        self.starts = np.flatnonzero(full & ~before)
        self.ends = np.flatnonzero(full & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # words of text i: first[i] to first[i + 1]
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0, at_once: int = 1 << 18) -> np.ndarray:
        """A 64-bit hash of each word's bytes, from running sums over about `at_once` bytes at a time."""
        out, k = np.empty(len(self.starts), np.uint64), 0
        while k < len(out):
            j = max(k + 1, int(np.searchsorted(self.ends, self.starts[k] + at_once, "right")))
            a, b = int(self.starts[k]), int(self.ends[j - 1])
            ups, downs = _powers(b - a + 1, which)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[which][self.data[a:b]] * ups[: b - a], out=sums[1:])
            starts, ends = self.starts[k:j] - a, self.ends[k:j] - a
            out[k:j] = mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64))
            k = j
        return out

    def windows(self, hashes: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of width words in one text: its hash, its first word, its text."""
        n = len(hashes) - width + 1
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        total, factor = np.zeros(n, np.uint64), np.uint64(1)
        for k in range(width):
            total += hashes[k : k + n] * factor
            factor = np.uint64((int(factor) * int(_STEP[1 - which])) % 2**64)
        at = np.flatnonzero(text[:n] == text[width - 1 :])
        return mix(total[at]), at, text[at]


def text_slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a string array of about `most` bytes (a longer text is a run of its own): first and last index, bytes, offsets from 0. Null counts as empty."""
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
