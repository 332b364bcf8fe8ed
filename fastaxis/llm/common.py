"""What several operators share: byte-level text tools on Arrow batches, hashing, shared folders.

The numpy tools work on slices of a few megabytes, so that a Python worker's memory does
not depend on the size of a partition.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fastaxis.plans.cutting import shared_folder

#: Bytes of text that one numpy pass takes at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of a row group of a written table.
ROW_GROUP = 16 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_writing, _writers = threading.Lock(), {"n": 0, "before": "false"}


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """While anything is written, shuffle files go as soon as their job has ended; the last writer restores the setting."""
    with _writing:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers["n"] += 1
    try:
        yield
    finally:
        with _writing:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(_CLEANUP, _writers["before"])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    The files stay as long as the session's other checkpoint files; remove() deletes them. Row
    groups are small, so that tables of texts take little memory to write and to read.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    with _shuffle_files_removed(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), when their last reader is done."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its UTF-8 bytes and the n + 1 offsets; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


#: Byte tables: words between white space, A-Z lower-cased; the same without lower-casing.
def white_table(lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[9:14] = 32
    if lower:
        t[65:91] += 32
    return t


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 32, cut at document ends, and each document's first word (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = data != 32
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    at = inner[(inner > 0) & (inner < n)]
    start[at] = word[at]
    end[at - 1] = word[at - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    pw, inv = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams of each document's words, and the n + 1 offsets of each document's k-grams.

    ``first`` holds each document's first word. A document of fewer words than k, but not
    none, has its whole sequence as its one gram.
    """
    counts = np.diff(first)
    grams = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(grams)])
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), to
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    doc_end = np.repeat(first[1:], counts)
    at = np.arange(n)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(at + j < doc_end, padded[j : j + n], np.uint64(0x1B873593))
    keep = (at + k <= doc_end) | (np.repeat(first[:-1], counts) == at)
    return mix(h)[keep], to


def sketch(values: DataFrame, hashed: Column, size: int) -> np.ndarray:
    """A bit for each of ``size`` (a power of two) residues of a column's hashes: a table of fixed size, as 64-bit words."""
    bit = F.pmod(hashed, F.lit(size))
    words = values.select(bit.alias("bit")).select(F.floor(F.col("bit") / 64).alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[np.asarray(words["at"].combine_chunks(), np.int64)] = np.asarray(words["bits"].combine_chunks(), np.int64)
    return table.view(np.uint64)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a sketch can't rule out."""
    at = hashes.astype(np.uint64) & np.uint64(64 * len(table) - 1)
    return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows: the check before any broadcast."""
    return df.limit(rows + 1).count() <= rows


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*[F.col(c) for c in columns]) if columns else df


def frequency_cut(df: DataFrame, n: str, rows: int) -> Column:
    """Which rows are those of the largest n, at most ``rows`` of them: those above a cut that a histogram of fixed size finds.

    Nothing is sorted, and no task or driver sees more than the rows that stay.
    """
    level = F.floor(F.log2(F.col(n)) * 16)
    found, held, cut = sorted(map(tuple, df.groupBy(level.alias("level")).count().collect()), reverse=True), 0, None
    for at, count in found:
        held += count
        if held > rows:
            break
        cut = at
    return level >= cut if cut is not None else F.lit(False)


def hash_filter(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About twice ``rows`` of a table of ``total`` rows, those of the least hashes of a column; all of a smaller table."""
    if total <= 2 * rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * min(1.0, (2 * rows + 1000) / total)))


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` of a table of ``total`` rows, by the least hashes of a column.

    The filter comes first, so that the sort's partial results stay small however many tasks
    there are. The rows that stay meet in one task: they should be narrow.
    """
    return hash_filter(df, key, rows, total).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(rows)
