"""Helpers shared by the corpus operators: scratch tables, Arrow text chunks, vectorised word and shingle hashes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.session import checkpoint_dir

CHUNK_BYTES = 1 << 21
"""Text is hashed in chunks of so many bytes, or one text if that is longer."""

_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            remove_path(spark, path)
        except Exception:  # the session has ended; the cluster's own clean-up takes the folder
            return


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: survives lost executors, and is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, path)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key() -> F.Column:
    """Identity of a document row: equal rows share it, and are treated alike."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without gaps, and the n + 1 offsets. Nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
LOWERED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
STEP = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = np.uint64(0xD6E8FEB86659FD93)) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


PLAIN_WORD = IN_WORD.copy()
PLAIN_WORD[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lowered, and the n + 1 word offsets of the texts.

    Words are split at space and 0x09-0x0D, with ``PLAIN_WORD`` at ASCII punctuation too."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = in_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    values = BYTE_VALUE[LOWERED[data]]
    place[~inside] = 0
    values *= powers(int(place.max()) + 1)[place]
    values[~inside] = 0
    return mixed(np.add.reduceat(values, starts)), np.searchsorted(starts, offsets)


def word_lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each word that ``word_hashes`` hashes."""
    inside = IN_WORD[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[1:-1] = inside[1:] & ~inside[:-1] if len(data) else False
    edges[offsets[:-1]] = True
    edges = np.flatnonzero(edges[:-1])
    counts = np.add.reduceat(inside, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64)
    return counts[counts > 0]


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words of each text, repeats included; a text of fewer words has its whole sequence as one.

    Returns them with the m + 1 offsets of the texts."""
    lengths = np.diff(bounds)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(bounds[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    length = np.repeat(np.minimum(lengths, n), counts)
    out = length.astype(np.uint64) * STEP
    for j, factor in enumerate(powers(n, np.uint64(0xD1342543DE82EF95))):
        inside = j < length
        if inside.all():
            out += words[first + j] * factor
        else:
            out[inside] += words[first[inside] + j] * factor
    return mixed(out), ends


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
