"""Two Bloom filters over 64-bit hashes, for what was seen once and what was seen twice.

Tasks send, for every part of the filter, the bits their hashes set; merging ORs them into the first filter, and what
was set before into the second. A hash seen twice has both of its bits in the second filter, so none is missed; hashes
that only share bits pass too, and an exact step follows. The filter has at most MOST_BITS bits whatever the corpus
(32 MB, so it may be broadcast): a larger corpus lets more hashes through to the exact step, and loses none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART_BITS = 20
MOST_BITS = 28
FLUSH = 1 << 18
SLOT_SCHEMA = "part int, once binary, twice binary"


def filter_bits(expected: int) -> int:
    """Logarithm of the filter's size: about eight bits for each expected hash."""
    return int(min(MOST_BITS, max(PART_BITS, int(np.ceil(np.log2(max(1, expected) * 8))))))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << PART_BITS) - 1)
    part = (hashes >> np.uint64(44)) & np.uint64((1 << (bits - PART_BITS)) - 1) if bits > PART_BITS else np.zeros(len(hashes), np.uint64)
    base = part << np.uint64(PART_BITS)
    return base | (hashes & low), base | ((hashes >> np.uint64(PART_BITS)) & low)


def _packed(places: np.ndarray) -> bytes:
    """Gaps of ascending places, compressed; all low bytes first, as the other bytes are mostly 0."""
    return zlib.compress(np.diff(places, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(gaps), np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def slot_batches(arrays: Iterable[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, once, twice) with the bits that these hashes set, and those set more than once."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        a, b = _places(np.concatenate(held), bits)
        places, n = np.unique(np.concatenate([a, b[b != a]]), return_counts=True)
        part = (places >> np.uint64(PART_BITS)).astype(np.int32)
        at = (places & np.uint64((1 << PART_BITS) - 1)).astype(np.uint32)
        parts, firsts = np.unique(part, return_index=True)
        bounds = [*firsts, len(part)]
        rows = [(int(p), at[i:j], n[i:j] > 1) for p, i, j in zip(parts, bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _, _ in rows], pa.int32()), pa.array([_packed(x) for _, x, _ in rows], pa.binary()),
            pa.array([_packed(x[t]) for _, x, t in rows], pa.binary())], names=["part", "once", "twice"])

    for hashes in arrays:
        if len(hashes):
            held.append(hashes)
            size += len(hashes)
        if size >= FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _merged(second: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: one pair of bitmaps at a time, of which the second or the first is wanted."""
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice if second else once, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    for batch in batches:
        for part, seen, again in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                if now is not None:
                    yield done()
                now, once, twice = part, np.zeros(1 << PART_BITS, bool), np.zeros(1 << PART_BITS, bool)
            at = _unpacked(seen)
            twice[at] |= once[at]
            once[at] = True
            twice[_unpacked(again)] = True
    if now is not None:
        yield done()


def twice_filter(slots: DataFrame, bits: int, second: bool = True) -> np.ndarray:
    """The second filter (or the first) as bytes, at most 2 ** (MOST_BITS - 3) of them."""
    n = max(1, min(1 << (bits - PART_BITS), int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    merged = slots.repartition(n, "part").sortWithinPartitions("part").mapInArrow(partial(_merged, second), "part int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    for row in merged.collect():  # of bounded size, see MOST_BITS
        out[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def matching(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``texts`` (row, text) those whose row may be in ``wanted`` (row): a join with ``wanted`` then shuffles few others."""
    bits = filter_bits(wanted.count())

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return slot_batches((b.column(0).to_numpy().view(np.uint64) for b in batches), bits)

    known = texts.sparkSession.sparkContext.broadcast(twice_filter(wanted.select("row").mapInArrow(slots, SLOT_SCHEMA), bits, second=False))  # at most 32 MB

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = suspect(known.value, bits)
        for batch in batches:
            yield batch.filter(pa.array(maybe(batch.column(0).to_numpy().view(np.uint64))))

    return texts.select("row", "text").mapInArrow(keep, "row long, text string")


def suspect(filter_bytes: np.ndarray, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which hashes may be in the filter."""

    def test(hashes: np.ndarray) -> np.ndarray:
        a, b = _places(hashes, bits)
        return ((filter_bytes[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (filter_bytes[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    return test
