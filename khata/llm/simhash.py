"""Document fingerprints by SimHash.

Terms are three-word shingles, weighted by 1 + log2 of their frequency in the text; in texts under SHORT bytes, which have few of
them, also runs of GRAM bytes, with a weight that falls to 0 towards that length. Each term's 128-bit hash votes with its
weight for or against every bit. Likeness of two fingerprints is the cosine that their Hamming distance stands for, 0 where that is negative.

``near_pairs`` finds all pairs of fingerprints within a Hamming radius: bits are cut into ``blocks``, and fingerprints that differ in
at most ``radius`` bits have a block in which they differ in at most ``radius // blocks``. Each block is a table keyed by its bits; the
few queries have a key for every flip of so many bits, all the others a single one. Equal fingerprints are one row with a count, from
which ``within_radius`` has the number of rows.

Defined cases: null and empty texts, or texts without words, have the fingerprint 0. Equal texts have equal fingerprints, equal
rows equal results. Rows are in descending order of doc_id (nulls last, ties by a hash of the row); the row after the last is the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, bytes_of, chunks, mixed, partitions_of, row_key, shingle_hashes, signed, word_hashes

BITS = 128
WORDS = 3
SHORT, GRAM = 512, 5
PROBES = 4096
"""Most keys of a query for one block."""
MADE = 1 << 16
"""Keys that are made together."""


def votes(hashes: np.ndarray, text: np.ndarray) -> bytes:
    """The fingerprint of a text, from its shingles' hashes and its bytes."""
    if not len(hashes):
        return bytes(BITS // 8)
    terms, n = np.unique(hashes, return_counts=True)
    weight = (1 + np.log2(n)).astype(np.float32)
    if GRAM <= len(text) < SHORT:
        small = LOWERED[text].astype(np.uint64)
        runs = sum(small[i:len(small) - GRAM + 1 + i] << np.uint64(8 * i) for i in range(GRAM))
        grams, n = np.unique(mixed(runs), return_counts=True)
        terms = np.concatenate([terms, grams])
        weight = np.concatenate([weight, ((1 + np.log2(n)) * (1 - len(text) / SHORT)).astype(np.float32)])
    halves = np.stack([terms, mixed(terms ^ np.uint64(0x5851F42D4C957F2D))], 1)
    bits = np.unpackbits(halves.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(weight @ bits.astype(np.float32) > weight.sum() / 2, bitorder="little").tobytes()


def fingerprints(column: pa.Array) -> list[bytes]:
    out = []
    for _, _, data, offsets in chunks(*bytes_of(column)):
        hashes, ends = shingle_hashes(*word_hashes(data, offsets), WORDS)
        out += [votes(hashes[a:b], data[i:j]) for a, b, i, j in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])]
    return out


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(v), np.uint64).reshape(len(v), BITS // 64) for v in (a, b))
    apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return np.where(apart == 0, 1.0, np.maximum(0.0, np.cos(np.pi * apart / BITS)))


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, closing, doc_id, row, text): each bucket has a range of ids in descending order, and behind them, with
    ``closing``, the first row of the bucket that follows (the first of all behind the last)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    n = partitions_of(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    edges = np.array(sorted(set(cuts)), np.int64)  # as many as partitions, at most

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32))

    placed = rows.withColumn("bucket", place(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "row")).alias("h")).collect()  # one row for each bucket
    heads = sorted(heads, key=lambda r: -r["bucket"])
    following = [(r["bucket"], s["h"]["row"]) for r, s in zip(heads, [*heads[1:], *heads[:1]])]
    if not following:
        return placed.withColumn("closing", F.lit(False))
    after = F.broadcast(spark.createDataFrame(following, "bucket int, row long"))
    closers = rows.join(after, "row").select("doc_id", "row", "text", "bucket", F.lit(True).alias("closing"))
    both = placed.withColumn("closing", F.lit(False)).unionByName(closers)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "closing", F.desc_nulls_last("doc_id"), F.desc("row"))


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, closing, doc_id, row, text) as ``in_order`` has them."""
    held = None  # the last row so far: bucket, closing, doc_id, text, fingerprint
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("bucket", "closing", "doc_id", "text")]
        rows = [(b, c, i, t or "", p) for b, c, i, t, p in zip(*columns, fingerprints(batch.column("text")))]
        rows = [held, *rows] if held else rows
        pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
        held = rows[-1] if rows else None
        edited = [x[3][:len(x[3]) - len(x[3]) // 3] + y[3][:len(x[3]) // 3] for x, y in pairs]
        own, after, changed = [x[4] for x, _ in pairs], [y[4] for _, y in pairs], fingerprints(pa.array(edited, pa.string()))
        yield pa.RecordBatch.from_arrays([
            pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
            pa.array([p[::-1].hex() for p in own], pa.string()), pa.array([p[::-1].hex() for p in changed], pa.string()),
            pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, after), pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_edits(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, and that of its text with the last third replaced by the next document's beginning."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).select("bucket", "closing", "doc_id", "row", "text").mapInArrow(_edited, schema)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[::-1].hex() for p in fingerprints(batch.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def halves(prints: list[str]) -> np.ndarray:
    """Fingerprints in hexadecimal as rows of two 64-bit numbers, the high one first."""
    return np.frombuffer(bytes.fromhex("".join(prints)), ">u8").astype(np.uint64).reshape(-1, 2)


def block_of(high: np.ndarray | F.Column, low: np.ndarray | F.Column, i: int, size: int) -> tuple:
    """The 64-bit number that holds block i of ``size`` bits, and how far it is to be shifted right."""
    at = i * size
    return (high if at < 64 else low), 64 - size - at % 64


def flips(size: int, reach: int) -> np.ndarray:
    """All patterns of at most ``reach`` of ``size`` bits."""
    return np.array([sum(1 << b for b in chosen) for n in range(reach + 1) for chosen in combinations(range(size), n)], np.uint64)


def table_keys(prints: np.ndarray, blocks: int, reach: int = 0) -> np.ndarray:
    """A row for each of the fingerprints, with a key for each block (its place and bits) and for each flip of up to ``reach`` of its bits."""
    size = BITS // blocks
    flipped, out = flips(size, reach), []
    for i in range(blocks):
        number, shift = block_of(prints[:, 0], prints[:, 1], i, size)
        bits = (number >> np.uint64(shift)) & np.uint64((1 << size) - 1)
        out.append((bits[:, None] ^ flipped) | np.uint64(i << size))
    return np.concatenate(out, 1)


def _tables(prints: DataFrame, side: str, blocks: int, reach: int) -> DataFrame:
    """Fingerprints and their n as (key, high, low, n), a row for each key; names end in ``side``."""

    some = max(1, MADE // (blocks * len(flips(BITS // blocks, reach))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, some):
                part = batch.slice(at, some)
                cut = halves(part.column(0).to_pylist())
                keys = table_keys(cut, blocks, reach)
                row = np.repeat(np.arange(len(keys)), keys.shape[1])
                columns = [signed(keys.ravel()), signed(cut[row, 0]), signed(cut[row, 1]), part.column(1).to_numpy()[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    names = [f"{c}{side}" for c in ("key", "high", "low", "n")]
    return prints.select("fingerprint", "n").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def near_pairs(prints: DataFrame, queries: DataFrame, radius: int, blocks: int = 8) -> DataFrame:
    """(fingerprint, other, distance, n): every distinct fingerprint of ``queries`` with every one of ``prints`` within ``radius``
    bits, itself included, once; n is the number of rows of ``prints`` that have ``other``."""
    if not 0 <= radius <= BITS or blocks < 2 or BITS % blocks or 64 % (size := BITS // blocks):
        raise ValueError(f"radius must be 0 to {BITS}, and blocks a power of two from 2 to {BITS}")
    reach = radius // blocks
    if sum(comb(size, k) for k in range(reach + 1)) > PROBES:
        raise ValueError(f"a query would have over {PROBES} keys for a block; take other blocks")
    given = F.col("fingerprint").isNotNull()
    # queries become many more rows than their size lets Spark expect: they are dealt out first (by another
    # hash, or Spark would leave that out), and never broadcast
    asked = queries.where(given).groupBy("fingerprint").agg(F.count("*").alias("n")).repartition(partitions_of(queries.sparkSession), F.xxhash64("fingerprint"))
    left = _tables(asked, "_q", blocks, reach).hint("merge")
    right = _tables(prints.where(given).groupBy("fingerprint").agg(F.count("*").alias("n")), "", blocks, 0)
    high, low = F.col("high_q").bitwiseXOR(F.col("high")), F.col("low_q").bitwiseXOR(F.col("low"))
    distance = F.bit_count(high) + F.bit_count(low)
    # of all blocks in which two fingerprints are close enough, the first yields the pair
    first = F.lit(None).cast("long")
    for i in reversed(range(blocks)):
        number, shift = block_of(high, low, i, size)
        apart = F.bit_count(F.shiftrightunsigned(number, shift).bitwiseAND(F.lit((1 << size) - 1)))
        first = F.when(apart <= reach, F.lit(i).cast("long")).otherwise(first)
    met = left.join(right, (F.col("key_q") == F.col("key")) & (distance <= radius) & (F.shiftrightunsigned("key", size) == first))

    def shown(side: str) -> F.Column:
        return F.lower(F.concat(*(F.lpad(F.hex(f"{c}{side}"), 16, "0") for c in ("high", "low"))))

    return met.select(shown("_q").alias("fingerprint"), shown("").alias("other"), distance.alias("distance"), "n")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """(fingerprint, n_near): for each distinct fingerprint of ``queries`` the rows of ``prints`` within ``radius`` bits, itself included."""
    return near_pairs(prints, queries, radius, blocks).groupBy("fingerprint").agg(F.sum("n").alias("n_near"))
