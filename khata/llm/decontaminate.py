"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects from a run of words; masked positions may differ. Seeds of
the benchmark's items and of the documents are joined, and around every hit the aligned words are compared: a document holds a
passage of an item if some window of ``window`` words of the item (the whole item, if it is shorter) equals the document's
words at ``percent`` of the positions or more. Items shorter than the masks are cut into one block more than the words that may
differ, and each block is a seed: one of them is whole.

Documents' seeds are looked up in a Bloom filter of the items' seeds first (of bounded size, so it is broadcast): only
hits, with the words around them, are shuffled. The join is left to Spark, as benchmarks can be large.

Words are split at white space and ASCII punctuation, A-Z lowered. Defined cases: null or empty texts and items hold no
passage and are in none. Repeated rows of documents get the same result; of repeated items, every id is reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, bytes_of, chunks, mixed, partitions_of, powers, row_key, signed, word_hashes

MASKS = ("1101111", "1100010111", "11111001", "110100111")
"""1 selects a word. In windows of 12 to 20 words, one of these masks fits somewhere between any mismatches of up to a fifth of the
words (found by greedy search, and tested for all placements); so at 80 percent no passage is missed."""
SPAN = 12
"""Items of fewer words are short."""
WINDOW = 20
REACH = WINDOW
"""Words kept on both sides of a seed: a window that covers the seed lies within."""
BLOOM_BITS = 24


def short_masks(words: int, percent: int) -> list[str]:
    """Masks for items of so many words, fewer than SPAN."""
    blocks = words - -(-percent * words // 100) + 1
    cuts = [words * k // blocks for k in range(blocks + 1)]
    return ["".join("1" if a <= i < b else "0" for i in range(words)) for a, b in zip(cuts, cuts[1:])]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the selected words of every run of ``len(mask)`` words."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), np.uint64(int("1" + mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64)
    if n > 0:
        for i, factor in zip((i for i, c in enumerate(mask) if c == "1"), powers(len(mask), np.uint64(0xA0761D6478BD642F))):
            out += words[i:i + n] * factor
    return mixed(out)


def around(words: np.ndarray, places: np.ndarray, outside: int) -> np.ndarray:
    """The 32-bit words from REACH before each place to REACH behind the longest seed; ``outside`` where the text has none."""
    padded = np.concatenate([np.full(REACH, outside), (words >> np.uint64(32)).astype(np.int64), np.full(REACH + SPAN, outside)])
    return padded[places[:, None] + np.arange(2 * REACH + SPAN)]


def _item_seeds(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, contexts, sizes = [], [], [], []
        for first, _, data, offsets in chunks(*bytes_of(batch.column(1))):
            words, bounds = word_hashes(data, offsets, PLAIN_WORD)
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                for mask in MASKS if b - a >= SPAN else short_masks(int(b - a), percent) if b > a else ():
                    found = seeds(words[a:b], mask)
                    ids += [batch.column(0)[first + k].as_py()] * len(found)
                    hashes += signed(found).tolist()
                    contexts += [x.tobytes() for x in around(words[a:b], np.arange(len(found)), -1)]
                    sizes += [int(b - a)] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(ids, pa.int64()), pa.array(contexts, pa.binary()), pa.array(sizes, pa.int32())], names=["seed", "item_id", "item_words", "size"])


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BLOOM_BITS) - 1)
    return hashes & low, (hashes >> np.uint64(32)) & low


def _bloom(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BLOOM_BITS, bool)
    for batch in batches:
        for place in _bits(batch.column(0).to_numpy().view(np.uint64)):
            bits[place] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])


def _matches(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of contexts that share a seed: rows (row, item_id) of those that agree in a window."""
    for batch in batches:
        n, width = batch.num_rows, 2 * REACH + SPAN
        keep = np.zeros(n, bool)
        if n:
            doc, item = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64).reshape(n, width) for i in (1, 3))
            size = batch.column(4).to_numpy()
            inside, equal = np.cumsum(np.pad(item >= 0, ((0, 0), (1, 0))), 1), np.cumsum(np.pad(doc == item, ((0, 0), (1, 0))), 1)
            for w in np.unique(np.minimum(size, WINDOW)):
                rows = np.minimum(size, WINDOW) == w
                whole = inside[rows, w:] - inside[rows, :-w] == w
                keep[rows] = (whole & (100 * (equal[rows, w:] - equal[rows, :-w]) >= percent * w)).any(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["row", "item_id"]).filter(pa.array(keep))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(row, item_id): document rows (see ``row_key``) that hold a passage of an item; each pair once."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").mapInArrow(partial(_item_seeds, percent), "seed long, item_id long, item_words binary, size int")
    bloom = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for part in items.select("seed").coalesce(min(8, partitions_of(spark))).mapInArrow(_bloom, "bits binary").collect():  # eight filters of 2 MB at most
        bloom |= np.frombuffer(part["bits"], np.uint8)
    lengths = sorted({r["size"] for r in items.where(F.col("size") < SPAN).select("size").distinct().collect()})  # eleven at most
    masks = [*MASKS, *(m for n in lengths for m in short_masks(n, percent))]
    known = spark.sparkContext.broadcast(bloom)

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            rows, hashes, contexts = [], [np.zeros(0, np.uint64)], [np.zeros((0, 2 * REACH + SPAN), np.int64)]
            for first, _, data, offsets in chunks(*bytes_of(batch.column(1))):
                words, bounds = word_hashes(data, offsets, PLAIN_WORD)
                for mask in masks:
                    found = seeds(words, mask)
                    a, b = _bits(found)
                    at = np.flatnonzero((bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1)
                    owner = np.searchsorted(bounds, at, "right") - 1
                    at, owner = (x[at + len(mask) <= bounds[owner + 1]] for x in (at, owner))
                    for k in np.unique(owner):
                        place = at[owner == k]
                        rows += [batch.column(0)[first + int(k)].as_py()] * len(place)
                        hashes.append(found[place])
                        contexts.append(around(words[bounds[k]:bounds[k + 1]], place - bounds[k], -2))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hashes))), pa.array(rows, pa.int64()), pa.array([x.tobytes() for x in np.concatenate(contexts)], pa.binary())], names=["seed", "row", "doc_words"])

    found = docs.where(F.col("text").isNotNull()).select(row_key().alias("row"), "text").mapInArrow(hits, "seed long, row long, doc_words binary")
    # the same seed and words around it, in a row and an item, are compared once
    pairs = found.distinct().join(items.distinct(), "seed").select("row", "doc_words", "item_id", "item_words", "size")
    return pairs.mapInArrow(partial(_matches, percent), "row long, item_id long").distinct()


def report(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) for each document row."""
    # an array for a document holds no more than the items whose passages its text has room for
    found = leaks(docs, benchmark, percent).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"))
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return rows.join(found, "row", "left").select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns."""
    found = leaks(docs, benchmark, percent).select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", row_key()).join(found, "_row", "left_anti").drop("_row")
