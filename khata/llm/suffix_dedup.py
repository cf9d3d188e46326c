"""Exact substring de-duplication by suffix arrays of shards.

Every byte that is covered by a string of ``length`` bytes which also starts elsewhere is removed.

1. Anchors. A string's anchor is the run of GRAM bytes in it with the smallest hash, so equal strings have equal anchors at
   equal places. Two Bloom filters leave the anchors that may occur twice; an exact count follows. All else can't repeat.
2. Segments. The bytes around a repeated anchor that strings with this anchor can reach make its segment. Equal segments are
   one with a count; if it is two or more, all of the segment repeats.
3. Shards. Different segments of an anchor go to one shard, and a shard's suffixes are sorted by induction: the suffixes at
   local minima (S*) are ordered first, by ranks of the substrings between them that are doubled until they reach
   ``length``; left-type suffixes are induced from them in ascending and the others in descending order. Induced suffixes wait,
   with their common-prefix values, in a priority queue by (first symbol, order of arrival), whose runs lie on disk beyond QUEUE_ROWS rows.
   Neighbours in the sorted order with a common prefix of ``length`` or more are the repeats.
   Before sorting, a shard looks at the cores of its segments: strings that start within the same few bytes from the anchor share all
   but these bytes, so where no other segment has the same core nothing repeats, and that part needn't be sorted.
4. The spans found are joined to every copy of their segments, and the documents are cut.

Defined cases: a null text is empty; a text shorter than ``length`` stays whole. Repeated rows are documents: each other's copies. Other columns pass.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, bytes_of, discard, mixed, partitions_of, powers, row_key, signed, written
from .sightings import SLOT_SCHEMA, filter_bits, matching, slot_batches, suspect, twice_filter

QUEUE_ROWS = 1 << 20
SHARD_BYTES = 1 << 20
TASK_SHARDS = 16
ROW = "_row"


def gram_of(length: int) -> int:
    return 8 * max(1, min(4, length // 16))


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings of ``length`` bytes; all of equal smallest ones."""
    gram, n = gram_of(length), len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    eight = np.empty(n - 7, np.uint64)
    for r in range(8):
        part = data[r:r + (n - r) // 8 * 8].view("<u8")
        eight[r::8] = part
    h = np.zeros(n - gram + 1, np.uint64)
    for k, factor in zip(range(0, gram, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        h += eight[k:k + len(h)] * np.uint64(factor)
    h = mixed(h)
    span = length - gram + 1

    def sliding(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
        width = 1
        while 2 * width <= span:
            x = pick(x[:-width], x[width:])
            width *= 2
        return pick(x[:len(x) - (span - width)], x[span - width:]) if width < span else x

    least = sliding(h, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), np.maximum) == h)
    return at, h[at]


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = bytes_of(column)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield data[a:b]


# --- induced sorting of one shard

class SuffixQueue:
    """A bulk priority queue of (suffix, common prefix with the one before): by first symbol, then by arrival."""

    def __init__(self, symbols: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.arrived = np.zeros(symbols, np.int64)
        self.size, self.file = 0, None

    def push(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.held[symbol].append((suffixes, common))
        self.arrived[symbol] += len(suffixes)
        self.size += len(suffixes)
        if self.size > QUEUE_ROWS:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, held in enumerate(self.held):
            if held:
                a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                self.runs[symbol].append((self.file.tell(), len(a)))
                self.file.write(a.tobytes())
                self.file.write(b.tobytes())
                self.held[symbol] = []
        self.size = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All that waits with this first symbol, in order of arrival."""
        out = []
        for start, n in self.runs[symbol]:
            self.file.seek(start)
            out.append((np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.int16)))
        self.size -= sum(len(h[0]) for h in self.held[symbol])
        out += self.held[symbol]
        self.runs[symbol], self.held[symbol] = [], []
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int16))


class Prefixes:
    """Common prefixes of suffixes of a text that ends in a symbol of its own.

    A few symbols are compared directly; longer ones by halving, with 64-bit hashes of the text's beginnings."""

    def __init__(self, text: np.ndarray, most: int):
        self.most, self.size = most, len(text)
        wide = np.concatenate([text, np.full(16, 0, text.dtype)]).astype(np.uint64)
        self.four = wide[:-3] | (wide[1:-2] << np.uint64(16)) | (wide[2:-1] << np.uint64(32)) | (wide[3:] << np.uint64(48))
        self.power = powers(len(text) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(text.astype(np.uint64) + np.uint64(1)) * self.power[:-1], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths for the pairs of suffixes ``a`` and ``b``, up to ``most``."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for _ in range(3):
            apart = self.four[np.minimum(a[live] + out[live], self.size)] ^ self.four[np.minimum(b[live] + out[live], self.size)]
            run = (apart == 0).astype(np.int8)
            for k in (1, 2, 3):
                run += apart & np.uint64((1 << (16 * k)) - 1) == 0
            out[live] += run
            live = live[run == 4]
        a, b, done = a[live], b[live], out[live]
        room = self.size - np.maximum(a, b)
        before_a, before_b, power_a, power_b = self.sums[a], self.sums[b], self.power[a], self.power[b]
        step = 1 << (self.most.bit_length() - 1)
        while step and len(live):
            length = done + step
            fits = length <= room
            x, y = np.where(fits, a + length, a), np.where(fits, b + length, b)
            same = (self.sums[x] - before_a) * power_b == (self.sums[y] - before_b) * power_a
            done = np.where(fits & same, length, done)
            step >>= 1
        out[live] = done
        return np.minimum(out, self.most)


def in_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by these keys, none of them negative; as one number with the row behind it wherever that fits into 63 bits."""
    n, packed, used = len(keys[0]), np.zeros(len(keys[0]), np.int64), 0
    row = max(n - 1, 1).bit_length()
    for key in keys:
        bits = int(key.max()).bit_length() if n else 0
        used += bits
        if used + row > 63:
            return np.lexsort(keys[::-1])
        packed = (packed << bits) | key
    packed = (packed << row) | np.arange(n)
    packed.sort()
    return packed & ((1 << row) - 1)


def local_minima_order(text: np.ndarray, small: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The S* suffixes in order, as far as ``depth`` symbols tell them apart, and which of them share these with the one before.

    Names of the substrings between them are their ranks, found a few symbols at a time; ranks of ever longer runs of
    names follow by doubling."""
    n = len(stars)
    length = np.append(stars[1:], len(text) - 1) - stars + 1
    coded = (text.astype(np.int64) << 1) + small
    dense = np.cumsum(np.bincount(coded) > 0)
    bits, coded = int(dense[-1]).bit_length(), np.append(dense[coded], np.zeros(8, np.int64))
    rank, offset, tied = np.zeros(n, np.int64), 0, np.arange(n)

    def refine(key: np.ndarray) -> np.ndarray:
        """Rank the tied by ``key`` within their ranks; marks of those that are still tied."""
        own = rank[tied]
        order = in_order(own, key)
        r, k = own[order], key[order]
        first = np.append(True, r[1:] != r[:-1])
        fresh = np.append(True, k[1:] != k[:-1]) | first
        place = np.arange(len(r))
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(r)))
        group_start = np.maximum.accumulate(np.where(first, place, 0))
        rank[tied[order]] = r + (np.repeat(starts, sizes) - group_start)
        left = np.zeros(len(r), bool)
        left[order] = np.repeat(sizes > 1, sizes)
        return left

    while len(tied):
        key = np.zeros(len(tied), np.int64)
        for k in range(4):
            inside = offset + k < length[tied]
            key = (key << bits) | np.where(inside, coded[np.minimum(stars[tied] + offset + k, len(coded) - 1)], 0)
        left = refine(key)
        offset += 4
        tied = tied[left & (length[tied] > offset)]
    counts = np.bincount(rank, minlength=n)
    tied, reach = np.flatnonzero(counts[rank] > 1), 1
    while reach < depth and len(tied):
        # what the names so far reach far enough for needs no order
        after = np.minimum(tied + reach, n - 1)
        tied = tied[(tied + reach >= n) | (stars[after] - stars[tied] < depth)]
        if not len(tied):
            break
        # all are ranked by what was behind them before any is ranked anew
        tied = tied[refine(np.where(tied + reach < n, rank[np.minimum(tied + reach, n - 1)] + 1, 0))]
        reach *= 2
    order = in_order(rank)
    return stars[order], np.append(False, np.diff(rank[order]) == 0)


def sorted_suffixes(text: np.ndarray, most: int, symbols: int = 258) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the suffix array, bucket by bucket from the last: (suffixes ascending, common prefix with the one before).

    ``text`` ends in its only 0. Order and common prefixes hold up to ``most`` symbols."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(known[::-1])[::-1]
    small = np.append(np.append(step, 1)[following] > 0, True)  # S-type: smaller than the next suffix
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, same = local_minima_order(text, small, stars, most) if len(stars) else (stars, np.zeros(0, bool))
    prefixes = Prefixes(text, most)
    star_common = np.full(len(order), most, np.int64)
    apart = np.flatnonzero(~same)
    star_common[apart[1:]] = prefixes.of(order[apart[1:] - 1], order[apart[1:]])
    star_common[:1] = 0
    star_symbol = text[order]
    starts, ends = np.searchsorted(star_symbol, np.arange(symbols)), np.searchsorted(star_symbol, np.arange(symbols), "right")

    def induce(queue: SuffixQueue, carried: np.ndarray, suffixes: np.ndarray, common: np.ndarray, smaller: bool) -> None:
        """Push the suffixes before these that are of the wanted type. ``carried``: least common prefix since a symbol's last push."""
        before = suffixes - 1
        wanted = np.flatnonzero((before >= 0) & (small[before] == smaller))
        symbol = text[before[wanted]]
        by = np.argsort(symbol, kind="stable")
        places, symbol = wanted[by], symbol[by]
        starts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])[:len(symbol)])
        values, lasts = symbol[starts], places[np.append(starts[1:], len(places))[:len(starts)] - 1]
        # least common prefix since the same symbol's place before: ranges as every other segment of one reduction
        ranges = np.empty(2 * len(places), np.int64)
        ranges[1::2] = places + 1
        ranges[2::2] = places[:-1] + 1
        ranges[2 * starts] = 0
        ended = np.append(common, most)
        least = np.minimum.reduceat(ended, ranges)[::2].astype(np.int64) if len(places) else np.zeros(0, np.int64)
        least[starts] = np.minimum(least[starts], carried[values])
        shared = np.minimum(least + 1, most)
        shared[starts[queue.arrived[values] == 0]] = 0
        np.minimum(carried, common.min() if len(common) else most, out=carried)
        carried[values] = np.minimum.accumulate(ended[::-1])[::-1][lasts + 1]
        found, shared = before[places], shared.astype(np.int16)
        for value, first, end in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)]):
            queue.push(value, found[first:end], shared[first:end])

    def drained(queue: SuffixQueue, carried: np.ndarray, symbol: int, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
        """The bucket's queue, with what its own suffixes add to it."""
        got = []
        while True:
            suffixes, common = queue.pop(symbol)
            if not len(suffixes):
                break
            got.append((suffixes, common))
            induce(queue, carried, suffixes, common, smaller)
        return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0, np.int64), np.zeros(0, np.int16))

    def between(a: np.ndarray, b: np.ndarray) -> int:
        return int(prefixes.of(a[-1:], b[:1])[0]) if len(a) and len(b) else 0

    large_queue, carried, large = SuffixQueue(symbols), np.zeros(symbols, np.int64), []
    for c in range(symbols):
        carried[:] = 0
        suffixes, common = drained(large_queue, carried, c, False)
        large.append((suffixes, common))
        seeds, seed_common = order[starts[c]:ends[c]], star_common[starts[c]:ends[c]].copy()
        if len(seeds):
            seed_common[0] = between(suffixes, seeds)
            induce(large_queue, carried, seeds, seed_common, False)
    small_queue = SuffixQueue(symbols)
    for c in reversed(range(symbols)):
        carried[:] = 0
        lesser, lesser_common = drained(small_queue, carried, c, True)  # in descending order
        suffixes, common = large[c]
        large[c] = None
        meet = between(suffixes, lesser[::-1])
        if len(suffixes):
            down = np.append(common[1:], 0)[::-1].copy()  # with the next larger one
            down[0] = meet
            induce(small_queue, carried, suffixes[::-1], down, True)
        ascending = np.concatenate([suffixes, lesser[::-1]])
        shared = common.astype(np.int64)
        if len(lesser):
            shared = np.concatenate([shared, [meet], lesser_common[:0:-1]])
        if len(ascending):
            shared[0] = 0
            yield ascending, shared


def repeated_starts(segments: list[bytes], owner: np.ndarray, place: np.ndarray, twice: np.ndarray, length: int) -> np.ndarray:
    """Marks of the places in the joined segments (one separator behind each, and one end mark) where a string starts that starts elsewhere too.

    ``owner`` and ``place`` say where a segment lies: the same place in two segments is one place. ``twice``: there are copies of the segment."""
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    text = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8).astype(np.int16) + 2
    first = np.cumsum(sizes) - sizes
    text[first + sizes - 1] = 1
    text[-1] = 0
    of = np.append(np.repeat(np.arange(len(segments)), sizes), len(segments) - 1)
    name = mixed(owner.view(np.uint64))[of] + (place[of] + np.arange(len(text)) - first[of]).astype(np.uint64)
    out = np.zeros(len(text), bool)
    for suffixes, common in sorted_suffixes(text, length):
        starts = np.flatnonzero(common < length)
        if len(starts) == len(suffixes) and not twice.any():
            continue
        ids, many = name[suffixes], twice[of[suffixes]]
        found = (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)) | np.logical_or.reduceat(many, starts)
        out[suffixes] = np.repeat(found, np.diff(np.append(starts, len(suffixes))))
    fits = np.arange(len(text)) + length <= first[of] + sizes[of] - 1
    return out & fits


BLOCKS = 8


def blocks(place: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The blocks of starts in segments of these anchors' places and sizes: (segment, block, first start, end start, core's begin, core's end).

    All strings that start in a block hold its core. Blocks lie at fixed distances from the anchor."""
    span = length - gram_of(length)
    width = -(-(span + 1) // BLOCKS)
    low = place[:, None] - span + np.arange(0, span + 1, width)
    high = np.minimum(low + width - 1, place[:, None])
    begin, end = np.maximum(low, 0), np.minimum(high, sizes[:, None] - length) + 1
    own, block = np.nonzero(begin < end)
    return own, block, begin[own, block], end[own, block], high[own, block], low[own, block] + length


def promising(anchor: np.ndarray, place: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first start, end start) of the strings whose core another segment of the anchor has too."""
    text = np.frombuffer(b"".join(data), np.uint8)
    power, sums = powers(len(text) + 1), np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[text] * power[:-1], dtype=np.uint64, out=sums[1:])
    sizes = np.array([len(d) for d in data], np.int64)
    offset = np.cumsum(sizes) - sizes
    own, block, begin, end, core, core_end = blocks(place, sizes, length)
    # a name that two cores share by chance only adds to what is sorted
    from_, to = offset[own] + core, offset[own] + core_end
    name = mixed((sums[to] - sums[from_]) * power[len(text) - from_]) + mixed(anchor[own].view(np.uint64) + block.astype(np.uint64))
    _, inverse, counts = np.unique(name, return_inverse=True, return_counts=True)
    kept = counts[inverse] > 1
    own, begin, end = own[kept], begin[kept], end[kept]
    fresh = np.append(True, (own[1:] != own[:-1]) | (begin[1:] != end[:-1]))[:len(own)]
    last = np.append(fresh[1:], True)[:len(own)]
    return own[fresh], begin[fresh], end[last]


# --- the jobs

def _segments_of(column: pa.Array, length: int, maybe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its (bytes, anchor hashes, anchors' places in their segments, segment starts, segment ends), of anchors that may occur twice."""
    gram = gram_of(length)
    for data in texts(column):
        at, h = anchors(data, length)
        if len(h):
            keep = maybe(h)
            at, h = at[keep], h[keep]
        start = np.maximum(0, at - (length - gram))
        yield data, h, at - start, start, np.minimum(len(data), at + length)


def _spans(length: int, columns: list[np.ndarray], data: list[bytes]) -> pa.RecordBatch:
    """The repeated spans of a shard's segments, given as (anchor, core, segment, copies, row, start, anchor's place) and bytes."""
    anchor, core, segment, copies, row, start, place = columns
    own, begin, end = promising(anchor, place, data, length)
    at, b, e = (np.zeros(0, np.int64) for _ in range(3))
    if len(own):
        pieces = [data[k][x:y + length - 1] for k, x, y in zip(own.tolist(), begin.tolist(), end.tolist())]
        data.clear()
        marks = repeated_starts(pieces, row[own], start[own] + begin, copies[own] > 1, length)
        change = np.zeros(len(marks) + length + 1, np.int32)
        starts = np.flatnonzero(marks)
        change[starts] += 1
        change[starts + length] -= 1
        edges = np.diff(np.concatenate([[False], np.cumsum(change)[:len(marks)] > 0, [False]]).astype(np.int8))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        first = np.cumsum(sizes) - sizes
        of = np.searchsorted(first, begins, "right") - 1
        shift = begin[of] - first[of]
        at, b, e = own[of], begins + shift, ends + shift
    return pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (anchor, core, segment)), *(pa.array(x.astype(np.int32)) for x in (b, e))], names=["anchor", "core", "segment", "b", "e"])


def _shard(length: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, anchor, core, segment, copies, row, start, anchor's place, bytes), shard by shard: the repeated spans of each segment."""
    held: list[list[np.ndarray]] = []
    data: list[bytes] = []
    now = None
    for batch in batches:
        shards, columns = batch.column(0).to_numpy(), [batch.column(k).to_numpy().astype(np.int64) for k in range(1, 8)]
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else []
        for first, end in zip(cuts[:-1], cuts[1:]):
            if shards[first] != now and held:
                yield _spans(length, [np.concatenate(c) for c in zip(*held)], data)
                held, data = [], []
            now = shards[first]
            held.append([c[first:end] for c in columns])
            data += batch.column(8).slice(first, end - first).to_pylist()
    if held:
        yield _spans(length, [np.concatenate(c) for c in zip(*held)], data)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(row, spans): for each row with repeats (see ``row_key``) the byte ranges (b, e) to remove; ranges may overlap."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(3 * total // (length - gram_of(length) + 1))
    marked = docs.where(F.octet_length("text") >= length).select(row_key().alias("row"), "text")

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return slot_batches((np.concatenate([np.zeros(0, np.uint64), *(anchors(t, length)[1] for t in texts(b.column(0)))]) for b in batches), bits)

    seen = spark.sparkContext.broadcast(twice_filter(marked.select("text").mapInArrow(slots, SLOT_SCHEMA), bits))  # at most 32 MB

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = suspect(seen.value, bits)
        for batch in batches:
            rows, hashes, names, places, begins, ends = [], [], [], [], [], []
            for row, (data, h, place, start, end) in zip(batch.column(0).to_pylist(), _segments_of(batch.column(1), length, maybe)):
                view = memoryview(np.ascontiguousarray(data))
                rows.append(np.full(len(h), row, np.int64))
                hashes.append(h)
                places.append(place)
                begins.append(start)
                ends.append(end)
                names.append(np.array([xxhash.xxh3_64_intdigest(view[a:b], p) for a, b, p in zip(start.tolist(), end.tolist(), place.tolist())], np.uint64))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(rows)), pa.array(signed(np.concatenate(hashes))), pa.array(signed(np.concatenate(names))),
                    *(pa.array(np.concatenate(v).astype(np.int32)) for v in (places, begins, ends))], names=["row", "anchor", "segment", "place", "b", "e"])

    found = written(marked.mapInArrow(suspects, "row long, anchor long, segment long, place int, b int, e int"), "anchors")
    segments = written(found.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("row", "b", "e", "place")).alias("at")), "segments")
    kinds = segments.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = segments.join(kinds, "anchor")
    crowd = F.col("kinds") > SHARD_BYTES // (2 * length)

    def of_rows(parts: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """Each text with the list of its parts (``names``, and b, e and place of ``at``); these lists."""
        listed = parts.groupBy("at.row").agg(F.collect_list(F.struct(*names, *(F.col(f"at.{c}").alias(c) for c in ("b", "e", "place")))).alias("parts"))
        listed = written(listed, "parts")
        return matching(marked, listed.select("row")).join(listed, "row").select("row", "text", "parts"), listed

    def pieces_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of segments: named by their cores and by all of their bytes."""
        names = ["anchor", "segment", "copies", "core", "piece", "from", "row", "b", "e", "place"]
        kinds = [pa.int64()] * 7 + [pa.int32()] * 3
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part, out = batch.slice(first, 64), []
                for row, data, parts in zip(part.column(0).to_pylist(), texts(part.column(1)), part.column(2).to_pylist()):
                    view = memoryview(np.ascontiguousarray(data))
                    place, start = (np.array([p[c] for p in parts], np.int64) for c in ("place", "b"))
                    sizes = np.array([p["e"] for p in parts], np.int64) - start
                    for k, block, begin, end, core, core_end in zip(*(x.tolist() for x in blocks(place, sizes, length))):
                        p, at = parts[k], parts[k]["b"]
                        core = xxhash.xxh3_64_intdigest(view[at + core:at + core_end], block + 1) >> 1 | 1
                        piece = xxhash.xxh3_64_intdigest(view[at + begin:at + end + length - 1], p["place"] - begin) >> 1
                        out.append((p["anchor"], p["segment"], p["copies"], core, piece, begin, row, at + begin, at + end + length - 1, p["place"] - begin))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    # an anchor of many segments is taken apart: blocks of a segment are segments of their own, and dealt by their cores too
    crowded = several.where(crowd).select("anchor", "segment", "copies", "at")
    held, listed = of_rows(crowded, ["anchor", "segment", "copies"])
    pieces = written(held.mapInArrow(
        pieces_of, "anchor long, segment long, copies long, core long, piece long, from long, row long, b int, e int, place int"), "pieces")
    discard(listed)
    classes = pieces.groupBy("anchor", "core", "piece").agg(F.sum("copies").alias("copies"), F.min(F.struct("row", "b", "e", "place")).alias("at"))
    classes = written(classes, "classes")
    alike = classes.groupBy("anchor", "core").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "core")
    sorted_ = several.where(~crowd).select("anchor", F.lit(0).cast("long").alias("core"), "segment", "copies", "at").unionByName(
        classes.join(alike, ["anchor", "core"]).select("anchor", "core", F.col("piece").alias("segment"), "copies", "at"))
    sorted_ = written(sorted_, "sorted")
    volume = int(sorted_.agg(F.sum(F.expr("at.e - at.b"))).first()[0] or 0)
    n = max(partitions_of(spark), volume // (TASK_SHARDS * SHARD_BYTES))
    shards = max(n, volume // SHARD_BYTES)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "core", "segment", "copies", "row", "b", "place", "bytes"]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece, out = batch.slice(k, 64), []
                for row, data, parts in zip(piece.column(0).to_pylist(), texts(piece.column(1)), piece.column(2).to_pylist()):
                    out += [(p["anchor"], p["core"], p["segment"], p["copies"], row, p["b"], p["place"], data[p["b"]:p["e"]].tobytes()) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    held, listed = of_rows(sorted_, ["anchor", "core", "segment", "copies"])
    cuts = held.mapInArrow(
        cut, "anchor long, core long, segment long, copies long, row long, b int, place int, bytes binary")
    # rows that repeat have the same segments
    dealt = cuts.withColumn("shard", F.pmod(F.xxhash64("anchor", "core"), F.lit(shards)).cast("int")).repartition(n, "shard").sortWithinPartitions("shard", "anchor", "core", "segment")
    dealt = dealt.select("shard", "anchor", "core", "segment", "copies", "row", "b", "place", "bytes")
    partly = written(dealt.mapInArrow(partial(_shard, length), "anchor long, core long, segment long, b int, e int"), "spans")
    discard(listed)
    discard(sorted_)
    wholly = segments.where("copies > 1").select("anchor", "segment", F.lit(0).cast("long").alias("from"), F.expr("cast(at.e - at.b as long)").alias("to"))
    # what was found in a piece holds in all segments that have it
    of_pieces = partly.where("core <> 0").select("anchor", "core", F.col("segment").alias("piece"), "b", "e").unionByName(
        classes.where("copies > 1").select("anchor", "core", "piece", F.lit(0).alias("b"), F.expr("at.e - at.b").alias("e")))
    taken_apart = pieces.where("copies = 1").join(of_pieces.select("anchor", "core", "piece", F.col("b").alias("_b"), F.col("e").alias("_e")), ["anchor", "core", "piece"]).select(
        "anchor", "segment", (F.col("from") + F.col("_b")).alias("from"), (F.col("from") + F.col("_e")).alias("to"))
    spans = partly.where("core = 0").select("anchor", "segment", F.col("b").cast("long").alias("from"), F.col("e").cast("long").alias("to")).unionByName(wholly).unionByName(taken_apart)
    hit = found.join(spans, ["anchor", "segment"]).select("row", (F.col("b") + F.col("from")).cast("int").alias("b"), (F.col("b") + F.col("to")).cast("int").alias("e"))
    return hit.where(F.col("e") - F.col("b") >= length).groupBy("row").agg(F.collect_set(F.struct("b", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` less the repeated bytes: ``kept`` (binary: a cut can split a character), n_bytes, n_removed, n_spans, kept_sha256."""
    added = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    spans = repeated_spans(docs, length).withColumnRenamed("row", ROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for data, ranges in zip(texts(batch.column("text")), batch.column("_spans").to_pylist()):
                gone = np.zeros(len(data) + 1, np.int64)
                for r in ranges or ():
                    gone[r["b"]] += 1
                    gone[r["e"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept.append(data[~gone].tobytes())
                counts.append((len(data), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())))
            columns = [*(batch.column(c) for c in names), pa.array(kept, pa.binary()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    joined = docs.withColumn(ROW, row_key()).join(spans.withColumnRenamed("spans", "_spans"), ROW, "left").drop(ROW)
    return joined.mapInArrow(run, f"{out}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
