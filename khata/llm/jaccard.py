"""Jaccard join over word shingles by signature trees.

Documents become sets of shingle hashes; equal sets are one class. Within a block of classes a tree of nodes holds OR- and
AND-combined token bitmaps and size ranges; a dual traversal of trees goes down only into node pairs whose largest possible
overlap can reach the threshold, and compares the sets of the remaining pairs exactly. Pairs that are already connected are
skipped, as the result is the components of the link graph.

Blocks hold all pairs that can link. Two sets with Jaccard similarity t or more differ in few tokens; if the tokens are
dealt by hash into one part more than that number, one part is equal in both sets. So classes that agree in one part (of the
same size class) share a key, and linked classes are always in one connected component of the shared-key graph. Each such
component is a block. A large block is cut into pieces, and every pair of pieces is traversed in a task of its own.
Parts that hold nothing but heavy tokens (of passages that very many documents share) make no key as long as a set has few of
them, since there are spare parts; so a common passage alone doesn't draw documents into one block. Any choice of heavy
tokens gives the same links: they are found by counters of fixed size over all documents. All keys are shuffled once, packed to ten bytes
each with the set they belong to, and met in parts of a bounded number of keys. A filter of a fixed size in front would let all of them through from some size on.

Defined cases: null or empty texts, or texts without words, have an empty set and link with nothing. Equal sets always link. Repeated
rows are documents that link with each other. Null ids order last among a component's ids.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, mixed, partitions_of, row_key, shingle_hashes, signed, word_hashes, written
from .links import components
from .sightings import matching

PIECE_TOKENS = 1 << 21
"""A block of more shingles is cut into pieces of about so many (16 MB)."""
COUNTER_BITS, COUNTER_PART = 22, 14
HEAVY = 64
"""A token is heavy if its counter, of 2 ** COUNTER_BITS, is HEAVY above four times the mean."""
KEY_BITS, SLOT_BITS, OWNER_BITS = 48, 16, 48
KEYS_HELD, PART_KEYS = 1 << 20, 1 << 21
"""Keys that a task gathers before it deals them out, and keys of a part that meet in memory."""
HASHED_BYTES = 1 << 19
"""Text that is hashed at a time, or one text if that is longer; some forty bytes are held for each."""
LEAF = 16
SIGNATURE_BITS = 2048


class SizeClasses:
    """Set sizes in classes that are 1 / t wide, and the number of parts of each."""

    def __init__(self, percent: int):
        self.percent, self.starts, self.parts, self.spare = percent, [1], [], []

    def _grow(self, size: int) -> None:
        while self.starts[-1] <= size:
            start = self.starts[-1]
            end = start * 100 // self.percent  # the last size of this class
            largest = end * 100 // self.percent  # the largest set that can link with it
            differ = (100 - self.percent) * (end + largest) // (100 + self.percent)
            spare = 2 + differ // 8
            self.starts.append(end + 1)
            self.spare.append(spare)
            self.parts.append(differ + 1 + spare)

    def tables(self, size: int) -> list[tuple[int, int, int]]:
        """(class, parts, spare) of the classes in which a set of this size takes part: its own and the one below."""
        self._grow(size)
        own = int(np.searchsorted(self.starts, size, "right")) - 1
        return [(i, self.parts[i], self.spare[i]) for i in (own - 1, own) if i >= 0]


def part_keys(tokens: np.ndarray, classes: SizeClasses, heavy: np.ndarray | None = None) -> np.ndarray:
    """Keys of a set: for each part, a hash of its tokens there. ``heavy`` marks the counters of heavy tokens.

    Of parts + spare parts, sets that link agree in spare + 1 or more. Parts without a light token make no key, unless a set
    has more than ``spare`` of them; then all parts with tokens do, and if more than ``spare`` have none, all parts. Equal
    parts are treated alike in both sets unless one of them has more keys; so an equal part with a key in both remains."""
    out = []
    spread, value = tokens >> np.uint64(20), mixed(tokens + np.uint64(0x632BE59BD9B4E019))
    light = None if heavy is None else ~heavy[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    for table, parts, spare in classes.tables(len(tokens)):
        place = (spread % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, place, value)
        used = filled = np.bincount(place, minlength=parts) > 0
        if light is not None and not light.all():
            used = np.bincount(place[light], minlength=parts) > 0
        if parts - int(used.sum()) > spare:
            used = filled
        if parts - int(used.sum()) > spare:
            used = np.ones(parts, bool)
        seed = np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
        out.append(mixed(sums ^ mixed(seed))[used])
    return np.concatenate(out)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in chunks(*bytes_of(column), HASHED_BYTES):
        hashes, ends = shingle_hashes(*word_hashes(data, offsets), words)
        for a, b in zip(ends[:-1], ends[1:]):
            yield np.unique(hashes[a:b])


def set_id(tokens: np.ndarray) -> int:
    """Identity of a set, as a signed long."""
    total = np.array([mixed(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))])
    return int(signed(mixed(total))[0])


# --- signature trees

def signatures(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), SIGNATURE_BITS // 64), np.uint64)
    for i, tokens in enumerate(sets):
        bit = tokens & np.uint64(SIGNATURE_BITS - 1)
        np.bitwise_or.at(out[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


class Tree:
    """Levels of nodes over sets in the order of their smallest tokens; level 0 has one node for each set."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: (sets[i][:4].tolist(), len(sets[i])))
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        marks = signatures(self.sets)
        self.levels = [(marks, marks, sizes, sizes)]  # OR, AND, smallest and largest size
        while len(self.levels[-1][2]) > 1:
            either, every, small, large = self.levels[-1]
            cuts = np.arange(0, len(small), LEAF)
            self.levels.append((np.bitwise_or.reduceat(either, cuts, 0), np.bitwise_and.reduceat(every, cuts, 0), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)))


def possible(a: Tree, b: Tree, level: int, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below the nodes can link: the sizes are near enough, and the overlap can be large enough.

    A bit that all sets of one node have and none of the other has stands for a token that isn't shared."""
    ora, anda, small_a, large_a = (x[left] for x in a.levels[level])
    orb, andb, small_b, large_b = (x[right] for x in b.levels[level])
    ok = (100 * large_b >= percent * small_a) & (100 * large_a >= percent * small_b)
    overlap = np.minimum(large_a - np.bitwise_count(anda & ~orb).sum(1, dtype=np.int64), large_b - np.bitwise_count(andb & ~ora).sum(1, dtype=np.int64))
    return ok & ((100 + percent) * overlap >= percent * (small_a + small_b))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def forest(a: Tree, b: Tree, percent: int) -> list[tuple[int, int]]:
    """Links that join all sets of ``a`` and ``b`` that links between them connect (``b`` may be ``a``)."""
    same = a is b
    root_a = np.arange(len(a.sets))
    root_b = root_a if same else np.arange(len(b.sets)) + len(a.sets)
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, int, int]] = []

    def visit(level: int, left: np.ndarray, right: np.ndarray) -> None:
        """Compare sets, or put nodes on the stack; nearest last, so that they are next and connect most sets early."""
        if same:
            keep = left < right if level == 0 else left <= right
            left, right = left[keep], right[keep]
        if level == 0:
            keep = root_a[left] != root_b[right]
            left, right = left[keep], right[keep]
        keep = possible(a, b, level, left, right, percent)
        left, right = left[keep], right[keep]
        order = np.argsort(-np.abs(left - right), kind="stable")
        if level:
            stack.extend((level, int(i), int(j)) for i, j in zip(left[order], right[order]))
            return
        for i, j in zip(left[order[::-1]].tolist(), right[order[::-1]].tolist()):
            if root_a[i] != root_b[j] and linked(a.sets[i], b.sets[j], percent):
                old, new = max(root_a[i], root_b[j]), min(root_a[i], root_b[j])
                root_a[root_a == old] = new
                root_b[root_b == old] = new
                out.append((a.ids[i], b.ids[j]))

    def grid(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(x, len(y)), np.tile(y, len(x))

    top = min(len(a.levels), len(b.levels)) - 1
    visit(top, *grid(np.arange(len(a.levels[top][2])), np.arange(len(b.levels[top][2]))))
    while stack:
        level, i, j = stack.pop()
        width = LEAF ** level
        roots = np.concatenate([root_a[i * width:(i + 1) * width], root_b[j * width:(j + 1) * width]])
        if (roots != roots[0]).any():
            under = [np.arange(x * LEAF, min((x + 1) * LEAF, len(t.levels[level - 1][2]))) for x, t in ((i, a), (j, b))]
            visit(level - 1, *grid(*under))
    return out


# --- the join

def hand_back() -> None:
    """Give the system what earlier tasks of this worker have freed; the C library keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _sets(words: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n, sid) of each document, and behind them the task's token counters as rows (part, counts) of their own."""
    hand_back()
    counts, names = np.zeros(1 << COUNTER_BITS, np.uint32), ["row", "doc_id", "n", "sid", "part", "counts"]
    for batch in batches:
        n, ids = [], []
        for tokens in shingle_sets(batch.column(2), words):
            n.append(len(tokens))
            ids.append(set_id(tokens))
            counts[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] += 1
        none = (pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), *none], names=names)
    pieces = counts.reshape(-1, 1 << COUNTER_PART)
    packed = [zlib.compress(p.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for p in pieces]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(pieces), pa.int64())] * 4 + [pa.array(np.arange(len(pieces)), pa.int32()), pa.array(packed, pa.binary())], names=names)


def _heavy(limit: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, counts) of counters, sorted by part: a bitmap of the heavy ones for each part."""
    now, sums = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums > limit, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    for batch in batches:
        for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                if now is not None:
                    yield done()
                now, sums = part, np.zeros(1 << COUNTER_PART, np.int64)
            sums += np.ascontiguousarray(np.frombuffer(zlib.decompress(counts), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    if now is not None:
        yield done()


def _heavy_counters(counters: DataFrame, limit: float) -> np.ndarray:
    """The heavy counters' bitmap, half a MB."""
    counters = counters.repartition(partitions_of(counters.sparkSession), "part").sortWithinPartitions("part")
    heavy = np.zeros(1 << COUNTER_BITS, bool)
    for row in counters.mapInArrow(partial(_heavy, limit), "part int, bits binary").collect():
        heavy[row["part"] << COUNTER_PART:(row["part"] + 1) << COUNTER_PART] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little").astype(bool)
    return np.packbits(heavy, bitorder="little")


def key_part_bits(expected: int, partitions: int) -> int:
    """Logarithm of the parts that keys are dealt to: none holds more than about PART_KEYS, and each partition has some."""
    return min(SLOT_BITS, max(0, -(-expected // PART_KEYS) - 1, 4 * partitions - 1).bit_length())


def key_batches(keyed: Iterable[tuple[np.ndarray, int]], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, counts, keys, owners) of the keys of sets: ascending in a part, ten bytes for each.

    A key is its first 48 bits: SLOT_BITS of them, which begin with the part, as the number of keys in each slot, and 32 bits as they are. Its
    owner is the set's ``owner_of``. Keys that agree in 48 bits only bring sets into one block that needn't be."""
    held, owners, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held) >> np.uint64(64 - KEY_BITS)
        order = np.argsort(keys)
        keys, owner = keys[order], np.repeat(np.array(owners, np.uint64), [len(k) for k in held])[order]
        counts = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=1 << SLOT_BITS).astype("<u4").reshape(1 << bits, -1)
        ends = np.cumsum(counts.sum(1))
        low, small, large = keys.astype("<u4"), owner.astype("<u4"), (owner >> np.uint64(32)).astype("<u2")
        cuts = [(p, int(e) - int(n), int(e)) for p, (n, e) in enumerate(zip(counts.sum(1), ends)) if n]
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _, _ in cuts], pa.int32()), pa.array([counts[p].tobytes() for p, _, _ in cuts], pa.binary()),
            pa.array([low[i:j].tobytes() for _, i, j in cuts], pa.binary()),
            pa.array([small[i:j].tobytes() + large[i:j].tobytes() for _, i, j in cuts], pa.binary())], names=["part", "counts", "keys", "owners"])

    for keys, owner in keyed:
        if len(keys):
            held.append(keys)
            owners.append(owner)
            size += len(keys)
        if size >= KEYS_HELD:
            yield from flush()
            held, owners, size = [], [], 0
    if size:
        yield from flush()


def shared_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``key_batches`` sorted by part: (a, b) for each owner of a key and the smallest other one, one part at a time."""
    hand_back()
    now, held = None, []

    def met() -> pa.RecordBatch:
        keys, owners = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        again = keys[1:] == keys[:-1]
        many = np.append(again, False) | np.insert(again, 0, False)
        keys, owners = keys[many], owners[many]
        pairs = np.zeros((0, 2), np.int64)
        if len(keys):
            starts = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
            least = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(keys))))
            pairs = np.unique(np.stack([owners, least], 1)[owners != least], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for part, counts, low, owners in zip(*batch.columns):
            if part.as_py() != now:
                if held:
                    yield met()
                now, held = part.as_py(), []
            counts, low = np.frombuffer(counts.as_py(), "<u4"), np.frombuffer(low.as_py(), "<u4")
            blob, n = owners.as_py(), len(low)
            owner = np.frombuffer(blob, "<u4", n).astype(np.int64) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.int64) << 32
            held.append((np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(32), counts) | low, owner))
    if held:
        yield met()


def _grouped(words: int, percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, left, right, piece, sid, text), sorted by the first three; traverses one pair of pieces at a time."""
    hand_back()
    now, sides = None, {}

    def links() -> list[tuple[int, int]]:
        trees = {p: Tree(list(x), list(x.values())) for p, x in sides.items()}
        if now[1] == now[2]:
            return forest(trees[now[1]], trees[now[1]], percent)
        return forest(trees[now[1]], trees[now[2]], percent) if len(trees) == 2 else []

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        found: list[tuple[int, int]] = []
        for block, left, right, piece, sid, tokens in zip(*(batch.column(i).to_pylist() for i in range(5)), shingle_sets(batch.column(5), words)):
            if (block, left, right) != now:
                if now:
                    found += links()
                now, sides = (block, left, right), {}
            sides.setdefault(piece, {})[sid] = tokens
        yield out(found)
    if now:
        yield out(links())


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(row, doc_id, n_shingles, set_id, component_id) for each document row: documents link when 100 * intersection >=
    ``percent`` * union of their sets of ``words``-word shingles; the component's id is its smallest ``doc_id``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = written(texts.mapInArrow(partial(_sets, words), "row long, doc_id long, n long, sid long, part int, counts binary"), "shingle-sets")
    sets = both.where(F.col("n").isNotNull()).select("row", "doc_id", "n", "sid")
    limit = HEAVY + 4 * (total / 6) / (1 << COUNTER_BITS)
    known = spark.sparkContext.broadcast(_heavy_counters(both.where(F.col("part").isNotNull()).select("part", "counts"), limit))
    bits = key_part_bits(total // 12, partitions_of(spark))  # about as many keys as a text has shingles, times 0.4

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of all sets, once for each set of a task."""
        hand_back()
        classes, sent = SizeClasses(percent), set()
        heavy = np.unpackbits(known.value, bitorder="little").astype(bool)

        def keyed() -> Iterator[tuple[np.ndarray, int]]:
            for batch in batches:
                for tokens in shingle_sets(batch.column(0), words):
                    sid = set_id(tokens)
                    if len(tokens) and sid not in sent:
                        sent.add(sid)
                        yield part_keys(tokens, classes, heavy), sid & (1 << OWNER_BITS) - 1

        yield from key_batches(keyed(), bits)

    dealt = texts.select("text").mapInArrow(keys, "part int, counts binary, keys binary, owners binary")
    dealt = dealt.repartition(max(partitions_of(spark), 1 << bits >> 2), "part").sortWithinPartitions("part")
    blocks = components(dealt.mapInArrow(shared_keys, "a long, b long").distinct())

    one = sets.where("n > 0").groupBy("sid").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    members = one.withColumn("node", F.col("sid").bitwiseAND(F.lit((1 << OWNER_BITS) - 1))).join(blocks, "node")
    pieces = members.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(PIECE_TOKENS)).cast("int").alias("pieces"))
    members = written(members.join(pieces, "component").select("row", "sid", F.col("component").alias("block"), "pieces", F.pmod(F.xxhash64("sid"), F.col("pieces")).cast("int").alias("piece")), "blocks")
    dealt = matching(texts, members).join(members, "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("block", F.least("piece", "other").alias("left"), F.greatest("piece", "other").alias("right"), "piece", "sid", "text")
    dealt = dealt.repartition(partitions_of(spark), "block", "left", "right").sortWithinPartitions("block", "left", "right")
    links = components(dealt.mapInArrow(partial(_grouped, words, percent), "a long, b long"))

    named = one.select("sid").join(links.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("component"))
    least = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(named, "sid")
    least = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("sid", "component_id")
    return sets.join(least, "sid", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, with all its columns: that with the smallest ``doc_id`` (nulls last).

    Documents without words link with nothing: all of their rows stay, equal ones too."""
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))  # as word_hashes splits them
    given = docs.where(worded)
    # a component whose ids are all null has a null id; its sets are told apart by the set
    key = F.struct(F.col("component_id").isNull().alias("none"), F.coalesce("component_id", "set_id").alias("k"))
    first = near_groups(given, words, percent).groupBy(key.alias("k")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("_row"))
    kept = given.withColumn("_row", row_key()).join(first, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
    return kept.unionByName(docs.where(~worded))
