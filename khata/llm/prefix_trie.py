"""Trie of conversation prefixes, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns, named by its smallest member conversation and its depth. Prefixes are identified by
running XORs of 128-bit hashes of (position, role, text), so texts are hashed once and not moved.

Rollup: a component of the tree is split at its centroid, the deepest node with at least half of the component's weight below it. The
part below, with the centroid, is totalled once, the total is added to the nodes on the path from the centroid to the component's top, and
the centroid's own sum is complete; its branches and the part above go on as components. A node's weight is the number of turns that
its members have from it on. It is known beforehand, and path additions keep it true inside each component; the nodes of
at least half a component's weight are just the path, so neither sizes nor paths are searched for. Each level halves all weights: the number of levels
is the logarithm of the turns, whatever the depth of the tree. Components above BIG are split by joins, those below within a task.

Defined cases: turns are ordered by number (nulls first), equal numbers by a hash of role and text; null roles and texts
are empty; rows without conv_id are left out; repeated rows are turns of their own. Columns beside the four are ignored. Without
conversations there is no node, not even the root. Hot conversations, turns and prefixes: rows are numbered by range, running
XORs go over chunks, and the few prefixes that very many conversations share are joined apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions_of, written

CHUNK = 4096
"""Turns of a conversation whose running XOR is one window."""
BIG = 1 << 15
"""Weight from which a component is split by joins."""
HOT = 1000
"""Prefixes with a 1/HOT share of all turns, at most HOT of them, are joined by broadcast."""
PIECE = 1 << 16
"""Bytes of ids that are hashed as one piece."""

NAME = "conv_id", "depth"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, c1, c2, bytes): each turn with its place, a hash of its role and text, and its text's bytes."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("c1"),
        F.xxhash64(F.lit("second"), role, text).alias("c2"), F.octet_length(text).cast("long").alias("bytes"))
    # ranges, so that a long conversation is spread; places inside a range, then what earlier ranges held of the conversation
    keys = ("conv_id", F.col("turn").asc_nulls_first(), "c1", "c2")
    dealt = slim.repartitionByRange(partitions_of(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    local = written(dealt.drop("turn").withColumn("range", F.spark_partition_id()).mapInArrow(
        _places, "conv_id long, c1 long, c2 long, bytes long, range int, n long"), "numbered")
    by_range = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = local.groupBy("conv_id", "range").agg(F.count("*").alias("held")).select(
        "conv_id", "range", F.sum("held").over(by_range).alias("before")).where("before > 0")
    # one row at most for each range, whose first conversation began in an earlier one
    return local.join(F.broadcast(before), ["conv_id", "range"], "left").select(
        "conv_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), "c1", "c2", "bytes")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = np.asarray(batch.column(0))
        begins = np.diff(conv, prepend=conv[0]) != 0
        begins[0] = last is None or conv[0] != last
        at = np.arange(len(conv))
        first = np.maximum.accumulate(np.where(begins, at, -1))
        n = np.where(first >= 0, at - first + 1, at + 1 + count)
        last, count = conv[-1], int(n[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], [*batch.schema.names, "n"])


def branched(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a shared beginning: ((conv_id, length), (conv_id, depth, c1, c2, bytes, length)).

    Conversation c begins with the first h turns of conversation c - c % every, as far as there are any, and goes on with its own
    turns after its first h; h = crc32(c) % (most + 1). A remainder has the sign of c."""
    placed = written(numbered(turns), "turns")
    own = placed.groupBy("conv_id").agg(F.max("n").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    convs = own.select("conv_id", "own", base.alias("base"), h.alias("h"))
    lengths = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("given")), "base", "left")
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = written(lengths.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = placed.where(F.col("n") <= most).select(F.col("conv_id").alias("base"), F.col("n").alias("depth"), "c1", "c2", "bytes")
    shared = convs.join(heads, "base").where("depth <= taken").select("conv_id", "depth", "c1", "c2", "bytes", "length")
    kept = placed.join(convs, "conv_id").where("n > h").select("conv_id", (F.col("taken") + F.col("n") - F.col("h")).alias("depth"), "c1", "c2", "bytes", "length")
    return convs.select("conv_id", "length"), shared.unionByName(kept)


def as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of ``branched``."""
    placed = written(numbered(turns), "turns")
    convs = placed.groupBy("conv_id").agg(F.max("n").alias("length"))
    return convs, placed.withColumnRenamed("n", "depth").join(convs, "conv_id")


def _prefixes(steps: DataFrame) -> DataFrame:
    """With h1, h2: XOR of the hashes of all turns up to each."""
    hashed = steps.select(
        "conv_id", "depth", "bytes", "length", F.xxhash64("depth", "c1", "c2").alias("x1"), F.xxhash64(F.lit("second"), "depth", "c1", "c2").alias("x2"),
        F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = hashed.select("conv_id", "depth", "bytes", "length", "chunk", F.bit_xor("x1").over(inside).alias("h1"), F.bit_xor("x2").over(inside).alias("h2"))
    across = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations longer than a chunk have chunks to add
    before = hashed.where(F.col("length") > CHUNK).groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2")).select(
        "conv_id", "chunk", F.bit_xor("t1").over(across).alias("b1"), F.bit_xor("t2").over(across).alias("b2"))
    later = local.where("chunk > 0").join(before, ["conv_id", "chunk"]).select(
        "conv_id", "depth", "bytes", "length", F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"))
    return local.where("chunk = 0").drop("chunk").unionByName(later)


def trie(convs: DataFrame, steps: DataFrame, big: int = BIG) -> DataFrame:
    """Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has conv_id and length, also of conversations without turns; ``steps`` all their turns, as ``branched`` gives them."""
    steps = written(_prefixes(steps), "prefixes")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), (F.sum("length") + F.count("*")).alias("weight")).where("n_convs > 0")
    found = top.first()
    if found is None:
        return convs.limit(0).select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("depth", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string"))))
    root = found["conv_id"]
    key = ["depth", "h1", "h2"]
    nodes = written(steps.groupBy(*key).agg(
        F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight")), "nodes")
    paths = written(_paths(steps, nodes, found["weight"], root), "paths")
    named = nodes.select(F.col("name").alias("conv_id"), "depth", "n_convs", "weight", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")).join(
        paths.select("conv_id", "depth", F.col("above").alias("parent_conv_id")), list(NAME))
    named = named.unionByName(top.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", "weight", F.lit(0).cast("long").alias("saved"), F.lit(None).cast("long").alias("parent_conv_id")))
    children = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = written(named.join(children, list(NAME), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "tree")
    own = tree.select(*NAME, "parent_conv_id", "weight", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), "saved")
    sums = rolled_up(own, paths, root, found["weight"], big)
    ends = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).alias("name")).unionByName(
        convs.where("length > 0").join(paths, (paths["conv_id"] == convs["conv_id"]) & (paths["depth"] == convs["length"])).select(convs["conv_id"], "depth", "name"))
    return tree.join(sums, list(NAME)).join(_ends(ends), list(NAME), "left").select(
        *NAME, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _paths(steps: DataFrame, nodes: DataFrame, n_turns: int, root: int) -> DataFrame:
    """(conv_id, depth, name, above): the nodes each conversation passes, and each one's parent."""
    key = ["depth", "h1", "h2"]
    named = nodes.select(*key, "name")
    hot = named.where(nodes["n_convs"] * HOT >= n_turns)  # their members are turns, so these are HOT at most
    slim = steps.select("conv_id", *key)
    both = slim.join(F.broadcast(hot), key).unionByName(slim.join(F.broadcast(hot), key, "left_anti").join(named, key)).select("conv_id", "depth", "name")
    both = written(both, "names")
    above = both.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("above"))
    return both.join(above, list(NAME), "left").select("conv_id", "depth", "name", F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("above")).alias("above"))


def rolled_up(own: DataFrame, paths: DataFrame, root: int, weight: int, big: int = BIG) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums of leaf and saved over each node's subtree."""
    zero = F.lit(0).cast("long")
    live = own.select("*", zero.alias("more_leaf"), zero.alias("more_saved"), F.lit(root).cast("long").alias("top_conv"), zero.alias("top_depth"))
    top, done, rest = ["top_conv", "top_depth"], [], []
    while weight > big:
        # the heavy components' tops weigh more than big each and share no turn, so there are few of them
        heavy = live.where((F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth")) & (F.col("weight") > big)).select(*top, F.col("weight").alias("whole"))
        parts = live.join(F.broadcast(heavy), top, "left")
        rest.append(parts.where("whole IS NULL").drop("whole"))
        split = parts.where("whole IS NOT NULL").withColumn("on_path", F.col("weight") * 2 >= F.col("whole"))
        centroids = split.where("on_path").groupBy(*top).agg(F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("c")).select(
            *top, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
        near = split.join(F.broadcast(centroids), top)
        branch = paths.select(F.col("conv_id"), (F.col("depth") - 1).alias("c_depth"), F.col("name").alias("branch"), "above")
        near = near.join(branch, ["conv_id", "c_depth"], "left")
        is_c = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        under = (F.col("depth") > F.col("c_depth")) & (F.col("above") == F.col("c_conv"))
        tagged = written(near.select(*own.columns, "more_leaf", "more_saved", *top, "c_depth", "c_weight", "branch", is_c.alias("is_c"),
                                     F.coalesce(under, F.lit(False)).alias("under"), (F.col("on_path") & ~is_c).alias("on_path")), "components")
        below = tagged.where("is_c OR under").groupBy(*top).agg(F.sum("leaf").alias("low_leaf"), F.sum("saved").alias("low_saved"))
        known = tagged.join(F.broadcast(below), top)
        done.append(known.where("is_c").select(*NAME, (F.col("more_leaf") + F.col("low_leaf")).alias("n_leaves"), (F.col("more_saved") + F.col("low_saved")).alias("saved_tokens")))

        def moved(new: Column, old: str) -> Column:
            return F.when(F.col("under"), new).otherwise(F.col(old)).alias(old)

        def grown(name: str, by: str, sign: int = 1) -> Column:
            return F.when(F.col("on_path"), F.col(name) + sign * F.col(by)).otherwise(F.col(name)).alias(name)

        live = known.where("NOT is_c").select(
            *NAME, "parent_conv_id", grown("weight", "c_weight", -1), "leaf", "saved", grown("more_leaf", "low_leaf"), grown("more_saved", "low_saved"),
            moved(F.col("branch"), "top_conv"), moved(F.col("c_depth") + 1, "top_depth"))
        live = written(live, "live")
        weight = live.agg(F.max("weight")).first()[0] or 0
    rest.append(live)
    small = rest[0]
    for rows in rest[1:]:
        small = small.unionByName(rows)
    spread = small.repartition(*top).sortWithinPartitions(*top, "depth")
    out = spread.select(*top, *NAME, "parent_conv_id", "weight", "leaf", "saved", "more_leaf", "more_saved").mapInArrow(
        _roll_up_batches, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for rows in done:
        out = out.unionByName(rows)
    return out


def _roll_up_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components, gathered until there are some thousand nodes."""
    def sums(held: pa.Table) -> pa.RecordBatch:
        top_conv, top_depth, conv, depth, above, weight, leaf, saved, more_leaf, more_saved = (
            c.fill_null(0).to_numpy() for c in held.combine_chunks().columns)
        order = np.lexsort((depth, conv))
        names = np.rec.fromarrays([conv[order], depth[order]])
        is_top = (conv == top_conv) & (depth == top_depth)
        wanted = np.rec.fromarrays([np.where(is_top, conv, above), np.where(is_top, depth, depth - 1)], dtype=names.dtype)
        parent = order[np.searchsorted(names, wanted)]
        total = roll_up(parent, weight.copy(), np.stack([leaf, saved], 1), np.stack([more_leaf, more_saved], 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, depth, total[:, 0], total[:, 1])], ["conv_id", "depth", "n_leaves", "saved_tokens"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        if len(table) < BIG:
            continue
        tops = np.stack([table.column(0).to_numpy(), table.column(1).to_numpy()])
        whole = int(np.flatnonzero((tops != tops[:, -1:]).any(0))[-1]) + 1 if (tops != tops[:, -1:]).any() else 0
        if whole:
            yield sums(table.slice(0, whole))
            held = table.slice(whole).to_batches()
    if held:
        yield sums(pa.Table.from_batches(held))


def roll_up(parent: np.ndarray, weight: np.ndarray, own: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sums of ``own`` over subtrees, plus ``more``, of a forest whose tops are their own parents; splits all components at once."""
    def tops_of(up: np.ndarray) -> np.ndarray:
        while True:
            further = up[up]
            if np.array_equal(further, up):
                return up
            up = further

    everyone = np.arange(len(parent))
    total, up = np.zeros_like(own), parent.copy()
    live, top = everyone, tops_of(up)
    while len(live):
        on_path = live[weight[live] * 2 >= weight[top[live]]]
        inner = np.zeros(len(parent), bool)
        inner[up[on_path[up[on_path] != on_path]]] = True
        c = on_path[~inner[on_path]]
        of = np.zeros(len(parent), np.int64)
        of[top[c]] = c
        mine = of[top]  # the centroid of each node's component
        cut = up.copy()
        cut[c] = c
        cut[live] = np.where(np.isin(live, c) | (up[live] == mine[live]), live, up[live])
        new_top = tops_of(cut)
        low = live[(new_top[live] == mine[live]) | (up[new_top[live]] == mine[live]) & (new_top[live] != top[live])]
        below = np.zeros_like(own)
        np.add.at(below, mine[low], own[low])
        total[c] = more[c] + below[c]
        on_path = on_path[mine[on_path] != on_path]
        more[on_path] += below[mine[on_path]]
        weight[on_path] -= weight[mine[on_path]]
        gone = np.zeros(len(parent), bool)
        gone[c] = True
        live, up, top = live[~gone[live]], cut, new_top
    return total


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of the conversations that end at each node.

    Ids are joined into pieces range by range, and one task streams a node's pieces through the hash, so no list of ids is gathered."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0
        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["conv_id", "depth", "first", "ids"])
        for batch in batches:
            for name, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and ((name, depth) != now or size > PIECE):
                    yield out()
                    ids, size = [], 0
                now = name, depth
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            for name, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, depth) != now:
                    if now:
                        rows.append((*now, state.hexdigest()))
                    now, state = (name, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    named = ends.select(F.col("name"), "depth", "conv_id")
    dealt = named.repartitionByRange(partitions_of(ends.sparkSession), "name", "depth", "conv_id").sortWithinPartitions("name", "depth", "conv_id")
    joined = dealt.mapInArrow(pieces, "conv_id long, depth long, first long, ids string")
    return joined.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")
