"""Line, substring and near-duplicate operators against brute force, with the awkward rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from khata.llm import common, jaccard, line_dedup, sightings, suffix_dedup
from khata.llm.links import components

from . import helpers as H


@pytest.fixture(scope="module")
def rows():
    return H.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, H.SCHEMA).repartition(5).withColumn("kept", F.lit("own")).withColumn("row", F.lit(1)).cache()


def test_line_dedup(docs, rows):
    out = line_dedup.drop_lines(docs.withColumn("n_lines", F.lit("clash")))
    assert {"kept", "row", "lang"} <= set(out.columns)
    assert H.ordered(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == H.ordered(H.line_dedup(rows))


def test_line_dedup_keeps_text_of_untouched_rows(docs):
    out = line_dedup.drop_lines(docs)
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert out.where("n_dropped = 0").select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("length", [64, 200])
def test_suffix_dedup(docs, rows, length):
    out = suffix_dedup.remove_repeats(docs, length)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert H.ordered(tuple(r) for r in got) == H.ordered(H.repeats(rows, length))


@pytest.mark.parametrize("queue", [3, 40, 1 << 20])
def test_induced_sorting(monkeypatch, queue):
    monkeypatch.setattr(suffix_dedup, "QUEUE_ROWS", queue)
    rng = np.random.default_rng(queue)
    for _ in range(60):
        n, most = int(rng.integers(1, 120)), int(rng.choice([4, 8, 30]))
        text = np.append(rng.integers(1, rng.choice([2, 3, 9]), n), 0).astype(np.int16)
        if n > 20:
            text[n // 2:n // 2 + n // 4] = text[:n // 4]
        parts = list(suffix_dedup.sorted_suffixes(text, most))[::-1]
        order, common = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        assert sorted(order) == list(range(n))
        cut = [text[i:i + most].tolist() for i in order]
        for k in range(1, n):
            assert cut[k - 1] <= cut[k]
            same = next((j for j, (a, b) in enumerate(zip(cut[k - 1], cut[k])) if a != b), min(map(len, cut[k - 1:k + 1])))
            assert common[k] == same


def test_a_shard_is_sorted_in_little_memory():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, int(rng.integers(2, 9)), dtype=np.uint8)) for _ in range(500)]
    n = suffix_dedup.SHARD_BYTES // 368
    pieces = [b" ".join(words[k] for k in rng.integers(0, 500, 80))[:368] for _ in range(n - n // 4)]
    pieces += [b"#" + p[:300] + b"#" for p in pieces[:n // 4]]
    tracemalloc.start()
    marks = suffix_dedup.repeated_starts(pieces, np.arange(len(pieces)), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool), 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert marks.sum() == 2 * 101 * (n // 4)
    assert peak < 200 << 20


def test_an_anchor_of_many_segments_is_taken_apart(spark, monkeypatch):
    """A passage with other text around it in each document, and runs of one word: the same rows, and fewer bytes of one anchor in a shard."""
    rng = np.random.default_rng(6)
    passage = "the same licence in all of these documents, of some length and then some more words to make it long enough for a repeat " * 2
    rows = []
    for i in range(300):
        a, b = (" ".join("".join(chr(c) for c in rng.integers(97, 123, 5)) for _ in range(int(rng.integers(1, 60)))) for _ in range(2))
        rows.append((i, f"{a} {passage[i % 7:]} {b} {'the ' * int(rng.integers(0, 90))}{a[:9]}", "en", "s", 0))
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    sizes = []
    given = suffix_dedup.written

    def noted(df, label):
        out = given(df, label)
        if label in ("segments", "sorted"):
            keys = [c for c in ("anchor", "core") if c in out.columns]
            sizes.append(out.groupBy(*keys).agg(F.sum(F.expr("at.e - at.b")).alias("n")).agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(suffix_dedup, "written", noted)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, H.SCHEMA).repartition(4))
    assert H.ordered(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == H.ordered(H.repeats(rows, 200))
    assert len(sizes) == 2 and sizes[1] < 0.7 * sizes[0]


def test_rows_in_order_of_short_and_long_keys():
    rng = np.random.default_rng(8)
    for most in (1, 5, 1 << 20, 1 << 40, (1 << 62) - 1):
        keys = [rng.integers(0, bound, 2000) for bound in (7, most)]
        order = suffix_dedup.in_order(*keys)
        assert order.tolist() == np.lexsort(keys[::-1]).tolist()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_near_groups(docs, rows, n, percent):
    got = jaccard.near_groups(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert H.ordered(tuple(r) for r in got) == H.ordered(H.near_groups(rows, n, percent))


def test_near_groups_with_heavy_tokens_and_pieces(spark, monkeypatch):
    """A passage in every text, tiny pieces and heavy tokens: the same links."""
    monkeypatch.setattr(jaccard, "PIECE_TOKENS", 300)
    monkeypatch.setattr(jaccard, "HEAVY", 5)
    rows = [(i, f"{t} {' '.join(f'p{k}' for k in range(60))}", *rest) for i, t, *rest in H.corpus(7, 60) if t]
    got = jaccard.near_groups(spark.createDataFrame(rows, H.SCHEMA), 3, 70).select("doc_id", "n_shingles", "component_id").collect()
    assert H.ordered(tuple(r) for r in got) == H.ordered(H.near_groups(rows, 3, 70))


def test_part_keys_leave_no_link_out():
    rng = np.random.default_rng(5)
    classes = jaccard.SizeClasses(80)
    heavy = np.zeros(1 << jaccard.COUNTER_BITS, bool)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(len(x) * 0.1):], rng.integers(0, 1 << 63, int(len(x) * 0.12), dtype=np.uint64)]))
        heavy[:] = False
        heavy[(rng.choice(x, len(x) * int(rng.integers(0, 10)) // 10) >> np.uint64(64 - jaccard.COUNTER_BITS)).astype(np.int64)] = True
        if jaccard.linked(x, y, 80):
            assert set(jaccard.part_keys(x, classes, heavy).tolist()) & set(jaccard.part_keys(y, classes, heavy).tolist())


def test_shared_keys_meet_whatever_their_number(monkeypatch):
    """Keys of many sets, dealt in several rows for each part, with keys that one task has twice: ten bytes a key, and all owners meet."""
    monkeypatch.setattr(jaccard, "KEYS_HELD", 3000)
    rng = np.random.default_rng(8)
    known = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    sets = [(np.concatenate([rng.integers(0, 1 << 64, 200, dtype=np.uint64), rng.choice(known, 5, replace=False)]), int(rng.integers(0, 1 << jaccard.OWNER_BITS))) for _ in range(120)]
    sets += [(x, owner) for x, owner in sets[:3]] + [(np.zeros(0, np.uint64), 1)]
    found = [row for b in jaccard.key_batches(sets, 4) for row in b.to_pylist()]
    assert sum(len(r["keys"]) + len(r["owners"]) for r in found) == 10 * sum(len(x) for x, _ in sets)
    parts = pa.RecordBatch.from_pylist(sorted(found, key=lambda r: r["part"]))
    got = {tuple(r.values()) for b in jaccard.shared_keys(iter([parts.slice(0, 20), parts.slice(20)])) for r in b.to_pylist()}
    owners = {}
    for keys, owner in sets:
        for key in keys.tolist():
            owners.setdefault(key >> 16, set()).add(owner)
    assert got == {(o, min(g)) for g in owners.values() for o in g if o != min(g)} and len(got) > 100
    assert [jaccard.key_part_bits(n, p) for n, p in ((0, 1), (100, 8), (1 << 21, 1), (10**9, 1), (10**15, 600))] == [2, 5, 2, 9, 16]


def test_keys_seen_once_are_not_written(spark, monkeypatch):
    """However small a filter would be for so many keys: scratch tables have a row for each document and each counter piece, none for a key."""
    monkeypatch.setattr(sightings, "MOST_BITS", 12)
    monkeypatch.setattr(sightings, "PART_BITS", 12)
    sizes = {}

    def written(df, label):
        out = common.written(df, label)
        sizes[label] = sizes.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", written)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(map(str, rng.integers(0, 10**9, 400)))) for i in range(60)] + [(60, "a b c d e f"), (61, "a b c d e f g"), (62, "x y z")]
    groups = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3, 75)
    assert {r.doc_id: r.component_id for r in groups.collect()} == {i: 60 if i == 61 else i for i in range(63)}
    assert sizes["shingle-sets"] == 63 + (1 << jaccard.COUNTER_BITS - jaccard.COUNTER_PART)


def test_trees_join_what_pairs_join():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(30, 60)), replace=False), rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for _ in range(90)]
    tree = jaccard.Tree(list(range(90)), sets)
    links = {(a, b) for a in range(90) for b in range(a) if jaccard.linked(sets[a], sets[b], 70)}

    def groups(pairs):
        root = list(range(90))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i in range(90) if root[i] == r) for r in root}

    assert groups(jaccard.forest(tree, tree, 70)) == groups(links)


def test_one_of_each_keeps_one_row(docs, rows):
    kept = [tuple(r) for r in jaccard.one_of_each(docs, 4, 85).select("doc_id", "text").collect()]
    groups = H.near_groups(rows, 4, 85)
    assert sorted(i for i, t in kept if i is not None and t and t.split()) == sorted({g for i, n, g in groups if n and g is not None})
    assert {i for i, t in kept if not (t or "").split()} == {i for i, n, _ in groups if not n}


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(301)} == {0} and {found[i] for i in range(1000, 1200)} == {1000} and found[5000] == 5000


def test_filters_pass_all_that_is_seen_twice(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 1 << 63, 4000, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    bits = sightings.filter_bits(5000)
    data = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h long").repartition(6)

    def slots(batches):
        return sightings.slot_batches((b.column(0).to_numpy().view(np.uint64) for b in batches), bits)

    maybe = sightings.suspect(sightings.twice_filter(data.mapInArrow(slots, sightings.SLOT_SCHEMA), bits), bits)
    assert maybe(twice).all() and maybe(once).mean() < 0.2


def test_one_of_each_keeps_all_rows_without_words(spark):
    empty = [(None, None, "a"), (None, "", "b"), (None, None, "c"), (1, "", "a"), (1, None, "b"), (2, " \t\n\x0b\f\r ", "a"), (2, " \t\n\x0b\f\r ", "a")]
    worded = [(3, "one two three four five six", "a"), (3, "one two three four five six", "b"), (4, "\u00a0", "a")]
    data = spark.createDataFrame(empty + worded, "doc_id long, text string, source string")
    kept = [tuple(r) for r in jaccard.one_of_each(data).collect()]
    assert sorted(map(repr, kept[:])) == sorted(map(repr, [*empty, *(r for r in kept if r[0] in (3, 4))]))
    assert sorted(r[:2] for r in kept if r[0] in (3, 4)) == [worded[0][:2], worded[2][:2]]


@pytest.mark.parametrize("operator", [line_dedup.drop_lines, suffix_dedup.remove_repeats, jaccard.near_groups, jaccard.one_of_each])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], H.SCHEMA)).collect() == []
