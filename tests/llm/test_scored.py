"""Toxicity, decontamination, mixing and fingerprints."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from khata.llm import decontaminate, mixing, queries, simhash, toxicity

from . import helpers as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    return H.corpus(11)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, H.SCHEMA).repartition(3).cache()


# --- toxicity

def test_folding():
    assert toxicity.folded("Yоu 1D10T!") == " you idiot "  # a Cyrillic o
    assert toxicity.folded("s.t.u-p.i.d, МORON") == " stupid moron "
    assert toxicity.folded(None) == "  " and toxicity.folded("") == "  "


def lexicon(**terms):
    return toxicity.Lexicon({f" {k} ": v for k, v in terms.items()}, toxicity.EXCEPTIONS, (-3.0, 2.0, 1.0))


def test_scores_exceptions_and_edges(spark):
    texts = ["you idiot", "an idiot-proof clown fish", "nothing here", None, "", "you 1di0t " + "word " * 50, "you idiot"]
    data = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, toxicity double")
    got = {r["doc_id"]: r for r in toxicity.score(data, lexicon(idiot=5.0, clown=5.0)).collect()}
    assert got[0]["toxicity"] > 0.9 and got[0]["toxic_terms"] == 1 and got[0]["toxicity"] == got[6]["toxicity"]
    assert all(got[i]["toxicity"] < 0.06 and got[i]["toxic_terms"] == 0 for i in (1, 2, 3, 4))
    assert 0.3 < got[5]["toxicity"] < got[0]["toxicity"]


def test_learned_terms_words_and_stems(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        text, toxic = H.words(rng, 40), i % 5 == 0
        if toxic:
            text[7] = rng.choice(["villain", f"gremlo{rng.choice('abcdefgh')}{rng.choice('xyz')}"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (9999, 1), (3, None)]
    docs = spark.createDataFrame(rows + [(10_000, None)], "doc_id long, text string")
    found = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " villain " in found.terms and any(t.startswith(" greml") or t == " grem" for t in found.terms)
    scored = toxicity.score(docs, found).toPandas().set_index("doc_id").toxicity
    assert all((scored[i] >= 0.3) == bool(i % 5 == 0) for i in range(600))


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)]])
def test_without_both_labels(spark, docs, labels):
    found = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert found.terms == {} and toxicity.score(docs, found).select("toxicity").distinct().count() == 1


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op2_toxicity"](spark, SF.replace("0.01", "0.1")).toPandas()
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    # about one in twenty labelled texts was overwritten with junk and has no term left
    assert (labels.predicted[labels.toxic == 1]).mean() >= 0.9
    assert (labels.predicted[labels.toxic == 0]).mean() <= 0.01


# --- decontamination

def plain(text):
    return re.findall(r"[^\x00-\x20!-/:-@\[-`{-~\x7f]+", (text or "").translate(H.LOWER))


def leaks(rows, items, percent=80, window=20):
    """Pairs by comparing every window of every item with every place of every document."""
    out = set()
    for r, (_, text, *_) in enumerate(rows):
        doc = np.array([hash(w) for w in plain(text)])
        for item, passage in items:
            want = np.array([hash(w) for w in plain(passage)])
            w = min(window, len(want))
            if w and len(doc) >= w:
                views = np.lib.stride_tricks.sliding_window_view(doc, w)
                if any((100 * (views == want[k:k + w]).sum(1) >= percent * w).any() for k in range(len(want) - w + 1)):
                    out.add((r, item))
    return out


def test_masks_fit_between_all_mismatches():
    for words in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        for apart in itertools.combinations(range(words), words // 5):
            assert any(not any(m[i - at] == "1" for i in apart if 0 <= i - at < len(m)) for m in decontaminate.MASKS for at in range(words - len(m) + 1))
    for words in range(1, decontaminate.SPAN):
        masks = decontaminate.short_masks(words, 80)
        assert all(any(not any(m[i] == "1" for i in apart) for m in masks) for apart in itertools.combinations(range(words), words // 5))


def test_leaks(spark, rows):
    rng = random.Random(4)
    items = [(k, " ".join(H.words(rng, n, 100_000))) for k, n in enumerate([15, 18, 25, 40, 60, 5, 11, 12, 20, 33])]
    items += [(20, None), (21, ""), (22, items[3][1]), (23, items[5][1].upper())]
    planted = [list(r) for r in rows]
    for k in range(0, 100, 3):
        passage = items[k % 10][1].split()
        for j in rng.sample(range(len(passage)), len(passage) // 12):
            passage[j] = "other"
        planted[k][1] = f"{planted[k][1]}, {' '.join(passage).title()}! {planted[k][1]}"
    for k in range(1, 60, 7):  # parts of items: twenty words and fewer
        passage = items[4][1].split()[:12 + k // 4]
        planted[k][1] = f"{' '.join(passage)} {planted[k][1]}"
    planted = [tuple(r) for r in planted]
    docs = spark.createDataFrame(planted, H.SCHEMA).repartition(4)
    want = leaks(planted, items)
    got = decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    by_row = collections.defaultdict(set)
    for r, i in want:
        by_row[r].add(i)
    expected = H.ordered((planted[r][0], sorted(by_row[r])) for r in range(len(planted)))
    assert H.ordered((r["doc_id"], r["item_ids"]) for r in got) == expected
    assert all(r["contaminated"] == bool(r["item_ids"]) and r["n_items"] == len(r["item_ids"]) for r in got)
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == len(planted) - len({r for r, _ in want}) and kept.columns == docs.columns


def test_leaks_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.report(docs.limit(0), none).collect() == []


# --- mixing

def test_rake_meets_margins():
    rng = random.Random(5)
    cells = {c: rng.randint(1, 1000) for c in itertools.product("ab*", "xy", "123")}
    targets = [{"a": 0.5, "b": 0.2, "*": 0.3}, {"x": 0.9, "y": 0.1}, {"1": 0.2, "2": 0.3, "3": 0.5}]
    weights = mixing.rake(cells, targets)
    total = sum(cells[c] * weights[c] for c in cells)
    for k, target in enumerate(targets):
        for name, share in target.items():
            assert sum(cells[c] * weights[c] for c in cells if c[k] == name) / total == pytest.approx(share, abs=1e-6)
    assert max(weights.values()) == 1.0


def test_rake_edges():
    assert mixing.rake({}, [{"a": 1.0}]) == {}
    assert mixing.rake({("a",): 0.0}, [{"a": 1.0}]) == {("a",): 1.0}
    # no tokens in b: its share goes to a; unnamed categories keep theirs
    weights = mixing.rake({("a",): 60.0, ("*",): 40.0}, [{"a": 0.5, "b": 0.5}])
    assert weights[("a",)] == pytest.approx(weights[("*",)])


def test_topics_and_mix(spark, rows, docs):
    marked = mixing.with_topics(docs.withColumn("topic", F.lit("clash")))
    got = {(r["doc_id"], r["text"]): r for r in marked.collect()}
    assert all(r["tokens"] == len([w for w in re.split("[ \t\n\v\f\r]+", r["text"] or "") if w]) for r in got.values())
    assert got[(None, None)]["topic"] == 0
    mixed = mixing.mix(marked, {"source": {"src0": 0.5, "*": 0.5}, "lang": {"en": 0.6}, "topic": {str(i): 0.125 for i in range(8)}})
    assert mixed.count() == len(rows)
    again = mixing.mix(marked.repartition(7), {"source": {"src0": 0.5, "*": 0.5}, "lang": {"en": 0.6}, "topic": {str(i): 0.125 for i in range(8)}})
    assert mixed.select("doc_id", "kept").exceptAll(again.select("doc_id", "kept")).count() == 0
    assert mixing.mix(marked.limit(0), {"lang": {"en": 1.0}}).collect() == []
    with pytest.raises(ValueError):
        mixing.calibrated(marked, {"source": {str(i): 1.0 for i in range(1000)}, "lang": {str(i): 1.0 for i in range(1000)}})


def test_mixed_shares(spark):
    got = queries.QUERIES["op7_mixing"](spark, SF.replace("0.01", "0.1")).toPandas()
    weight = got.tokens * got.keep_probability
    for column, target in queries.TARGETS.items():
        shares = weight.groupby(got[column].astype(str)).sum() / weight.sum()
        for name, share in target.items():
            value = shares[name] if name in shares else shares[[k for k in shares.index if k not in target]].sum()
            assert value == pytest.approx(share, abs=1e-4)
    kept = got[got.kept]
    assert kept.tokens[kept.lang == "en"].sum() / kept.tokens.sum() == pytest.approx(0.5, abs=0.05)


# --- fingerprints

def test_edited_neighbours(spark, rows, docs):
    got = simhash.with_edits(docs).collect()
    assert len(got) == len(rows)
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    texts = {r[0]: r[1] or "" for r in rows}
    ids = list(dict.fromkeys(r[0] for r in known))
    nulls = [r[1] or "" for r in rows if r[0] is None]
    first = texts[ids[0]]
    for r in got:
        if r["doc_id"] is None or r["doc_id"] == 3:
            continue
        text, at = texts[r["doc_id"]], ids.index(r["doc_id"])
        nexts = [texts[ids[at + 1]]] if at + 1 < len(ids) else nulls
        edits = {hashlib.sha256((text[:len(text) - len(text) // 3] + n[:len(text) // 3]).encode()).hexdigest() for n in nexts}
        assert r["n_chars"] == len(text) and r["edited_sha256"] in edits
    # the row after the last is the first
    ends = {hashlib.sha256((t[:len(t) - len(t) // 3] + first[:len(t) // 3]).encode()).hexdigest() for t in nulls}
    assert any(r["doc_id"] is None and r["edited_sha256"] in ends for r in got)
    by_text = collections.defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_single_and_empty(spark):
    one = simhash.with_edits(spark.createDataFrame([(5, "abc def ghi")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abc def abc").hexdigest() and one[0]["near_next"] == 1.0
    assert simhash.with_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likeness_follows_overlap():
    rng = random.Random(8)
    a, b = H.words(rng, 300), H.words(rng, 300)
    prints = simhash.fingerprints(pa.array([" ".join(a), " ".join(a[:200] + b[:100]), " ".join(b), " ".join(a), None, " "]))
    x, y, z = simhash.likeness([prints[0]] * 3, prints[1:4])
    assert z == 1.0 and x > 0.45 and y < 0.3 and prints[4] == prints[5] == bytes(16)


def test_radius_search_finds_all(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(40)]
    prints = []
    for k in range(400):
        value = rng.choice(base)
        for bit in rng.sample(range(128), rng.randint(0, 9)):
            value ^= 1 << bit
        prints.append((k, f"{value:032x}"))
    prints += [(500, prints[0][1]), (501, None)]
    data = spark.createDataFrame(prints, "doc_id long, fingerprint string")
    got = {r["fingerprint"]: r["n_near"] for r in simhash.within_radius(data, data.where("doc_id % 50 = 0"), 6).collect()}
    values = [int(p, 16) for _, p in prints if p]
    want = {p: sum((int(p, 16) ^ v).bit_count() <= 6 for v in values) for k, p in prints if k % 50 == 0}
    assert got == want


def test_wide_radius_yields_every_pair(spark):
    rng = random.Random(10)
    base = [rng.getrandbits(128) for _ in range(12)] + [0, (1 << 128) - 1]
    values = [rng.choice(base) for _ in range(300)]
    for k, v in enumerate(values):
        for bit in rng.sample(range(128), rng.randint(0, 18)):
            v ^= 1 << bit
        values[k] = v
    values += [base[0] ^ sum(1 << (16 * i + b) for i in range(8) for b in range(n)) for n in (2, 3)] + [base[0]] * 3  # 16 and 24 bits, spread evenly
    data = spark.createDataFrame([(k, f"{v:032x}") for k, v in enumerate(values)] + [(999, None)], "doc_id long, fingerprint string")
    asked = data.where("doc_id % 3 = 0")
    for radius, blocks in ((23, 8), (24, 8), (23, 16), (0, 8)):
        got = [(r["fingerprint"], r["other"], r["distance"], r["n"]) for r in simhash.near_pairs(data, asked, radius, blocks).collect()]
        times = collections.Counter(values)
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count(), times[b]) for a in set(values[::3]) for b in times if (a ^ b).bit_count() <= radius}
        assert len(got) == len(want) and set(got) == want


def test_edited_copies_are_near(spark):
    """Copies of which five-word Jaccard is at least 0.8 are within NEAR_BITS."""
    rng = random.Random(11)
    texts = []
    for _ in range(20):
        text = H.words(rng, 200)
        copy = list(text)
        for at in (20, 80, 140, 190):
            copy[at] = "changed"
        shingles = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (text, copy)]
        assert len(shingles[0] & shingles[1]) >= 0.8 * len(shingles[0] | shingles[1])
        texts += [" ".join(text), " ".join(copy)]
    data = spark.createDataFrame([(i, f"{int.from_bytes(p, 'little'):032x}") for i, p in enumerate(simhash.fingerprints(pa.array(texts)))], "doc_id long, fingerprint string")
    prints = [r["fingerprint"] for r in data.orderBy("doc_id").collect()]
    pairs = {(r["fingerprint"], r["other"]) for r in simhash.near_pairs(data, data.where("doc_id % 2 = 0"), queries.NEAR_BITS).collect()}
    assert set(zip(prints[::2], prints[1::2])) <= pairs
