"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs and digit substitutions to plain letters, punctuation to blanks, single letters joined
that were spaced out by dots or dashes) and an Aho-Corasick automaton finds the lexicon's terms: whole words, and stems at
the beginning of a word. Terms inside an exception phrase don't count. The weights of the found terms, as a sum and as a
density by text length, give the score through a logistic curve.

The lexicon is learned from labelled rows: words and word beginnings that occur in toxic rather than in clean texts, weighted by
smoothed log-odds. Learning uses at most about ``train_rows`` labelled texts, chosen by a hash of the id (documented bound);
scoring covers every whole text. Nothing but the text enters a score.

Defined cases: null and empty texts score as a text without terms. Labels that are null, or of ids without a text, are
ignored; with two labels for an id the larger holds. Without labelled texts of both kinds the lexicon is empty and all scores are
the share of toxic labels. Repeated rows score alike; other columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
MOST_TERMS = 50_000
MIN_TEXTS = 3
ROUNDS = 3
"""Later rounds learn from the toxic texts that the terms of earlier ones leave unexplained."""
EVIDENCE = 14.0
"""A term is taken if its texts' toxic share has a log-likelihood ratio of so much over the usual share (by chance one in a million
terms; some hundred thousand are tried), and odds LEAST_WEIGHT (logarithm) above it."""
LEAST_WEIGHT = 1.5
STEMS = (4, 5, 6, 7, 8)

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "г": "r", "п": "n",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ⅰ": "i", "ſ": "s", "ᴏ": "o", "ʟ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}
UNSEEN = "­​‌‍‎‏⁠﻿"
MARKS = "\"#%&'()*+,-./:;<=>?[\\]^_`{}~\t\n\v\f\r «»¡¿‘’“”–—…"

# Phrases in which a term does no harm.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "white trash bin", "pond scum", "scum line", "sore loser rule", "idiot proof", "idiot light")

_TABLE = {ord(k): v for k, v in (LOOKALIKES | SUBSTITUTES).items()} | {ord(c): None for c in UNSEEN} | {ord(c): " " for c in MARKS}
_TABLE |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}  # full-width forms
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W_][.\-_*·]){2,}[^\W_](?![^\W\d_])")


def folded(text: str | None) -> str:
    """Lower case, look-alikes and substitutions as letters, words between single blanks, a blank at both ends."""
    text = _SPELLED.sub(lambda m: re.sub(r"[.\-_*·]", "", m[0]), text or "")
    # an exclamation mark that ends a word is punctuation, one inside it stands for a letter
    text = re.sub(r"!+(?!\w)", " ", text).lower().translate(_TABLE)
    return f" {' '.join(text.split())} "


@dataclass(frozen=True)
class Lexicon:
    """Terms with a blank before (stems) or on both sides (words), their weights; the curve's bias, sum and density factors."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        made.add_word(folded(phrase), (len(folded(phrase)), None))
    for term, weight in lexicon.terms.items():
        made.add_word(term, (len(term), weight))
    made.make_automaton()
    return made if len(made) else None


def features(text: str | None, matcher: ahocorasick.Automaton | None) -> tuple[float, float, int]:
    """Logarithms of the weights' sum and of their sum for each hundred words; number of terms found."""
    text = folded(text)
    spans, hits = [], []
    for end, (length, weight) in matcher.iter(text) if matcher else ():
        (spans if weight is None else hits).append((end - length + 1, end, weight))
    if spans:
        hits = [h for h in hits if not any(a <= h[0] + 1 and h[1] - 1 <= b for a, b, _ in spans)]
    # a word counts once, with the heaviest of its terms, however often it is repeated
    best: dict[str, float] = {}
    for begin, _, weight in hits:
        word = text[begin:text.index(" ", begin + 1)]
        best[word] = max(weight, best.get(word, 0.0))
    total = sum(best.values())
    return float(np.log1p(total)), float(np.log1p(100 * total / (text.count(" ") + 1))), len(best)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, toxic texts, clean texts), summed within a task as far as 200,000 words."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts[::-1])], names=["word", "toxic", "clean"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[toxic].update(set(folded(text.as_py()).split()))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield flush()
    yield flush()


def _unexplained(terms: dict[str, float], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean texts, and toxic ones without any of the terms."""
    matcher = automaton(Lexicon(terms, (), (0.0, 0.0, 0.0)))
    for batch in batches:
        yield batch.filter(pa.array([not toxic or not matcher or features(x.as_py(), matcher)[2] == 0 for x, toxic in zip(batch.column(0), batch.column(1).to_pylist())], pa.bool_()))


def _found(texts: DataFrame, known: dict[str, float], t: int, c: int, most_terms: int) -> dict[str, float]:
    """Terms of the clean texts and the ``t`` toxic ones that no known term explains."""
    words = texts.mapInArrow(partial(_unexplained, known), "text string, toxic int").mapInArrow(_counted, "word string, toxic long, clean long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a stem counts the texts of its words; whole words are terms of their own
    terms = words.select(F.explode(F.concat(
        F.array(F.concat(F.lit(" "), "word", F.lit(" "))),
        F.filter(F.array(*(F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in STEMS)), lambda x: x.isNotNull()),
    )).alias("term"), "toxic", "clean").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))
    n, usual = F.col("toxic") + F.col("clean"), (t + 0.5) / (t + c + 1)
    evidence = F.col("toxic") * F.log(F.col("toxic") / (n * usual)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - usual)))).otherwise(0.0)
    chosen = terms.where(F.col("toxic") >= MIN_TEXTS).select("term", weight.alias("weight"), evidence.alias("evidence")).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= EVIDENCE))
    rows = chosen.orderBy(F.desc("evidence"), F.desc(F.length("term")), "term").limit(most_terms).collect()
    # words of a few texts and their copies have little evidence beside real terms; if they matter, a later round finds them
    return selected(r for r in rows if r["evidence"] >= 0.05 * rows[0]["evidence"])


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, train_rows: int = TRAIN_ROWS, most_terms: int = MOST_TERMS) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, toxic 0/1)."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    rate = ((n_toxic or 0) + 0.5) / (n + 1)
    empty = Lexicon({}, exceptions, (float(np.log(rate / (1 - rate))), 0.0, 0.0))
    if not n_toxic or n_toxic == n:
        return empty
    part = min(1.0, train_rows / n)
    chosen = known.where(F.pmod(F.crc32(F.concat(F.lit("train-"), F.col("doc_id").cast("string"))), F.lit(1 << 20)) < int(part * (1 << 20)))
    sample = spark.createDataFrame(chosen.toPandas(), chosen.schema)  # of bounded size, see train_rows
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    texts = texts.repartition(max(2, min(64, int(part * n) // 500)))
    kept: dict[str, float] = {}
    t, c = (int(x) for x in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    for _ in range(ROUNDS):
        new = _found(texts, kept, t, c, most_terms)
        if not new:
            break
        kept |= new
        t = texts.where("toxic = 1").mapInArrow(partial(_unexplained, kept), "text string, toxic int").count()
    lexicon = Lexicon(kept, exceptions, empty.curve)

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(lexicon)
        for batch in batches:
            rows = [features(x.as_py(), matcher) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), batch.column(1)], names=["total", "density", "toxic"])

    data = texts.mapInArrow(points, "total double, density double, toxic int").toPandas()  # of bounded size, see train_rows
    return Lexicon(kept, exceptions, fitted(data[["total", "density"]].to_numpy(float), data["toxic"].to_numpy(float))) if len(data) else lexicon


def selected(rows: Iterable) -> dict[str, float]:
    """Of terms (term, weight) in descending order of evidence those that stay: none that begins another one, or is begun by one, with
    more evidence; so of a word's stems the most telling one."""
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for row in rows:
        starts = [row["term"][:k] for k in range(2, len(row["term"]) + 1)]
        if row["term"] not in begun and not any(x in kept for x in starts):
            kept[row["term"]] = float(row["weight"])
            begun.update(starts)
    return kept


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the factors stay at 0 or above, so more terms never lower a score."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * len(y) / 1000 * w
        hessian = (x.T * (p * (1 - p))) @ x + (ridge * len(y) / 1000 + 1e-9) * np.eye(3)
        w = w - np.linalg.solve(hessian, gradient)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_terms`` (words found)."""
    shipped = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.exceptions, lexicon.curve))  # at most MOST_TERMS terms
    names = [c for c in docs.columns if c not in ("toxicity", "toxic_terms")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = Lexicon(*shipped.value)
        matcher, (bias, by_sum, by_density) = automaton(used), used.curve
        for batch in batches:
            rows = [features(x.as_py(), matcher) for x in batch.column("text")]
            odds = [bias + by_sum * a + by_density * b for a, b, _ in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64()), pa.array([r[2] for r in rows], pa.int32())], names=[*names, "toxicity", "toxic_terms"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{out}, toxicity double, toxic_terms int")
