"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells (one category of every attribute). Raking multiplies the cells' weights until the weighted tokens
meet the target shares of each attribute; documents are then kept with a probability in proportion to their cell's
weight, the largest being 1. Expected token shares of the sample meet the targets.

Categories that a target doesn't name (nulls too) share its category ``*``, so there are no more cells than the product of the
targets' sizes, whatever the corpus: that bound lets the driver do the raking on the cells' totals. A target without ``*`` leaves
unnamed categories their present share. Targets of categories without tokens go to the others in proportion.

Defined cases: documents without words have no tokens, and are kept with their cell's probability. A document's fate depends
on its id and text alone, so equal rows fare alike and reruns agree. An empty table gives an empty sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, row_key, word_hashes, word_lengths

REST = "*"
MOST_CELLS = 100_000
TOPICS = 8
TOPIC_WORD = 8
Targets = Mapping[str, Mapping[str, float]]


def with_topics(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """``docs`` with ``tokens`` (words) and ``topic``: words of TOPIC_WORD bytes or more vote, by their hash, for one of
    ``topics`` themes; the most votes win, the smaller number on a tie, and texts without such words have topic 0."""
    names = [c for c in docs.columns if c not in ("tokens", "topic")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, themes = [], []
            for _, _, data, offsets in chunks(*bytes_of(batch.column("text"))):
                words, bounds = word_hashes(data, offsets)
                long = word_lengths(data, offsets) >= TOPIC_WORD
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[long]
                votes = np.bincount(owner * topics + (words[long] % np.uint64(topics)).astype(np.int64), minlength=(len(bounds) - 1) * topics)
                themes += votes.reshape(-1, topics).argmax(1).tolist()
                counts += np.diff(bounds).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(themes, pa.int32())], names=[*names, "tokens", "topic"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{out}, tokens long, topic int")


def category(attribute: str, target: Mapping[str, float]) -> F.Column:
    """The target's name of a row's category."""
    value = F.col(attribute).cast("string")
    return F.when(value.isin([k for k in target if k != REST]), value).otherwise(REST)


def rake(cells: Mapping[tuple[str, ...], float], targets: list[Mapping[str, float]], tolerance: float = 1e-9, most_rounds: int = 1000) -> dict[tuple[str, ...], float]:
    """Weights of the cells under which their tokens meet the targets; cells without tokens keep weight 1."""
    names = [c for c in cells if cells[c] > 0]
    if not names:
        return {c: 1.0 for c in cells}
    tokens = np.array([cells[c] for c in names], float)
    weight = np.ones(len(names))
    margins = []
    for k, target in enumerate(targets):
        present = sorted({c[k] for c in names})
        code = np.array([present.index(c[k]) for c in names])
        now = np.bincount(code, tokens, len(present)) / tokens.sum()
        named = {p: float(target[p]) for p in present if p in target}
        free = [p for p in present if p not in target]
        left = sum(now[present.index(p)] for p in free)
        scale = (1 - left) / sum(named.values()) if sum(named.values()) > 0 else 0.0
        want = np.array([named[p] * scale if p in named else now[present.index(p)] for p in present])
        margins.append((code, want / want.sum()))
    for _ in range(most_rounds):
        worst = 0.0
        for code, want in margins:
            got = np.bincount(code, tokens * weight, len(want)) / (tokens * weight).sum()
            factor = np.divide(want, got, out=np.zeros_like(want), where=got > 0)
            weight = weight * factor[code]
            worst = max(worst, float(np.abs(want - got).max()))
        if worst < tolerance:
            break
    return {c: 1.0 for c in cells} | {c: float(w) for c, w in zip(names, weight / weight.max())}


def calibrated(docs: DataFrame, targets: Targets, tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``keep_probability``."""
    spark = docs.sparkSession
    bound = int(np.prod([len(set(t) | {REST}) for t in targets.values()]))
    if bound > MOST_CELLS:
        raise ValueError(f"the targets name {bound} cells; {MOST_CELLS} at most can be raked")
    names = [f"_c{i}" for i in range(len(targets))]
    placed = docs.select("*", *(category(a, t).alias(n) for n, (a, t) in zip(names, targets.items())))
    cells = placed.groupBy(*names).agg(F.sum(tokens).alias("t")).collect()  # at most MOST_CELLS rows
    weights = rake({tuple(r[n] for n in names): float(r["t"] or 0) for r in cells}, list(targets.values()))
    schema = ", ".join(f"{n} string" for n in names) + ", keep_probability double"
    table = spark.createDataFrame([(*c, w) for c, w in weights.items()], schema)
    return placed.drop("keep_probability").join(F.broadcast(table), names).drop(*names)


def drawn(seed: int) -> F.Column:
    """A number from 0 to 1, fixed by the row's id and text."""
    return F.pmod(F.xxhash64(row_key(), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: Targets, tokens: str = "tokens", seed: int = 7) -> DataFrame:
    """``docs`` with ``keep_probability`` and ``kept``."""
    return calibrated(docs, targets, tokens).withColumn("kept", drawn(seed) < F.col("keep_probability"))
