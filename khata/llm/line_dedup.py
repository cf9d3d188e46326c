"""Line de-duplication: lines that many documents share stay in one of them only.

Pass one sends the bits of every line's hash to two Bloom filters (once-seen, twice-seen). Pass two looks each line up in the
second filter and shuffles only suspected repeats, as 128-bit digests of the line's key; these are counted exactly, and
the document that keeps the line is chosen. Pass three drops the others' lines.

Defined cases: a null or empty text is one empty line. Lines of fewer than ``min_chars`` code points are never dropped. A
line counts once for each document row that holds it. The largest ``doc_id`` keeps the line (rows that repeat it too); a
null ``doc_id`` keeps it only if all holders' are null. Repeated rows get the same result, and other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .sightings import SLOT_SCHEMA, filter_bits, slot_batches, suspect, twice_filter

TRIM = " \t\n\v\f\r"
ROW = "_row"


def line_keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines that can be dropped."""
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars:
            key = line.strip(TRIM)
            if len(key) >= min_chars:
                yield i, key.encode("utf-8").lower()  # bytes.lower() changes A-Z only


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` less the dropped lines, and ``n_lines``, ``n_dropped``, ``kept_sha256``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(total // min_chars)

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes() -> Iterator[np.ndarray]:
            for batch in batches:
                found: list[int] = []
                for text in batch.column(0):
                    found += {xxhash.xxh3_64_intdigest(k) for _, k in line_keys(text.as_py(), min_chars)}
                yield np.array(found, np.uint64)
        return slot_batches(hashes(), bits)

    seen = spark.sparkContext.broadcast(twice_filter(docs.select("text").mapInArrow(slots, SLOT_SCHEMA), bits))

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = suspect(seen.value, bits)
        for batch in batches:
            rows, ids, digests, hashes = [], [], [], []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys = {k for _, k in line_keys(text.as_py(), min_chars)}
                hashes += [xxhash.xxh3_64_intdigest(k) for k in keys]
                digests += [xxhash.xxh3_128_digest(k) for k in keys]
                rows += [row] * len(keys)
                ids += [doc_id] * len(keys)
            keep = pa.array(maybe(np.array(hashes, np.uint64)), pa.bool_())
            out = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], names=[ROW, "doc_id", "digest"])
            yield out.filter(keep)

    marked = docs.withColumn(ROW, row_key())
    found = written(marked.select(ROW, F.col("doc_id").cast("long"), "text").mapInArrow(suspects, f"{ROW} long, doc_id long, digest binary"), "line-suspects")
    # a table of its own, so that the join's sides are plain exchanges, of which Spark can split a hot line
    confirmed = written(found.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"), "shared-lines")
    drops = found.join(confirmed, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(ROW).agg(F.collect_set("digest").alias("_drops"))

    schema = marked.drop(ROW).schema
    names = [f.name for f in schema]
    added = ["n_lines", "n_dropped", "kept_sha256"]
    kept_names = [c for c in names if c not in added]

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped, shas = [], [], [], []
            for text, drop in zip(batch.column("text"), batch.column("_drops")):
                text = text.as_py()
                split = (text or "").split("\n")
                gone = set()
                if drop.is_valid:
                    wanted = set(drop.as_py())
                    gone = {i for i, k in line_keys(text, min_chars) if xxhash.xxh3_128_digest(k) in wanted}
                kept = "\n".join(x for i, x in enumerate(split) if i not in gone) if gone else (text or "")
                texts.append(text if not gone else kept)
                lines.append(len(split))
                dropped.append(len(gone))
                shas.append(hashlib.sha256(kept.encode("utf-8")).hexdigest())
            columns = {n: batch.column(n) for n in kept_names} | {"text": pa.array(texts, pa.string())}
            columns |= dict(zip(added, (pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string()))))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in kept_names)
    out = f"{out}, n_lines long, n_dropped long, kept_sha256 string"
    return marked.join(drops, ROW, "left").select(*(F.col(f"`{n}`") for n in kept_names), "_drops").mapInArrow(remove, out)


def length_after() -> F.Column:
    """``n_chars`` after dropping: of the text that stays; as it was where no line went."""
    return F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
