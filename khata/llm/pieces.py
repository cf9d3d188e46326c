"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece holds a whitespace marker after another character, nothing is ever merged across the beginning of a run of
markers. So a text falls into chunks (a run of markers and what follows it) that can be segmented apart. Blocks of texts send
their distinct chunks, dealt by hash into parts; a part segments each of its distinct chunks once and sends the ids back to the
blocks; there they are put in the chunks' places, so that every text gets its ids in order. A block is named by a
hash of its texts: it is the same however often a task runs again, and equal blocks share their ids.

Defined cases: null and empty texts have no ids and decode to the empty string. A literal U+2581 counts as a space, as the
library has it. Repeated rows are encoded each. Columns beside ``text`` are handed through; ``ids`` and ``decoded`` of the
caller are replaced. An empty table gives an empty result. A very long text is a block of its own; its chunks and ids are held in
one task, as its row is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .chunked import binaries, blocks, flattened, packed, space_runs, spaced, unpacked
from .common import partitions_of, written

MARKER = "▁"
BLOCK_BYTES = 8 << 20
"""Text of a block. Larger ones send fewer distinct chunks."""
OUT_IDS = 1 << 20
"""Ids of a batch of results, or one text's if it has more."""

WORDS, CODES, PLACES, TEXT = range(4)
"""Kinds of rows on their way: chunks of a block and part; their ids; places and parts of a block's chunks; one text."""


def check_model(model: bytes) -> None:
    """Raise where chunks can't be segmented apart."""
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    rules = spec.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
        raise ValueError("the model's normalisation isn't the identity with a dummy prefix")
    if spec.trainer_spec.treat_whitespace_as_suffix or any(MARKER in p.piece.lstrip(MARKER) for p in spec.pieces):
        raise ValueError("the model has pieces that cross whitespace markers")
    if all(p.piece != MARKER for p in spec.pieces):
        raise ValueError("the model has no piece for a lone marker")


def segment(processor: sentencepiece.SentencePieceProcessor, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each chunk, all ids). The library adds the first marker itself, but not to an empty text."""
    lone = [processor.piece_to_id(MARKER)]
    ids = [found or lone for found in processor.encode([w[1:].decode() for w in words], num_threads=1)]
    lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
    return lengths, np.fromiter((i for found in ids for i in found), np.uint32, int(lengths.sum()))


def _cut(batch: pa.RecordBatch, text: int):
    marked = pc.replace_substring(spaced(batch.column(text)), MARKER, " ")
    for block in blocks(marked, space_runs, BLOCK_BYTES):
        name = hashlib.blake2b(block.data, digest_size=16)
        name.update(block.offsets.tobytes())
        yield name.digest(), block


def _parts(block, n_parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % n_parts for w in block.words.to_pylist()), np.uint16 if n_parts <= 1 << 16 else np.uint32, len(block.words))


def _send_words(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in _cut(batch, 0):
                parts = _parts(block, n_parts)
                order = np.argsort(parts, kind="stable")
                words, edges = block.words.take(pa.array(order)), np.searchsorted(parts[order], np.arange(n_parts + 1))
                rows = []
                for part in np.flatnonzero(np.diff(edges)):
                    data, offsets = _bytes(words.slice(edges[part], edges[part + 1] - edges[part]))
                    rows.append((name, int(part), packed(np.diff(offsets).astype(np.uint32)), zstandard.compress(data.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "lengths", "payload"])
    return run


def _bytes(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of sorted batches, gathered by one column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[column] != now and rows:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


def _segment_parts(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for part, rows in _by_key(batches, 1):
            rows = list({row[0]: row for row in rows}.values())  # equal blocks
            lengths = [unpacked(row[2], np.uint32) for row in rows]
            data = np.frombuffer(b"".join(zstandard.decompress(row[3]) for row in rows), np.uint8)
            coded = binaries(data, np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])).dictionary_encode()
            counts, ids = segment(processor, coded.dictionary.to_pylist())
            starts, at = np.cumsum(counts, dtype=np.int64) - counts, np.asarray(coded.indices)
            ends = np.cumsum([len(x) for x in lengths])
            out = []
            for row, mine in zip(rows, np.split(at, ends[:-1])):
                out.append((row[0], part, packed(counts[mine]), packed(ids[flattened(starts[mine], counts[mine])])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "lengths", "payload"])
    return run


def _send_texts(n_parts: int):
    """Every text with its range in the block's places, and one row with the places of the block."""
    names = ["block", "kind", "start", "length", "lengths", "payload", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in _cut(batch, 0):
                n = block.end - block.first
                kinds = pa.array([TEXT] * n + [PLACES], pa.int32())
                bounds = block.bounds.astype(np.int64)
                lengths = pa.array([None] * n + [packed(_parts(block, n_parts))], pa.binary())
                payload = pa.array([None] * n + [packed(block.places)], pa.binary())
                row = pa.concat_arrays([batch.column(1).slice(block.first, n), pa.nulls(1, batch.column(1).type)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * (n + 1), pa.binary()), kinds, pa.array(np.append(bounds[:-1], 0)),
                    pa.array(np.append(np.diff(bounds), 0)), lengths, payload, row], names)
    return run


def _assemble(model: bytes | None, n_parts: int):
    """Streams the sorted rows of a block: ids of its chunks, their places, then its texts."""
    def results(row, counts, values, processor):
        ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(values.astype(np.int32)))
        columns, names = [row, ids.cast(pa.list_(pa.int32()))], ["row", "ids"]
        if processor:
            columns.append(pa.array([processor.decode(found) for found in ids.to_pylist()], pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model) if model else None
        now, codes = None, {}
        for batch in batches:
            names, kinds = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or kinds[i] != kinds[i - 1]), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if names[a] != now:
                    now, codes, places = names[a], {}, None
                if kinds[a] == CODES:
                    for part, lengths, ids in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in (2, 4, 5))):
                        codes[part] = unpacked(lengths, np.uint32), unpacked(ids, np.uint32)
                elif kinds[a] == PLACES:
                    parts = unpacked(batch.column(4)[a].as_py(), np.uint16 if n_parts <= 1 << 16 else np.uint32)
                    places = unpacked(batch.column(5)[a].as_py(), np.uint32)
                    found = sorted(codes)
                    order = np.argsort(parts, kind="stable")
                    counts = np.zeros(len(parts), np.int64)
                    if sum(len(codes[p][0]) for p in found) != len(parts):
                        raise ValueError("a block's chunks weren't found again: the texts changed between two reads")
                    counts[order] = np.concatenate([codes[p][0] for p in found]) if found else 0
                    values = np.concatenate([codes[p][1] for p in found]) if found else np.zeros(0, np.uint32)
                    starts = np.zeros(len(parts), np.int64)
                    starts[order] = np.cumsum(counts[order]) - counts[order]
                    codes = {}
                else:
                    if places is None:
                        raise ValueError("a text came without its block")
                    first, length = np.asarray(batch.column(2).slice(a, b - a)), np.asarray(batch.column(3).slice(a, b - a))
                    row = batch.column(6).slice(a, b - a)
                    at = places[flattened(first, length)]
                    edge = np.concatenate([[0], np.cumsum(length)])
                    total = np.concatenate([[0], np.cumsum(counts[at])])[edge]
                    i = 0
                    while i < b - a:
                        j = max(i + 1, int(np.searchsorted(total, total[i] + OUT_IDS, "right")) - 1)
                        mine = at[edge[i]:edge[j]]
                        yield results(row.slice(i, j - i), np.diff(total[i:j + 1]), values[flattened(starts[mine], counts[mine])], processor)
                        i = j
    return run


def repeatable(docs: DataFrame) -> DataFrame:
    """Rows that come in the same order in every read: files as they are, anything else written first."""
    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        return written(docs, "texts")


def encode(docs: DataFrame, model: bytes, decoded: bool = False) -> DataFrame:
    """The columns of docs but ``text``, with ``ids`` (array of int) and, if asked for, ``decoded``, the library's text of the ids."""
    check_model(model)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("text", "ids", "decoded")]
    docs = repeatable(docs.select("text", *(f"`{c}`" for c in kept)))
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    given = docs.select("text", row.alias("row"))
    parts = partitions_of(spark)
    words = given.select("text").mapInArrow(_send_words(parts), "block binary, part int, lengths binary, payload binary")
    codes = words.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(
        _segment_parts(model), "block binary, part int, lengths binary, payload binary")
    row_field = T.StructField("row", given.schema["row"].dataType)
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("block", T.BinaryType()), ("kind", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
        ("lengths", T.BinaryType()), ("payload", T.BinaryType()))] + [row_field])
    texts = given.mapInArrow(_send_texts(parts), schema)
    both = texts.unionByName(codes.select(
        "block", F.lit(CODES).alias("kind"), F.col("part").cast("long").alias("start"), F.lit(0).cast("long").alias("length"),
        "lengths", "payload", F.lit(None).cast(row_field.dataType).alias("row")))
    out = T.StructType([row_field, T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("decoded", T.StringType())] if decoded else []))
    done = both.repartition("block").sortWithinPartitions("block", "kind", "start").mapInArrow(_assemble(model if decoded else None, parts), out)
    return done.select(*(F.col(f"row.`{c}`") for c in kept), "ids", *(["decoded"] if decoded else []))


def decode(coded: DataFrame, model: bytes) -> DataFrame:
    """``coded`` with ``decoded``, the library's text of ``ids`` (any ids, null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = pa.array([processor.decode(ids or []) for ids in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(1), texts], ["row", "decoded"])

    kept = [c for c in coded.columns if c.lower() != "decoded"]
    given = coded.select("ids", F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    schema = T.StructType([given.schema["row"], T.StructField("decoded", T.StringType())])
    return given.mapInArrow(run, schema).select(*(F.col(f"row.`{c}`") for c in kept), "decoded")
