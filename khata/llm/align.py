"""Alignment of two tokenizers' tokens, with corpus-wide document counts of linked token pairs by external spill counting.

A text, with a space before it, is encoded by tokenizer A (byte-level BPE) and B (SentencePiece). Byte offsets where tokens of both
end cut it into groups; tokens of A and B whose byte ranges overlap are linked. How many documents hold a pair of ids linked is
counted over the corpus and given back to each text.

Counting: blocks of texts are cut at spaces that both tokenizers end a token before, so each distinct chunk is
encoded once a block. A block's pair-document records are added up to (pair, documents), sorted by A's id and then B's,
dealt by radix into parts, and spilled as zstd runs to the shared folder. A part is a k-way heap merge of its runs: each pair's
count is complete when the next pair comes, goes back into every run that held the pair, and A's ids pass in order, so
their largest counts come out on the way. The runs of counts return to their blocks, where texts add them up. An A id's pairs
are dealt by ranges of B ids too, so that a very frequent one is no single task; its maxima, at most one for each id of A's
vocabulary, are then compared once more.

Defined cases: null and empty texts, and those whose tokens' bytes aren't the text's (a literal U+2581), have no tokens and add nothing to
counts. Repeated rows are documents of their own. Columns beside ``text`` are handed through; ones named like a result are
replaced. An empty table gives an empty result. A very long text is a block of its own, held in one task as its row is.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunked import SPACE, binaries, blocks, flattened, packed, spaced, unpacked
from .common import mixed, partitions_of, written

BLOCK_BYTES = 4 << 20
"""Text of a block."""
B_RANGE = 10
"""Pairs of an A id are dealt by runs of 2 ** B_RANGE ids of B."""
MERGED = 1 << 16
"""Records that come out of a merge at a time."""

RUN, PAIRS, COUNTS, BLOCK, TEXT = range(5)
"""Kinds of rows: a block's records of a part; a part's pairs with counts; the counts of a run; a block; one text."""
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
# Bytes that no token boundary is assumed before, as they may begin a white space character.
WIDE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)


def shared_cuts(data: np.ndarray) -> np.ndarray:
    """Single spaces before a visible character: tokens of both kinds end there."""
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        after = data[2:]
        cut[1:-1] = (data[1:-1] == SPACE) & (data[:-2] != SPACE) & (after > SPACE) & ~np.isin(after, WIDE_SPACE)
    return cut


class Vocabularies:
    """Both tokenizers with the bytes of their tokens, and the tokens' numbers as text."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in plain]
        byte = {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(rest)}
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(self.n_a)]
        self.a_bytes = pa.array([bytes(byte.get(c, 0) for c in e) for e in entries], pa.large_binary())
        self.b_bytes = pa.array([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.n_b))], pa.large_binary())
        self.a_len, self.b_len = (np.diff(np.frombuffer(x.buffers()[1], np.int64)) for x in (self.a_bytes, self.b_bytes))
        numbers = [f"{i}{end}".encode() for end, n in ((",", self.n_a), ("|", self.n_a), (",", self.n_b), (";", self.n_b)) for i in range(n)]
        self.numbers = pa.array(numbers, pa.large_binary())
        self.digits = np.fromiter(map(len, numbers), np.int64, len(numbers))


class Aligned(NamedTuple):
    """Of each distinct chunk: whether its bytes come back, its numbers of tokens, groups and links, codes of links, groups as text."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    codes: np.ndarray
    text: pa.LargeBinaryArray


def _ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return lengths, np.fromiter((i for x in lists for i in x), np.int64, int(lengths.sum()))


def _encoded(v: Vocabularies, words: list[bytes]):
    texts = [w.decode() for w in words]
    a = [e.ids for k in range(0, len(texts), 4096) for e in v.a.encode_batch(texts[k:k + 4096], add_special_tokens=False)]
    return _ids(a), _ids(v.b.encode([t[1:] for t in texts], num_threads=1))


def _returning(table: pa.LargeBinaryArray, sizes: np.ndarray, lengths: np.ndarray, ids: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which chunks the bytes of their tokens make up."""
    total = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(lengths)])]
    good = np.diff(total) == np.diff(edges)
    kept = table.take(pa.array(ids[np.repeat(good, lengths)]))
    got = np.frombuffer(kept.buffers()[2] or b"", np.uint8)[:int(np.diff(edges)[good].sum())]
    wanted = data[flattened(edges[:-1][good], np.diff(edges)[good])]
    wrong = np.flatnonzero(got != wanted)
    if len(wrong):
        good[np.flatnonzero(good)[np.unique(np.searchsorted(np.cumsum(np.diff(edges)[good]), wrong, "right"))]] = False
    return good


def align_words(v: Vocabularies, words: pa.LargeBinaryArray) -> Aligned:
    """Links and groups of distinct chunks, all at once: ends of tokens are offsets in the chunks' joined bytes."""
    (len_a, a), (len_b, b) = _encoded(v, words.to_pylist())
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    data, edges = np.frombuffer(data or b"", np.uint8)[edges[0]:edges[-1]], edges - edges[0]
    good = _returning(v.a_bytes, v.a_len, len_a, a, data, edges) & _returning(v.b_bytes, v.b_len, len_b, b, data, edges)
    a, b = a[np.repeat(good, len_a)], b[np.repeat(good, len_b)]
    len_a, len_b = len_a * good, len_b * good
    word_ends = np.cumsum(np.diff(edges) * good)
    ends_a, ends_b = np.cumsum(v.a_len[a]), np.cumsum(v.b_len[b])
    ends = np.union1d(ends_a, ends_b)
    codes = a[np.searchsorted(ends_a, ends)] * v.n_b + b[np.searchsorted(ends_b, ends)]
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    last_a, last_b = np.isin(ends_a, cuts, assume_unique=True), np.isin(ends_b, cuts, assume_unique=True)
    before_b = np.concatenate([[0], np.searchsorted(ends_b, cuts, "right")])
    item = np.empty(len(a) + len(b), np.int64)
    item[np.arange(len(a)) + before_b[np.searchsorted(cuts, ends_a)]] = a + last_a * v.n_a
    item[np.arange(len(b)) + np.searchsorted(ends_a, cuts, "right")[np.searchsorted(cuts, ends_b)]] = 2 * v.n_a + b + last_b * v.n_b
    joined = v.numbers.take(pa.array(item))
    size = np.concatenate([[0], np.cumsum(v.digits[item])])[np.concatenate([[0], np.cumsum(len_a + len_b)])]
    text = binaries(np.frombuffer(joined.buffers()[2] or b"", np.uint8)[:size[-1]], size)
    per_word = [np.diff(np.concatenate([[0], np.searchsorted(x, word_ends, "right")])) for x in (cuts, ends)]
    return Aligned(good, len_a, len_b, per_word[0], per_word[1], codes, text)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def part_of(codes: np.ndarray, n_b: int, n_parts: int) -> np.ndarray:
    """Part of a pair, by its A id and a range of B ids."""
    return (mixed(((codes // n_b) << 32 | (codes % n_b) >> B_RANGE).astype(np.uint64)) % np.uint64(n_parts)).astype(np.uint32)


def _spill(a_json: str, b_model: bytes, n_parts: int, digest: bool):
    names = ["block", "kind", "part", "start", "length", "one", "two", "three", "four", *FIELDS[:4], "groups", "row"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 4, pa.string()]

    def table(rows: list[dict], row: pa.Array) -> pa.RecordBatch:
        columns = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([*columns, row], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(a_json, b_model)
        for batch in batches:
            for block in blocks(spaced(batch.column(0)), shared_cuts, BLOCK_BYTES):
                name, n = uuid.uuid4().bytes, block.end - block.first
                w, bounds, places = align_words(v, block.words), block.bounds, block.places
                whole = (_sums(~w.good[places], bounds) == 0) & (np.diff(bounds) > 0)
                counts = {k: _sums(x[places], bounds) * whole for k, x in zip(FIELDS, (w.n_a, w.n_b, w.n_groups, w.n_links))}
                said = w.text.take(pa.array(places))
                _, at, said = said.buffers()
                at, said = np.frombuffer(at, np.int64)[bounds], memoryview(said or b"")
                groups = [(hashlib.sha256(said[s:e - 1]).hexdigest() if digest else str(said[s:e - 1], "ascii")) if ok else "" for s, e, ok in zip(at, at[1:], whole)]
                # links of chunks in texts that count, as indices of the block's distinct pairs
                kept = places[np.repeat(whole, np.diff(bounds))]
                used = np.zeros(len(block.words), bool)
                used[kept] = True
                pairs, links = np.unique(w.codes[np.repeat(used, w.n_links)], return_inverse=True)
                n_links = w.n_links * used
                firsts = np.cumsum(n_links) - n_links
                document = np.repeat(np.repeat(np.arange(n), np.diff(bounds) * whole), n_links[kept])
                seen = np.unique(document * max(len(pairs), 1) + links[flattened(firsts[kept], n_links[kept])])
                documents = np.bincount(seen % max(len(pairs), 1), minlength=len(pairs)) if len(pairs) else np.zeros(0, np.int64)
                parts = part_of(pairs, v.n_b, n_parts)
                order = np.argsort(parts, kind="stable")
                edges = np.searchsorted(parts[order], np.arange(n_parts + 1))
                rows = []
                for part in np.flatnonzero(np.diff(edges)):
                    mine = order[edges[part]:edges[part + 1]]
                    rows.append({"block": name, "kind": RUN, "part": int(part), "one": packed(np.diff(pairs[mine], prepend=0)), "two": packed(documents[mine].astype(np.uint32))})
                rows.append({"block": name, "kind": BLOCK, "part": 0, "one": packed(places), "two": packed(n_links.astype(np.uint32)), "three": packed(links.astype(np.uint32)),
                             "four": packed(np.concatenate([parts, np.diff(pairs // v.n_b, prepend=0).astype(np.uint32)]))})
                yield table(rows, pa.nulls(len(rows), batch.column(1).type))
                texts = [{"block": name, "kind": TEXT, "part": 0, "start": s, "length": e - s if ok else 0, "groups": g} for s, e, ok, g in zip(bounds.tolist(), bounds[1:].tolist(), whole.tolist(), groups)]
                for k, x in counts.items():
                    for r, value in zip(texts, x.tolist()):
                        r[k] = value
                yield table(texts, batch.column(1).slice(block.first, n))
    return run


def _merge(n_b: int):
    """Counts of a part's pairs: a heap of runs, each sorted, gives all records in the order of A's ids and then B's."""
    names = ["block", "kind", "part", "one", "two"]

    def merged(part: int, rows: list[tuple]) -> Iterator[tuple]:
        runs = [np.cumsum(unpacked(r[2], np.int64)) for r in rows]
        documents = np.concatenate([unpacked(r[3], np.uint32) for r in rows]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        at, k = offsets[:-1].copy(), len(runs)
        back = np.empty(offsets[-1], np.int64)
        heap = heapq.merge(*((run * k + i).tolist() for i, run in enumerate(runs)))
        held = np.zeros(0, np.int64)
        codes, totals = [], []
        while True:
            new = np.fromiter(islice(heap, MERGED), np.int64)
            records = np.concatenate([held, new])
            if not len(records):
                break
            # the last pair's records wait, as more of them may follow
            done = np.searchsorted(records, records[-1] // k * k) if len(new) else len(records)
            ready, held = records[:done], records[done:]
            if not done:
                continue
            code, run = ready // k, ready % k
            by_run = np.argsort(run, kind="stable")
            per_run = np.bincount(run, minlength=k)
            place = np.empty(done, np.int64)
            place[by_run] = flattened(at, per_run)
            at += per_run
            firsts = np.flatnonzero(np.diff(code, prepend=-1))
            total = np.add.reduceat(documents[place], firsts)
            back[place] = np.repeat(total, np.diff(np.append(firsts, done)))
            codes.append(code[firsts])
            totals.append(total)
        yield None, PAIRS, part, packed(np.diff(np.concatenate(codes), prepend=0)), packed(np.concatenate(totals))
        for row, counts in zip(rows, np.split(back, offsets[1:-1])):
            yield row[0], COUNTS, part, packed(counts), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part, rows):
            out = zip(*merged(part, rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names)

        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] != now and rows:
                    yield done(now, rows)
                    rows = []
                now = row[1]
                rows.append(row)
        if rows:
            yield done(now, rows)
    return run


def _pairs(n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.cumsum(unpacked(one, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((codes // n_b).astype(np.int32)), pa.array((codes % n_b).astype(np.int32)), pa.array(unpacked(two, np.int64))], ["a_id", "b_id", "n_docs"])
    return run


def _give_back(most: np.ndarray):
    """Streams the sorted rows of a block: counts of its runs, the block, then its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, best, total = None, {}, None, None
        for batch in batches:
            names, kinds = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or kinds[i] != kinds[i - 1]), len(names)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if names[s] != now:
                    now, counts, best, total = names[s], {}, None, None
                if kinds[s] == COUNTS:
                    for part, blob in zip(*(batch.column(c).slice(s, e - s).to_pylist() for c in (2, 5))):
                        counts[part] = unpacked(blob, np.int64)
                elif kinds[s] == BLOCK:
                    places, n_links, links, rest = (unpacked(batch.column(c)[s].as_py(), np.uint32) for c in (5, 6, 7, 8))
                    parts, a = np.split(rest, 2)
                    a = np.cumsum(a)
                    of_pair = np.zeros(len(parts), np.int64)
                    if len(parts):
                        of_pair[np.argsort(parts, kind="stable")] = np.concatenate([counts[p] for p in sorted(counts)])
                    word = np.concatenate([[0], np.cumsum(n_links, dtype=np.int64)])
                    per_word = [_sums(x[links], word) for x in ((of_pair == most[a]).astype(np.int64), of_pair)]
                    best, total = (np.concatenate([[0], np.cumsum(x[places])]) for x in per_word)
                    counts = {}
                else:
                    start, length = (np.asarray(batch.column(c).slice(s, e - s)) for c in (3, 4))
                    given = [batch.column(c).slice(s, e - s) for c in range(9, 15)]
                    yield pa.RecordBatch.from_arrays(
                        [given[5], *given[:4], pa.array(best[start + length] - best[start]), pa.array(total[start + length] - total[start]), given[4]],
                        ["row", *FIELDS, "groups"])
    return run


class Alignment:
    """Alignment of ``text`` of docs; ``rows`` and ``pairs`` share the spilled blocks and the merged counts."""

    def __init__(self, docs: DataFrame, a_json: str, b_model: bytes, digest: bool = False):
        self.a_json, self.b_model, self.digest = a_json, b_model, digest
        self.name = "groups_sha256" if digest else "groups"
        taken = {"text", self.name, *FIELDS}
        self.kept = [c for c in docs.columns if c.lower() not in taken]
        row = F.struct(*(F.col(f"`{c}`") for c in self.kept)) if self.kept else F.struct(F.lit(None).cast("int").alias("none"))
        self.given = docs.select("text", row.alias("row"))
        self.row_field = T.StructField("row", self.given.schema["row"].dataType)  # null in rows of other kinds
        self.parts = partitions_of(docs.sparkSession)
        v = Vocabularies(a_json, b_model)
        self.n_a, self.n_b = v.n_a, v.n_b

    @cached_property
    def blocks(self) -> DataFrame:
        """Runs, blocks and texts, spilled to the shared folder."""
        kinds = (("block", T.BinaryType()), ("kind", T.IntegerType()), ("part", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
                 *((n, T.BinaryType()) for n in ("one", "two", "three", "four")), *((n, T.LongType()) for n in FIELDS[:4]), ("groups", T.StringType()))
        schema = T.StructType([T.StructField(n, t) for n, t in kinds] + [self.row_field])
        return written(self.given.mapInArrow(_spill(self.a_json, self.b_model, self.parts, self.digest), schema), "runs")

    @cached_property
    def merged(self) -> DataFrame:
        runs = self.blocks.where(F.col("kind") == RUN).select("block", "part", "one", "two")
        dealt = runs.repartition(self.parts, "part").sortWithinPartitions("part", "block")
        return written(dealt.mapInArrow(_merge(self.n_b), "block binary, kind int, part int, one binary, two binary"), "counts")

    @property
    def pairs(self) -> DataFrame:
        """(a_id, b_id, n_docs) of all linked pairs."""
        return self.merged.where(F.col("kind") == PAIRS).select("one", "two").mapInArrow(_pairs(self.n_b), "a_id int, b_id int, n_docs long")

    @property
    def rows(self) -> DataFrame:
        """The columns of docs but ``text``, FIELDS, and the groups: as text, or its SHA-256 (without tokens: empty)."""
        most = np.zeros(self.n_a, np.int64)  # one number for each id of A's vocabulary, whatever the corpus
        for a, n in self.pairs.groupBy("a_id").agg(F.max("n_docs")).collect():
            most[a] = n
        rest = self.blocks.where(F.col("kind") != RUN)
        back = self.merged.where(F.col("kind") == COUNTS).select("block", "kind", "part", "one")
        both = rest.unionByName(back, allowMissingColumns=True)
        schema = T.StructType([self.row_field, *(T.StructField(n, T.LongType()) for n in FIELDS), T.StructField("groups", T.StringType())])
        done = both.repartition("block").sortWithinPartitions("block", "kind", "part", "start").mapInArrow(_give_back(most), schema)
        return done.select(*(F.col(f"row.`{c}`") for c in self.kept), *FIELDS, F.col("groups").alias(self.name))
