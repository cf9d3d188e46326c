"""Token alignment and SentencePiece chunks against the tokenizers applied to whole texts."""

import collections
import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from khata.llm import align, pieces
from khata.llm.queries import tokenizer_file

SYLLABLES = [" ", "  ", "a", "the", " the", "\n", "é", "日本", "\0", "\t", "<|endoftext|>", "<s>", "<0x41>", "x", "😀", " \n", " ", " 1", "ab ", "'s",
             " don't", "hello", "　", " ", "word ", "\r\n", "Ünder", "…", "٣"]


def odd_texts(n: int = 600, seed: int = 5) -> list:
    rng = random.Random(seed)
    texts = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    marked = [t + "▁" + t for t in texts[:20]]
    return [*texts, *marked, None, "", " ", "  ", "▁", "a ", " a", "\n", "x" * 50_000, "word and " * 20_000, *texts[:5]]


@pytest.fixture(scope="module")
def files():
    return tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i * 2, "caller's") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, `N_A` long, `Ids` string").repartition(3).cache()


def naive_alignment(files, texts):
    """Whole texts, token by token; groups as lists."""
    a_json, b_model = files
    a, b = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    for i, x in enumerate(sorted(set(range(256)) - set(plain))):
        letters[chr(256 + i)] = x
    results, counts = [], collections.Counter()
    for t in texts:
        if not t:
            results.append(None)
            continue
        whole = (" " + t).encode()
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            results.append(None)
            continue
        i = j = end_a = end_b = 0
        links, groups, now_a, now_b = [], [], [], []
        end_a, end_b = len(bytes_a[0]), len(bytes_b[0])
        while i < len(ids_a) and j < len(ids_b):
            links.append((ids_a[i], ids_b[j]))
            x, y = end_a, end_b
            if x <= y:
                now_a.append(ids_a[i])
                i += 1
                end_a += len(bytes_a[i]) if i < len(ids_a) else 0
            if y <= x:
                now_b.append(ids_b[j])
                j += 1
                end_b += len(bytes_b[j]) if j < len(ids_b) else 0
            if x == y:
                groups.append(",".join(map(str, now_a)) + "|" + ",".join(map(str, now_b)))
                now_a, now_b = [], []
        counts.update(set(links))
        results.append((len(ids_a), len(ids_b), groups, links))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == most[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), ";".join(r[2])) for r in results]
    return rows, counts


def test_alignment(spark, docs, files, monkeypatch):
    monkeypatch.setattr(align, "MERGED", 97)  # many steps of the merge
    aligned = align.Alignment(docs, *files)
    want, counts = naive_alignment(files, odd_texts())
    got = {r["doc_id"]: r for r in aligned.rows.collect()}
    assert aligned.rows.columns == ["doc_id", "Ids", *align.FIELDS, "groups"]
    assert len(got) == len(want) and all(tuple(got[i])[2:] == w for i, w in enumerate(want))
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in aligned.pairs.collect()} == dict(counts)
    hashed = {r["doc_id"]: r["groups_sha256"] for r in align.Alignment(docs, *files, digest=True).rows.collect()}
    assert all(hashed[i] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for i, w in enumerate(want))


def test_small_blocks_and_parts_change_nothing(spark, docs, files, monkeypatch):
    fields = ["doc_id", *align.FIELDS, "groups_sha256"]
    whole = sorted(map(tuple, align.Alignment(docs, *files, digest=True).rows.select(*fields).collect()))
    monkeypatch.setattr(align, "BLOCK_BYTES", 300)
    monkeypatch.setattr(align, "B_RANGE", 4)
    assert sorted(map(tuple, align.Alignment(docs, *files, digest=True).rows.select(*fields).collect())) == whole


def test_sentencepiece(spark, docs, files, monkeypatch):
    monkeypatch.setattr(pieces, "OUT_IDS", 500)
    library = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    coded = pieces.encode(docs, files[1], decoded=True)
    assert coded.columns == ["doc_id", "N_A", "ids", "decoded"]
    got = {r["doc_id"]: r for r in coded.collect()}
    for i, t in enumerate(odd_texts()):
        ids = library.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids), repr(t)[:200]
    again = pieces.decode(pieces.encode(docs, files[1]), files[1])
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {i: r["decoded"] for i, r in got.items()}


def test_decode_any_ids(spark, files):
    library = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    lists = [[], [3 + 0xC3], [259, 5, 1], [3 + 0xE6, 3 + 0x97, 3 + 0xA5], None]
    coded = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "n int, ids array<int>")
    assert [r["decoded"] for r in pieces.decode(coded, files[1]).orderBy("n").collect()] == [library.decode(x or []) for x in lists]


def test_equal_blocks_and_files(spark, files, tmp_path):
    """Each file is a block; two are equal and share their ids."""
    for i in range(3):
        spark.createDataFrame([(i, "one two two three")] * 4, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t{i}")
    docs = spark.read.parquet(*(f"{tmp_path}/t{i}" for i in range(3)))
    got = pieces.encode(docs, files[1]).collect()
    ids = sentencepiece.SentencePieceProcessor(model_proto=files[1]).encode("one two two three")
    assert sorted(r["doc_id"] for r in got) == sorted([0, 1, 2] * 4) and all(r["ids"] == ids for r in got)


def test_no_texts(spark, files):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(none, files[1], decoded=True).collect() == [] and align.Alignment(none, *files).rows.collect() == []
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [tuple(r) for r in pieces.encode(nulls, files[1], decoded=True).collect()] == [(None, [], "")] * 3
    assert [tuple(r) for r in align.Alignment(nulls, *files).rows.collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 3


def test_models_that_cross_markers_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(tokenizer_file("piece_bpe_32k.model"))
    pieces.check_model(spec.SerializeToString())
    spec.pieces.add(piece="a▁b", score=0.0)
    with pytest.raises(ValueError):
        pieces.check_model(spec.SerializeToString())
