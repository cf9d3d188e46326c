"""Small corpora with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Prose with copies, near copies, shared passages and lines, nulls, blanks, repeated rows and a long text."""
    rng = random.Random(seed)
    passages = [" ".join(words(rng, rng.randint(40, 70))) for _ in range(4)]
    line = "This Line stands in Many documents of the corpus, word for word"
    texts = []
    for i in range(n):
        kind = i % 6
        own = " ".join(words(rng, rng.randint(3, 160)))
        if kind == 1 and texts:
            own = rng.choice(texts)
        elif kind == 2 and texts:
            changed = rng.choice(texts).split(" ")
            for _ in range(max(1, len(changed) // 60)):
                changed[rng.randrange(len(changed))] = "changed"
            own = " ".join(changed)
        elif kind == 3:
            own = f"{own}\n{rng.choice(passages)} {own[:30]}"
        elif kind == 4:
            own = f"{own}\n  {line if i % 12 == 4 else line.upper()}\t\n{own[:50]}"
        texts.append(own)
    texts += ["", " \n\t ", "one", "a" * 900, "ab" * 400, "same line\n" * 50, " ".join(words(rng, 4000))]
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4 and 0 if i % 3 else i % 5}", len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, None, None, None, None), (None, texts[5], "en", "src0", 9), (len(texts), None, "en", "", 0)]


def line_dedup(rows, least=40, docs=5):
    holders = collections.defaultdict(list)
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    for r, (i, lines) in enumerate(split):
        for k in {key(x) for x in lines}:
            if len(k) >= least:
                holders[k].append(i)
    gone = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def repeats(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = collections.Counter(b[p:p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} if w else ())


def near_groups(rows, n, percent):
    """(doc_id, set size, smallest doc_id of the component) by comparing all pairs."""
    sets = [shingles(t, n) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [(i, len(sets[k]), min(least[find(k)], default=None) if sets[k] else i) for k, (i, *_) in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=str)
