"""Spelling variants next to a comparison of all words with all."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from inkveil.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(
        long[:i] + long[i + 1 :] == short for i in range(len(long))
    )


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    peers = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in peers.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    result = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, words[w], len(peers[w]), form[w] and words[form[w]]))
    return result


def corpus(seed, alphabet, sizes, n_words=150):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(n_words // 5)]
    words = []
    for _ in range(n_words):
        word = rng.choice(stems + words)
        at, kind = rng.randrange(len(word)), rng.randrange(3)
        put = "" if kind == 0 else rng.choice(alphabet)
        words.append(word[:at] + put + word[at + (kind < 2) :])
    words = [w for w in words if w] + stems
    rows = []
    for i in range(60):
        picked = [words[int(len(words) * rng.random() ** 2.5)] for _ in range(200)]
        picked = [w.upper() if rng.random() < 0.1 else w for w in picked]
        rows.append((i if i % 9 else None, rng.choice([" ", ", ", "\n", "-"]).join(picked)))
    return [*rows, *rows[:3], (61, None), (62, ""), (63, "12 \t")]


CASES = [(1, "abc", [6, 7, 8]), (2, "abcdefghijklmnopqrstuvwxyz", [5, 6, 9]), (3, "aé÷ß", [6, 7]), (4, "ab", [6, 12, 63, 64, 65, 66]),
         (5, "a", [6, 7, 8, 64, 65, 66, 67, 80])]


@pytest.mark.parametrize("seed,alphabet,sizes", CASES)
def test_all_pairs(spark, seed, alphabet, sizes):
    rows = corpus(seed, alphabet, sizes)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "'x' AS word", "1 AS n", "'y' AS name", "2 AS gram", "3 AS form")
    found = spelling.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    expected = brute(rows)
    assert len(got) == len(set(got)) == len(expected)
    assert set(got) == expected
    assert any(r[1] for r in got)


def test_pivots_have_least_weight():
    rng = random.Random(7)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        prefix = [(p, rng.randint(1, 9)) for p in places]
        chosen = spelling.pivots(prefix)
        weight = dict(prefix)
        assert chosen[1] - chosen[0] >= 2
        assert sum(weight[p] for p in chosen) == min(
            weight[a] + weight[b] for a in places for b in places if b - a >= 2
        )


def test_very_long_words(spark):
    long = "z" * 50_000
    text = " ".join([long] * 30 + [long[:-1]] * 5 + [long[:-1] + "y"] * 6)
    rows = [(1, text), (2, "z" * 49_998 + " sixsix " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spelling.variants(docs).collect()}
    assert got == brute(rows) and len(got) >= 3


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None)], empty.schema)).collect() == []
