"""Templates planted in leaves, next to lines that only look alike."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkveil.llm import line_templates

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("ba", "ko", "mi", "tu", "ne", "sol")]


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in line_templates.deduplicated(docs).collect()}


@pytest.mark.parametrize("forms", [1, 2, 4, 10, 25])
def test_forms_of_one_leaf(spark, forms):
    """300 lines of one leaf, in equally frequent forms, each with a word of its own at the end."""
    rng = random.Random(forms)
    words = rng.sample(WORDS, 300)
    tails = [" ".join(rng.sample(WORDS, 4)) for _ in range(forms)]
    texts = [f"user login event {tails[i % forms]} {words[i]}" for i in range(300)]
    out = run(spark, texts)
    assert sum(r.n_dropped for r in out.values()) == 300


@pytest.mark.parametrize("seed", range(3))
def test_planted_templates_and_clean_lines(spark, seed):
    """By definition: lines of a form go if three documents have the form; others stay."""
    rng = random.Random(seed)
    texts: list[list[tuple[str, bool]]] = [[] for _ in range(60)]
    for n in range(12):
        lead = " ".join(rng.sample(WORDS, 3)) if n % 3 else "info the server"
        fixed, size = [rng.choice(WORDS) for _ in range(8)], rng.choice([2, 3, 9, 30])
        for doc in rng.sample(range(60), size):
            fields = list(fixed)
            fields[rng.choice([3, 7])] = rng.choice(WORDS)
            line = f"{lead} {' '.join(fields)}"
            texts[doc].append((line, size >= 3))
    for doc, own in enumerate(texts):
        for _ in range(5):
            own.append((" ".join(rng.sample(WORDS, rng.randint(8, 20))), False))
        own.append((f"info the server {' '.join(rng.sample(WORDS, 8))}", False))
        rng.shuffle(own)
    out = run(spark, ["\n".join(line for line, _ in own) for own in texts])
    for doc, own in enumerate(texts):
        assert out[doc].text.split("\n") == [line for line, goes in own if not goes], doc


def test_long_lines_recur_in_two_documents(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    long, short = line(50), line(49)
    varied = [long.split(), long.split()]
    varied[1][20] = "other"
    varied = [" ".join(["and", "so", *x]) for x in varied]
    texts = [f"{long}\n{short}\n{varied[0]}\n{line(60)}", f"{line(60)}\n{long}\n{varied[1]}\n{short}"]
    out = run(spark, texts)
    assert [out[i].n_dropped for i in (0, 1)] == [2, 2]
    assert all(short in out[i].text and long not in out[i].text for i in (0, 1))


def test_very_many_dropped_lines_in_a_document(spark):
    text = "\n".join(f"{WORDS[i % 360]}{WORDS[i // 360]} line of its own" for i in range(40_000))
    started = time.time()
    out = run(spark, [text, text, text, "kept line"])
    assert [out[i].n_dropped for i in range(4)] == [40_000] * 3 + [0]
    assert out[0].text == "" and out[3].text == "kept line"
    assert time.time() - started < 120


def test_masks_of_odd_texts(spark):
    """Tokens with digits are masked whole, and white space is one space, in any mix of both."""
    rng = random.Random(3)
    parts = ["a", "7", "b9c", "x", " ", "  ", "\t", "\r", "\f", "\x0b", "\n", "\u00a0", "é", "٣", "<*>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for row in df.select("text", line_templates._masked(F.col("text")).alias("lines")).collect():
        if row.text is None:
            assert row.lines is None
            continue
        masked = re.sub(r"[^ \t\n\x0b\f\r]*[0-9][^ \t\n\x0b\f\r]*", "<*>", row.text)
        wanted = [x.strip(" ") for x in re.sub(r"[ \t\r\f\x0b]+", " ", masked).split("\n")]
        assert [x.strip(" ") for x in row.lines] == wanted, row.text
