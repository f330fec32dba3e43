"""Tokens next to the library's own, whatever the pieces."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkveil.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Codec(file.read())


def in_pieces(codec, text, size):
    return codec.joined(codec.encode(codec.pieces(text, size))).tolist()


ALPHABETS = ["ab", "a", " ", " a", "abc ", "'sredvltm ", "a'1! \n", "\t\n ab", "éàü a", "日本語 。", "aA1-_/+=", "\U0001f600é a'",
             "the quick'll don't 12 34", "　 \xa0a1", "é̂ ", "ſs'T "]


def test_any_cut_gives_the_tokens_of_the_whole(codec, library):
    rng = random.Random(5)
    for turn in range(3000):
        alphabet = ALPHABETS[turn % len(ALPHABETS)]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
        if turn % 7 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + END * rng.randint(1, 3) + text[at:]
        expected = library.encode(text, add_special_tokens=False).ids
        assert in_pieces(codec, text, rng.randint(1, 60)) == expected, repr(text)
        assert codec.decode(np.array(expected, dtype=np.uint32)) == text


@pytest.mark.parametrize("alphabet", ["a", "ab", "etaoinshrdlu", "0", "01", "-", "'", "'s", " ", "\n ", "日本", "é", "=-_"])
def test_long_runs(codec, library, alphabet, monkeypatch):
    """One run over all pieces: the tokens themselves are the window."""
    monkeypatch.setattr(bpe, "RUN", 50)
    rng = random.Random(alphabet)
    for size in (97, 1000, 4001):
        text = "x " + "".join(rng.choice(alphabet) for _ in range(20_000)) + " y"
        assert in_pieces(codec, text, size) == library.encode(text).ids


def test_windows_stay_small(codec, monkeypatch):
    """A million letters without a split: joins merge few tokens, not the halves anew."""
    rng = random.Random(3)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    parts, merged = codec.encode(codec.pieces(text, 1 << 15)), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda raw: merged.append(len(raw)) or merge(raw))
    ids = codec.joined(parts)
    assert ids.tolist() == codec.tokenizer.encode(text).ids
    assert len(merged) >= len(parts) - 1 and max(merged) < 5_000


def test_both_libraries_know_the_common_characters(codec, library):
    assert codec.fast is not None
    common = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not bpe._RARE.search(chr(c))]
    assert len(common) > 400
    text = "".join(f"a{c}1{c}.{c} {c}{c}'{c}b \n{c}" for c in common)
    assert codec.encode([text])[0].tolist() == library.encode(text).ids


def brute(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    spelt = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(spelt.encode()).hexdigest()


def test_digests(spark, library):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    texts = [None, "", " ", "one", "one", f"a {END} b{END}", long, long, "z" * 70_000, "é日\U0001f600\x00" * 20_000,
             "-" * 16_380 + END + "tail", " \n" * 30_000]
    rows = [(n if n % 5 else None, text, "clash") for n, text in enumerate(texts)] + [(3, "one", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    docs = docs.selectExpr("*", "'x' AS row", "1 AS part", "2 AS n_tokens")
    found = bpe.digests(docs, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ours = sorted(map(repr, (tuple(r) for r in found.collect())))
    assert ours == sorted(repr((r[0], *brute(r[1], library))) for r in rows)
    assert bpe.digests(docs.limit(0), PATH).collect() == []
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert bpe.digests(named, PATH).count() == len(rows)


def test_decoded_is_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spelt = bpe.decoded(bpe.encoded(docs, PATH, piece=500), PATH)
    assert {(r.doc_id, r.text) for r in spelt.collect()} == {
        (r.doc_id, r.text or "") for r in docs.collect()
    }
