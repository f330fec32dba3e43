"""Toxicity of texts behind a noisy channel.

Words written in leetspeak, letter by letter or with repeated letters are restored
first: each character of such a span is a set of letters it may stand for, nothing if it
only separates or repeats, or itself, at a cost; Viterbi decoding takes the path that the
channel and a trigram model of characters find likeliest. Every word with a lookalike, a
separator or a letter three times anywhere in it is decoded, and every run of three or
more single characters; where the words of a span come out as they stand there, it is
left as it is. The model's counts come from all documents. The restored text is then
scored.

The scorer learns from labelled rows. Hashed runs of six characters, words framed by
spaces, get the log odds of standing in toxic documents; a document's statistics
are taken without its own vote, and a logistic regression turns them into a score. A
bounded sample of labelled rows is used, ``sample`` at most, one of each text.

Results: NULL and empty texts get the score of a text without any sign. Without
labelled rows of both kinds every score is the share of toxic rows, 0 if there are
none. NULL labels are not used; a document labelled twice counts as toxic if one row
says so. Repeated rows get the same score. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import staged
from inkveil.llm.language import held_out
from inkveil.llm.shingles import chunks

SAMPLE = 12_000
#: characters of the runs that are signs
RUN = 6
TOXIC_FROM = 0.7
#: sizes of the hashed tables: runs of characters, trigrams and their first two
GRAMS, TRIGRAMS, BIGRAMS = 1 << 20, 1 << 20, 1 << 16
#: a run of characters is a sign from this many toxic documents and these log odds on
LEAST_DOCUMENTS, LEAST_ODDS = 3, 2.0

# Letters that other characters are commonly written for
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "*": "aeiou",
}
SEPARATORS = ".-_*·/,~:;"
#: lookalikes that often end or part words as they are
PUNCTUATION = "!|+*"
#: log costs of the channel
COST = {"lookalike": -1.0, "repeat": -0.7, "pair": -4.0, "separator": -0.5, "boundary": -2.0,
        "space": -6.0, "itself": -2.0}

_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_TOKEN = re.compile(r"\S+")
#: what goes in front of a word and behind it; an exclamation mark at the end is one
_TRIM = re.compile(r"^[^\w@$!|+*€]+|(?:[^\w@$|+*€]|[|+*]{2,})+$")
#: a letter next to a lookalike, in front of a separator inside a word, or three times
_SUSPECT = re.compile(
    r"[^\W\d_][0-9@$!|+*€]|[0-9@$!|+*€][^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_*·/,~:;]+[\w@$!|+€]"
)
_LETTERS = re.compile(r"[^\W\d_]+")
#: a longer word is decoded in parts of this size
PART = 256
_U32 = np.uint32
_K = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
_MASK = 0xFFFFFFFF


def _finish(x, size: int):
    """Top bits of a hash, for numpy arrays and for Python integers."""
    shift = 32 - (size - 1).bit_length()
    if isinstance(x, np.ndarray):
        return ((x ^ (x >> _U32(15))) * _U32(0x2C1B3C6D)) >> _U32(shift)
    return ((x ^ (x >> 15)) * 0x2C1B3C6D & _MASK) >> shift


class _Reader:
    """Texts as arrays of characters: letters in lower case, 0 for all others."""

    def __init__(self) -> None:
        plane = np.arange(1 << 16, dtype=_U32)
        self.letters = np.where([chr(c).isalpha() for c in range(1 << 16)], plane, 0).astype(_U32)
        kinds = np.zeros(1 << 16, dtype=np.uint8)
        kinds[self.letters > 0] = 1
        for c in LOOKALIKES:
            kinds[ord(c)] |= 2
        for c in SEPARATORS:
            kinds[ord(c)] |= 4
        kinds[[c for c in range(1 << 16) if chr(c).isspace()]] = 8
        self.kinds = kinds

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts).encode("utf-32-le", "surrogatepass")
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        return np.frombuffer(joined, dtype=_U32), rows

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters, and single zeros between words."""
        codes, rows = self.raw(texts)
        codes = np.where(codes < 1 << 16, self.letters[np.minimum(codes, 0xFFFF)], codes)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (rows[1:] != rows[:-1])
        return codes[keep], rows[keep]

    def suspects(self, texts: list[str]) -> np.ndarray:
        """Whether a text may hold a span to restore; a few texts too many."""
        codes, rows = self.raw(texts)
        out = np.zeros(len(texts), dtype=bool)
        if len(codes) < 5:
            codes = np.concatenate([codes, np.full(5, 32, _U32)])
            rows = np.concatenate([rows, np.full(5, -1)])
        kind = self.kinds[np.minimum(codes, 0xFFFF)]
        letter, alike, part, space = ((kind & k) > 0 for k in (1, 2, 4, 8))
        edge = np.ones(len(codes), dtype=bool)
        edge[1:] = space[:-1] | (rows[1:] != rows[:-1])
        last = np.ones(len(codes), dtype=bool)
        last[:-1] = edge[1:] | space[1:]
        flag = np.zeros(len(codes), dtype=bool)
        inside = ~edge[1:]  # behind a character of the same word
        flag[1:] |= alike[1:] & letter[:-1] & inside | letter[1:] & alike[:-1] & inside
        flag[:-2] |= letter[:-2] & (codes[:-2] == codes[1:-1]) & (codes[:-2] == codes[2:])
        flag[:-2] |= letter[:-2] & part[1:-1] & ~edge[1:-1] & ~edge[2:] & ~space[2:]
        starts = np.flatnonzero(edge & ~space)
        single = last[starts]
        run = single[:-2] & single[1:-1] & single[2:] & (rows[starts[:-2]] == rows[starts[2:]])
        flag[starts[:-2][run]] = True
        out[np.unique(rows[flag & (rows >= 0)])] = True
        return out


def _trigrams(a, b, c):
    if isinstance(a, np.ndarray):
        return _finish((a * _U32(_K[0])) ^ (b * _U32(_K[1])) ^ (c * _U32(_K[2])), TRIGRAMS)
    return _finish((a * _K[0] & _MASK) ^ (b * _K[1] & _MASK) ^ (c * _K[2] & _MASK), TRIGRAMS)


def _bigrams(a, b):
    if isinstance(a, np.ndarray):
        return _finish((a * _U32(_K[3])) ^ (b * _U32(_K[4])), BIGRAMS)
    return _finish((a * _K[3] & _MASK) ^ (b * _K[4] & _MASK), BIGRAMS)


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of hashed trigrams and bigrams of all texts of a task."""
    reader = _Reader()
    counts = np.zeros(TRIGRAMS + BIGRAMS, dtype=np.int64)
    for batch in batches:
        texts = batch["text"].tolist()
        for part in chunks(texts, 1 << 19):
            codes, _ = reader.words([" " + (x or "").lower() + " " for x in texts[part]])
            if len(codes) < 3:
                continue
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            counts[:TRIGRAMS] += np.bincount(_trigrams(a, b, c), minlength=TRIGRAMS)
            counts[TRIGRAMS:] += np.bincount(_bigrams(a, b), minlength=BIGRAMS)
    found = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": found, "n": counts[found]})


@dataclass(frozen=True)
class CharacterModel:
    trigrams: np.ndarray
    bigrams: np.ndarray

    def log(self, a: int, b: int, c: int) -> float:
        n = float(self.trigrams[_trigrams(a, b, c)])
        return math.log((n + 0.1) / (float(self.bigrams[_bigrams(a, b)]) + 6.4))


def character_model(docs: DataFrame) -> CharacterModel:
    """A trigram model of the characters of all documents, in two tables of fixed size."""
    counted = docs.select("text").mapInPandas(_counter, "slot long, n long")
    sums = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(TRIGRAMS + BIGRAMS, dtype=np.float32)
    table[sums["slot"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.float32)
    return CharacterModel(table[:TRIGRAMS], table[TRIGRAMS:])


def _options(span: str, i: int, spaced: bool) -> list[tuple[str | None, float]]:
    """What the character at i may stand for; None is nothing."""
    c = span[i]
    found: list[tuple[str | None, float]] = []
    if c.isalpha():
        found.append((c, 0.0))
        if i and span[i - 1] == c:  # a letter written twice is common, three times is not
            pair = (i < 2 or span[i - 2] != c) and span[i + 1 : i + 2] != c
            found.append((None, COST["pair" if pair else "repeat"]))
    found += [(x, COST["lookalike"]) for x in LOOKALIKES.get(c, "")]
    if i and c in LOOKALIKES and span[i - 1] == c:
        found.append((None, COST["repeat"]))
    if c in SEPARATORS or spaced and c.isspace():
        found.append((None, COST["separator"]))
        found.append((" ", COST["space" if c.isspace() else "boundary"]))
    elif c in LOOKALIKES:
        found.append((" ", 0.0 if c in PUNCTUATION else COST["itself"]))
    return found or [(" ", 0.0)]


def restored_span(span: str, model: CharacterModel) -> str:
    """The likeliest reading of a span, by Viterbi over the last two letters."""
    spaced = any(c.isspace() for c in span)
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for i in range(len(span) + 1):
        options = _options(span, i, spaced) if i < len(span) else [(" ", 0.0)]
        step: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, out) in paths.items():
            for letter, cost in options:
                if letter is None or letter == " " and b == 0:
                    key, total, more = (a, b), score + cost, out
                else:
                    c = 0 if letter == " " else ord(letter)
                    key, total = (b, c), score + cost + model.log(a, b, c)
                    more = (letter, out)
                if key not in step or total > step[key][0]:
                    step[key] = (total, more)
        paths = step
    out, letters = max(paths.values(), key=lambda x: x[0])[1], []
    while out:
        letter, out = out
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def restorer(model: CharacterModel):
    """A function that restores whole texts, in lower case."""
    known = lru_cache(maxsize=1 << 16)(lambda span: restored_span(span, model))

    def read(span: str) -> str:
        """A reading, or the span itself if its words stay as they stand there."""
        parts = (known(span[i : i + PART]) for i in range(0, len(span), PART))
        reading = "".join(parts)
        return span if reading.split() == _LETTERS.findall(span) else reading

    def token(text: str) -> str:
        word = _TRIM.sub("", text)
        if not _SUSPECT.search(word):
            return text
        reading = read(word)
        return text if reading == word else reading

    def restored(text: str) -> str:
        """Only words around something suspicious are looked at."""
        text = _SPACED.sub(lambda m: read(m.group()), text.lower())
        out, last = [], 0
        for match in _SUSPECT.finditer(text):
            begin = match.start()
            if begin < last:
                continue
            while begin > last and not text[begin - 1].isspace():
                begin -= 1
            end = _TOKEN.match(text, begin).end()
            out += (text[last:begin], token(text[begin:end]))
            last = end
        return "".join([*out, text[last:]])

    return restored


class _Grams:
    """Hashed runs of characters of restored texts."""

    def __init__(self, model: CharacterModel):
        self.reader, self.restored = _Reader(), restorer(model)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All runs, and the text of each."""
        texts = [(x or "").lower() for x in texts]
        suspect = self.reader.suspects(texts)
        framed = [f" {self.restored(x) if s else x} " for x, s in zip(texts, suspect, strict=True)]
        codes, rows = self.reader.words(framed)
        if len(codes) < RUN:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = len(codes) - RUN + 1
        hashed = codes[:n] * _U32(_K[0])
        for i in range(1, RUN):
            hashed = (hashed ^ codes[i : n + i]) * _U32(_K[i % len(_K)])
        same = rows[:n] == rows[RUN - 1 :]
        return _finish(hashed, GRAMS)[same].astype(np.int64), rows[:n][same]


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic, n_clean) -> np.ndarray:
    """Log odds of runs that are signs, 0 for all others."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((toxic >= LEAST_DOCUMENTS) & (odds >= LEAST_ODDS), odds, 0.0)


def _statistics(odds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per text: signs and their odds, as counts, per root of length, and the strongest."""
    length = np.bincount(rows, minlength=n)
    hits = np.bincount(rows, weights=odds > 0, minlength=n)
    total = np.bincount(rows, weights=odds, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, rows[odds > 0], odds[odds > 0])
    root = np.sqrt(length + 100.0)
    return np.stack([np.log1p(hits), np.log1p(total), total / root, top], axis=1)


def _document_counts(model: CharacterModel):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = _Grams(model)
        counts, documents = np.zeros((2, GRAMS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            texts, labels = batch["text"].tolist(), batch["toxic"].to_numpy(dtype=np.int64)
            for part in chunks(texts, 1 << 19):
                found, rows = grams.of(texts[part])
                pairs = np.unique(rows * GRAMS + found)
                for y in (0, 1):
                    own = labels[part][pairs // GRAMS] == y
                    counts[y] += np.bincount(pairs[own] % GRAMS, minlength=GRAMS)
                documents += np.bincount(labels[part], minlength=2)
        slots = np.flatnonzero(counts.any(0))
        yield pd.DataFrame(
            {
                "slot": np.append(slots, -1),  # -1: documents
                "clean": np.append(counts[0, slots], documents[0]),
                "toxic": np.append(counts[1, slots], documents[1]),
            }
        )

    return counted


def _own_statistics(model: CharacterModel, clean: np.ndarray, toxic: np.ndarray, documents):
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = _Grams(model)
        for batch in batches:
            texts, labels = batch["text"].tolist(), batch["toxic"].to_numpy(dtype=np.int64)
            for part in chunks(texts, 1 << 19):
                found, rows = grams.of(texts[part])
                y = labels[part]
                odds = _odds(
                    toxic[found] - y[rows],
                    clean[found] - (1 - y[rows]),
                    documents[1] - y[rows],
                    documents[0] - (1 - y[rows]),
                )
                own = _statistics(odds, rows, len(y))
                frame = pd.DataFrame(own, columns=[f"x{i}" for i in range(own.shape[1])])
                yield frame.assign(toxic=y)

    return measured


@dataclass(frozen=True)
class Model:
    characters: CharacterModel
    odds: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        x = (statistics - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly held to small weights."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weights = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], 0.1)
    hold[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        slope = x.T @ (p - y) + hold * weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(curve, slope)
        weights -= move
        if np.abs(move).max() < 1e-6:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A scorer from all documents' characters and from labelled rows that are not held out."""
    characters = character_model(docs)
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    known = staged(known, "labels")
    share = min(1.0, sample / max(1, known.count()))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    # at most `sample` rows, by the limit
    picked = known.where(order <= int(share * (1 << 20))).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(
        F.max("toxic").alias("toxic"), F.any_value("text").alias("text")
    )
    rows = staged(rows.select("text", "toxic"), "rows").repartition(16)
    counts = rows.mapInPandas(_document_counts(characters), "slot long, clean long, toxic long")
    sums = counts.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = sums.toPandas()
    clean, toxic = np.zeros(GRAMS + 1, np.int32), np.zeros(GRAMS + 1, np.int32)
    clean[found["slot"].to_numpy(dtype=np.int64)] = found["clean"]
    toxic[found["slot"].to_numpy(dtype=np.int64)] = found["toxic"]
    documents = (int(clean[-1]), int(toxic[-1]))
    clean, toxic = clean[:-1], toxic[:-1]
    width = 4
    if not documents[0] or not documents[1]:
        base = 40.0 if documents[1] else -40.0
        weights = np.array([base] + [0.0] * width)
        return Model(characters, np.zeros(GRAMS), np.zeros(width), np.ones(width), weights)
    schema = ", ".join([f"x{i} double" for i in range(width)] + ["toxic long"])
    measured = rows.mapInPandas(_own_statistics(characters, clean, toxic, documents), schema)
    table = measured.toPandas()
    x, y = table[[f"x{i}" for i in range(width)]].to_numpy(), table["toxic"].to_numpy(float)
    center, scale = x.mean(0), x.std(0) + 1e-6
    weights = _regression((x - center) / scale, y)
    odds = _odds(toxic, clean, documents[1], documents[0]).astype(np.float32)
    return Model(characters, odds, center, scale, weights)


def _scorer(model: Model):
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = _Grams(model.characters)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in chunks(texts, 1 << 19):
                found, rows = grams.of(texts[part])
                odds = model.odds[found].astype(np.float64)
                scores = model.scores(_statistics(odds, rows, len(texts[part])))
                rest = batch.iloc[part].drop(columns=["text"])
                yield rest.assign(score=scores, predicted=(scores >= TOXIC_FROM).astype(np.int32))

    return scored


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents, from their text alone."""
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInPandas(
        _scorer(model), "doc_id long, held_out boolean, score double, predicted int"
    )
