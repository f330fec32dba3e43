"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over
character n-grams (one to three letters, words framed by spaces) says on which side
of it a text falls. A text's language is the one whose codeword lies nearest, each
bit's logistic loss weighed by how well its classifier did on that language. The
score is the share of the nearest codeword among all; a text whose second codeword
is almost as near is flagged as ambiguous.

Every labelled row is learned from. Hashes deal the texts into groups of bounded size, in
which all languages stand; executors train a model in each group, on features of a fixed
size, and the model is the mean of all. A text counts once however often it stands there.
Whatever was dealt to one group alone is one model. Predictions read whole texts.

Results: NULL texts and texts without a letter are `und`, score 0, never ambiguous.
Where no labelled row is left to learn from, all texts are `und`; with a single
language, all texts with letters get it. Repeated rows get the same answer. Extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.shingles import chunks

UNKNOWN = "und"
#: size of the hashed features
BUCKETS = 4096
#: rows of a group, for each language; a language with less than LEAST_ROWS of its texts in a
#: group is dealt to more than one
PER_LANGUAGE, LEAST_ROWS = 800, 100
#: texts that a task remembers, so that it sends copies once
REMEMBERED = 1 << 16
STEPS, RATE, DECAY, BLOCK = 150, 4.0, 1e-4, 64
#: a text is ambiguous if the nearest codeword's share is not this much above the second's
MARGIN = 0.2
#: a text is rejected if it lies this much farther from all codewords, in loss per bit, than any
#: held-out one; from fewer of these, and of texts with fewer letters, too little is known
BEYOND, LEAST_HELD_OUT, LEAST_LETTERS = 0.05, 200, 20


def codewords(classes: int) -> np.ndarray:
    """Rows of -1 and 1: all splits of few classes, rows of a Hadamard matrix for many."""
    if classes < 2:
        return np.ones((classes, 0), dtype=np.int8)
    if classes <= 6:
        splits = range(1, 1 << (classes - 1))
        bits = [[(s >> c) & 1 for s in splits] for c in range(classes - 1)] + [[0] * len(splits)]
        return np.array(bits, dtype=np.int8) * 2 - 1
    size = 1
    rows = np.ones((1, 1), dtype=np.int8)
    while size < classes + 1:
        rows = np.block([[rows, rows], [rows, -rows]])
        size *= 2
    return rows[1 : classes + 1, 1:]


def _letters() -> np.ndarray:
    """Code points of the first plane by what they count as: 0 for all but letters."""
    plane = np.arange(1 << 16, dtype=np.uint32)
    letter = np.array([chr(c).isalpha() for c in range(1 << 16)])
    return np.where(letter, plane, 0).astype(np.uint32)


def features(texts: list[str | None], letters: np.ndarray) -> np.ndarray:
    """Hashed counts of n-grams, damped by the root and of length 1."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for part in chunks(texts, 1 << 19, 256):  # some megabytes of counts
        own = [" " + (x or "").lower() + " " for x in texts[part]]
        raw = "".join(own).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, dtype=np.uint32)
        codes = np.where(codes < 1 << 16, letters[np.minimum(codes, (1 << 16) - 1)], codes)
        rows = np.repeat(np.arange(len(own), dtype=np.int64), [len(x) for x in own])
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (rows[1:] != rows[:-1])
        codes, rows = codes[keep], rows[keep] * BUCKETS
        one = codes * np.uint32(0x9E3779B1)
        two = one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
        three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
        counts = np.zeros(len(own) * BUCKETS, dtype=np.int64)
        shift = np.uint32(32 - (BUCKETS - 1).bit_length())
        for grams, width in ((one, 0), (two, 1), (three, 2)):
            grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
            begins = rows[: len(rows) - width] if width else rows
            same = begins == rows[width:]
            counts += np.bincount((begins + grams)[same], minlength=len(counts))
        own_part = np.sqrt(counts.reshape(len(own), BUCKETS), dtype=np.float32)
        norm = np.linalg.norm(own_part, axis=1, keepdims=True)
        out[part] = own_part / np.maximum(norm, 1e-9)
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def tells(text: str | None) -> bool:
    """Whether a text has letters enough to be rejected for them."""
    letters = islice(filter(str.isalpha, text or ""), LEAST_LETTERS)
    return sum(1 for _ in letters) == LEAST_LETTERS


@dataclass(frozen=True)
class Model:
    """Languages with their codewords, a linear classifier for each bit and its weights."""

    languages: tuple[str, ...]
    words: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    trust: np.ndarray

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """For each row of features the loss-weighted distances of the languages' codewords."""
        margins = rows @ self.weights + self.offsets
        loss = np.logaddexp(0, -margins[:, None, :] * self.words[None]) * self.trust[None]
        return loss.sum(2)

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """For each row of features the languages' shares, from the loss-weighted distances."""
        if not len(self.languages):
            return np.zeros((len(rows), 0))
        if self.words.shape[1] == 0:
            return np.ones((len(rows), 1))
        distance = self.distances(rows)
        near = np.exp(distance.min(1, keepdims=True) - distance)
        return near / near.sum(1, keepdims=True)

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """For each row of features the distance of the nearest codeword, per bit."""
        return self.distances(rows).min(1) / self.words.shape[1]


def descended(rows: np.ndarray, index: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Logistic classifiers of all bits, by gradient descent on all rows: their weights and
    offsets, and for each language how many rows each bit is right on, and how many there are."""
    weights = np.zeros((BUCKETS, words.shape[1]), dtype=np.float32)
    offsets = np.zeros(words.shape[1], dtype=np.float32)
    wanted = words[index].astype(np.float32)
    known = np.bincount(index, minlength=len(words))
    even = 1.0 / known[index]  # languages weigh the same
    even = (even / even.sum()).astype(np.float32)[:, None]
    speed = np.zeros_like(weights)
    # few rows at once stay in the cache between their two products
    blocks = [slice(at, at + BLOCK) for at in range(0, len(rows), BLOCK)]
    for _ in range(STEPS):
        speed = 0.9 * speed - DECAY * weights
        shift = np.zeros_like(offsets)
        for own in blocks:
            side = wanted[own]
            pull = side * even[own] / (1 + np.exp(side * (rows[own] @ weights + offsets)))
            speed += rows[own].T @ pull
            shift += pull.sum(0)
        weights += RATE * speed
        offsets += RATE * shift
    hit = (np.sign(rows @ weights + offsets) == wanted).astype(np.float64)
    right = np.stack([hit[index == c].sum(0) for c in range(len(words))])
    return [weights, offsets, right, known]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning, by its id alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letters = _letters()
    for batch in batches:
        for part in chunks(batch["text"].tolist()):
            own = batch.iloc[part]
            rows = features(own["text"].tolist(), letters).astype(np.float16)
            yield pd.DataFrame({"lang": own["lang"], "features": [x.tobytes() for x in rows]})


def _sampled(ready: DataFrame, per_language: int) -> pd.DataFrame:
    """``lang, features`` of at most ``per_language`` different texts of each language, to look
    at; no model or limit comes from these.

    Those with the smallest hashes are taken, whatever their ids.  Languages are bounded one
    by one, and a text counts once however often it stands there: neither rows without an
    id nor copies push another text or language out.
    """
    hashed = ready.select("lang", "text", F.xxhash64("text").alias("hash"))
    place = F.shiftrightunsigned("hash", 33)  # 31 bits
    counted = hashed.groupBy("lang").agg(F.approx_count_distinct("hash", 0.03).alias("n"))
    counts = {r["lang"]: max(1, r["n"]) for r in counted.collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "features": []})
    # some more than wanted, as the number of texts is an estimate
    upto = F.create_map(
        *[
            F.lit(x)
            for lang, n in counts.items()
            for x in (lang, int(min(1.0, 1.25 * per_language / n) * (1 << 31)))
        ]
    )
    near = hashed.where(place <= F.element_at(upto, F.col("lang")))
    once = near.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    smallest = Window.partitionBy("lang").orderBy("hash")
    sample = once.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= per_language)
    made = sample.select("lang", "text").mapInPandas(
        _sample_features, "lang string, features binary"
    )
    return made.toPandas()


def _packed(row: np.ndarray) -> bytes:
    """Features as the places that are not zero, as bits, and what stands there."""
    short = row.astype(np.float16)
    return np.packbits(short != 0).tobytes() + short[short != 0].tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    rows = np.zeros((len(packed), BUCKETS), dtype=np.float32)
    for row, raw in zip(rows, packed, strict=True):
        places = np.unpackbits(np.frombuffer(raw, np.uint8, BUCKETS // 8)).astype(bool)
        row[places] = np.frombuffer(raw, np.float16, offset=BUCKETS // 8)
    return rows


def _dealer(groups: int, repeats: dict[str, int]):
    """Features of all texts with the groups they are dealt to."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch["lang"], batch["hash"], strict=True)):
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    new.append(i)
            batch = batch.iloc[new]
            for part in chunks(batch["text"].tolist()):
                own = batch.iloc[part]
                rows = features(own["text"].tolist(), letters)
                out = []
                for lang, key, row in zip(own["lang"], own["hash"], rows, strict=True):
                    packed, often = _packed(row), repeats[lang]
                    out += [
                        ((key + n * groups // often) % groups, lang, key, packed) for n in range(often)
                    ]
                yield pd.DataFrame(out, columns=["group", "lang", "hash", "features"])

    return dealt


def _trainer(languages: tuple[str, ...], words: np.ndarray, parts: int):
    """The model of a group."""
    of = {name: i for i, name in enumerate(languages)}

    def trained(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["lang", "hash"]).sort_values(["lang", "hash"])
        index = group["lang"].map(of).to_numpy(np.int64)
        found = descended(_unpacked(group["features"].tolist()), index, words)
        number = int(group["group"].iloc[0]) if len(group) else 0
        model = np.concatenate([x.astype(np.float64).ravel() for x in found])
        return pd.DataFrame({"part": [number % parts], "group": [number], "model": [model.tobytes()]})

    return trained


def _added(models: pd.DataFrame) -> pd.DataFrame:
    """The sum of models, in the order of their groups."""
    models = models.sort_values("group")
    total = sum(np.frombuffer(x, np.float64) for x in models["model"])
    return models.iloc[:1].assign(model=[total.tobytes()])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages of ``docs(doc_id, text, lang)``, from all rows but those held out.

    The rows of a language too rare for all groups are dealt to several, so that every group
    learns all languages.  Sums of models are added up by about as many tasks as each adds
    models: the driver gets no more than these.
    """
    ready = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    ready = ready.select("lang", "text", F.xxhash64("text").alias("hash"))
    counted = ready.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    languages = tuple(sorted(counts))
    words = codewords(len(languages))
    bits = words.shape[1]
    shapes = [(BUCKETS, bits), (bits,), (len(languages), bits), (len(languages),)]
    if not bits:
        return Model(languages, words, *(np.zeros(x, np.float32) for x in shapes[:2]), np.ones(words.shape))
    groups = max(1, math.ceil(sum(counts.values()) / (per_language * len(languages))))
    repeats = {x: max(1, math.ceil(min(n, LEAST_ROWS) * groups / n)) for x, n in counts.items()}
    parts = math.isqrt(groups - 1) + 1
    dealt = ready.mapInPandas(
        _dealer(groups, repeats), "group long, lang string, hash long, features binary"
    )
    models = (
        # each group is work for a task of its own, however small its rows are
        dealt.repartition(min(groups, 2000), "group")
        .groupBy("group")
        .applyInPandas(_trainer(languages, words, parts), "part long, group long, model binary")
        .groupBy("part")
        .applyInPandas(_added, "part long, group long, model binary")
    )
    total = np.frombuffer(_added(models.toPandas())["model"].iloc[0], np.float64)
    ends = np.cumsum([math.prod(x) for x in shapes])[:-1]
    weights, offsets, right, known = (
        x.reshape(shape) for x, shape in zip(np.split(total, ends), shapes, strict=True)
    )
    trust = right / np.maximum(known, 1)[:, None] + 1e-6
    trust = trust / trust.sum(1, keepdims=True) * bits
    mean = [(x / groups).astype(np.float32) for x in (weights, offsets)]
    return Model(languages, words, *mean, trust)


def _measurer(model: Model):
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for batch in batches:
            texts = batch["text"].tolist()
            for part in chunks(texts):
                far = model.nearest(features(texts[part], letters))
                yield batch.iloc[part].drop(columns=["text"]).assign(distance=far)

    return measured


def farthest(docs: DataFrame, model: Model) -> float:
    """The distance up to which a text is like the held-out rows of the model's languages."""
    if len(model.languages) < 2:
        return math.inf
    ready = docs.where(F.col("text").isNotNull() & F.col("lang").isin(*model.languages))
    # letters are counted no further than needed
    told = F.col("text").rlike(r"(?:\p{L}[^\p{L}]*+){%d}" % LEAST_LETTERS)
    ready = ready.where(held_out(F.col("doc_id")) & told)
    ready = ready.select("lang", F.xxhash64("text").alias("hash"), "text")
    measured = ready.mapInPandas(_measurer(model), "lang string, hash long, distance double")
    once = measured.groupBy("lang", "hash").agg(F.max("distance").alias("distance"))
    found = once.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("distance")).first()
    if found["n"] < LEAST_HELD_OUT:
        return math.inf
    return found["distance"] + BEYOND


def _predictor(model: Model):
    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for batch in batches:
            texts = batch["text"].tolist()
            for part in chunks(texts):
                own = texts[part]
                shares = model.shares(features(own, letters))
                known = np.array([has_letter(x) for x in own], dtype=bool) & bool(model.languages)
                lang = np.full(len(own), UNKNOWN, dtype=object)
                score, unsure = np.zeros(len(own)), np.zeros(len(own), dtype=bool)
                if model.languages:
                    top = shares.argmax(1)
                    ordered = np.sort(shares, axis=1)
                    second = ordered[:, -2] if shares.shape[1] > 1 else np.zeros(len(own))
                    lang[known] = np.array(model.languages, dtype=object)[top[known]]
                    score[known] = ordered[known, -1]
                    unsure[known] = (ordered[:, -1] - second)[known] < MARGIN
                rest = batch.iloc[part].drop(columns=["text"])
                yield rest.assign(lang_pred=lang, score=score, ambiguous=unsure)

    return predicted


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of all documents, from their text alone."""
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInPandas(
        _predictor(model),
        "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean",
    )


def recognised(docs: DataFrame, model: Model, limit: float = math.inf) -> DataFrame:
    """The documents with letters that lie within the limit, with all their columns."""
    import pyarrow as pa

    def near(texts: list[str | None], letters: np.ndarray) -> list[bool]:
        out = [has_letter(x) for x in texts]
        if math.isfinite(limit):
            for part in chunks(texts):
                far = model.nearest(features(texts[part], letters)) > limit
                for i, beyond in zip(range(part.start, part.stop), far, strict=True):
                    out[i] = out[i] and not (beyond and tells(texts[i]))
        return out

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            known = near(batch.column("text").to_pylist(), letters)
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
