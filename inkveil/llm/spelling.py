"""Spelling variants: words one code point apart, grouped under their frequent form.

Words are runs of Latin letters of whole texts, in lower case (A to Z only), of six code
points or more that occur five times or more over all documents.

Near words are found by pivotal grams.  The bigrams of a word are ranked by the number of
their occurrences over all words, rare ones first; its prefix holds the three rarest (and
those that rank like the third), of which two that don't overlap are its pivots, chosen by
dynamic programming so that their lists are short.  One edit leaves at least one pivot
whole.  So of two near words, the one whose prefix ends earlier in the ranking has a pivot
in the other's prefix: its first pivot, at the same place from the beginning, if the edit
lies behind that one, else its second pivot, at the same place from the end.  The half of
the word on that side, pivot included, is then the same in both.  Pivots of all words are
joined with prefixes of all words on that half and the length.  Of the pairs that meet,
those with more than two letters of different parity are passed over, and the others
verified.

Only words travel, never texts.  A word of more than ``LONG`` code points is named by its
digest until its pairs are verified, so that long words cost rows of fixed size.

Missing and empty texts hold no words.  A missing doc_id is written as nothing in front of
the colon.  Repeated rows count like all others; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import staged

#: letters: the bigrams of words are of 90 * 90 kinds at most
RUN = "A-Za-zÀ-ÿ"
MOST_GRAMS = 90 * 90
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: a form is so many times as frequent as its variant
RATIO = 5
#: every so many-th run, by its hash, loses a letter
SLIP = 199
EDITS, GRAM = 1, 2
PREFIX = GRAM * EDITS + 1
LONG = 64
#: a word's name is what it travels by
NAME = f"CASE WHEN length(word) <= {LONG} THEN word ELSE '#' || sha2(word, 256) END"
#: halves of words are compared by hash: a polynomial in BASE, modulo a prime of 61 bits
BASE, PRIME = 0x1F3D5B79A6C8E2F, (1 << 61) - 1


def _lower(run: str) -> str:
    """Lower case of A to Z only; ``lower`` would change other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = f"octet_length({run}) = length({run})"
    return f"CASE WHEN {ascii_only} THEN lower({run}) ELSE translate({run}, '{upper}', '{upper.lower()}') END"


def words(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words: one pass over the texts, counts combined before the shuffle."""
    # shorter runs can't become words, and a maximal run of six or more is found whole
    runs = F.regexp_extract_all("text", F.lit(f"[{RUN}]{{{LEAST_LENGTH},}}"), F.lit(0))
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    lowered = docs.select(ident.alias("_id"), F.explode(runs).alias("_run")).withColumn(
        "_run", F.expr(_lower("_run"))
    )
    hashed = lowered.withColumn("_hash", F.crc32(F.concat("_id", "_run").cast("binary")))
    word = f"""CASE WHEN _hash % {SLIP} = 0 THEN
        substring(_run, 1, cast(_hash % length(_run) AS int)) ||
        substring(_run, cast(_hash % length(_run) AS int) + 2) ELSE _run END"""
    made = hashed.select(F.expr(word).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def pivots(prefix: list[tuple[int, int]]) -> list[int]:
    """Places of the ``EDITS + 1`` grams of a prefix that don't overlap and have least weight.

    ``prefix`` has places and weights, by place.  The best choice of k grams among the
    first i either leaves out the i-th or takes it after the best choice of k - 1 among
    those that end before it begins.
    """
    nothing = (float("inf"), ())
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0.0, ())] * (len(prefix) + 1)]
    for _ in range(EDITS + 1):
        row, free = [nothing], 0
        for i, (place, weight) in enumerate(prefix):
            while prefix[free][0] + GRAM <= place:
                free += 1
            cost, chosen = best[-1][free]
            row.append(min(row[-1], (cost + weight, (*chosen, place))))
        best.append(row)
    return list(best[-1][-1][1])


#: a row of the index
INDEX = {"pivot": "boolean", "half": "long", "size": "int", "name": "string", "n": "long",
         "parity": "long"}


def halves(word: str) -> tuple[list[int], list[int]]:
    """Hashes of all beginnings and of all ends, even and odd ones."""
    heads, tails = [0], [0]
    for c in word:
        heads.append((heads[-1] * BASE + ord(c)) % PRIME)
    for c in reversed(word):
        tails.append((tails[-1] * BASE + ord(c)) % PRIME)
    return [2 * h for h in heads], [2 * t + 1 for t in reversed(tails)]


def grams(vocabulary: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Rows of the index and rows that look into it, for every word.

    ``half`` is the word up to the end of a gram, or from its beginning on.
    """
    rank = {gram: n for n, gram in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list[tuple] = []
            for word, name, n in zip(batch["word"], batch["name"], batch["n"]):
                ranks = [rank[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
                last = sorted(ranks)[PREFIX - 1]
                prefix = [(i, counts[word[i : i + GRAM]]) for i, r in enumerate(ranks) if r <= last]
                heads, tails = halves(word)
                parity = 0
                for c in word:
                    parity ^= 1 << ord(c) % 63
                for place, _ in prefix:
                    for half in (heads[place + GRAM], tails[place]):
                        made.append((False, half, len(word), name, n, parity))
                first, second = pivots(prefix)
                for half in (heads[first + GRAM], tails[second]):
                    for size in range(len(word) - EDITS, len(word) + EDITS + 1):
                        made.append((True, half, size, name, n, parity))
                if len(made) > 1 << 16:
                    yield pd.DataFrame(made, columns=list(INDEX))
                    made = []
            if made:
                yield pd.DataFrame(made, columns=list(INDEX))

    return vocabulary.mapInPandas(rows, ", ".join(f"{k} {v}" for k, v in INDEX.items()))


def _near(first: str | Column, second: str | Column) -> Column:
    return F.levenshtein(first, second, EDITS) == EDITS


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``name, peer, peer_n``: both directions of every pair of near words, once.

    ``vocabulary`` has ``word, name, n``.
    """
    spelt = F.expr(f"explode(transform(sequence(1, length(word) - {GRAM - 1}), _i -> substring(word, _i, {GRAM})))")
    counted = vocabulary.select(spelt.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # as many as there are pairs of letters, whatever the number of words
    counts = {r["gram"]: r["n"] for r in counted.collect()}
    assert len(counts) <= MOST_GRAMS
    index = staged(grams(vocabulary, counts), "grams")
    listed = index.where(~F.col("pivot")).select(
        "half", "size", F.col("name").alias("peer"), F.col("n").alias("peer_n"), "parity"
    )
    # words of LONG code points and one more may be near each other
    by_digest = F.startswith("name", F.lit("#")) | F.startswith("peer", F.lit("#"))
    same = [F.col(f"p.{key}") == F.col(f"l.{key}") for key in ("half", "size")]
    # an edit changes one letter's parity, or those of two
    alike = F.bit_count(F.col("p.parity").bitwiseXOR(F.col("l.parity"))) <= 2 * EDITS
    met = (
        index.where("pivot")
        .alias("p")
        .join(
            listed.alias("l"),
            [*same, alike, F.col("name") != F.col("peer"), by_digest | _near("name", "peer")],
        )
        .select("name", F.col("p.n").alias("n"), "peer", "peer_n", by_digest.alias("_open"))
    )
    met = staged(met, "met")
    sure = met.where("NOT _open").drop("_open")
    full = vocabulary.where(F.length("word") >= LONG - EDITS).select("name", "word")
    other = full.toDF("peer", "peer_word")
    long = met.where("_open").drop("_open").distinct().join(full, "name").join(other, "peer")
    verified = long.where(_near("word", "peer_word")).select(*sure.columns)
    pairs = sure.unionByName(verified)
    back = pairs.select(F.col("peer").alias("name"), F.col("name").alias("peer"), F.col("n").alias("peer_n"))
    return pairs.select("name", "peer", "peer_n").unionByName(back).distinct()


def _spelt(rows: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Names back to words: only those of long words have to be looked up."""
    full = vocabulary.where(F.length("word") > LONG).select(
        F.col("name").alias("_name"), F.col("word").alias("_word")
    )
    met = rows.join(full, F.col(column) == F.col("_name"), "left")
    return met.withColumn(column, F.coalesce("_word", column)).drop("_name", "_word")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words.

    ``form`` is the most frequent near word (ties: the first in code-point order) if it is
    at least ``RATIO`` times as frequent, else null; ``root`` is where the forms lead.
    """
    counted = staged(words(docs), "words").withColumn("name", F.expr(NAME))
    near = near_words(counted)
    # names begin like their words only for short ones: ties of long ones need the words
    spelt = staged(_spelt(near.withColumn("peer_word", F.col("peer")), counted, "peer_word"), "near")
    best = F.min_by(
        F.struct("peer", "peer_n"), F.struct((-F.col("peer_n")).alias("n"), F.col("peer_word"))
    )
    chosen = spelt.groupBy("name").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    frequent = F.col("best.peer_n") >= RATIO * F.col("n")
    grouped = counted.join(chosen, "name", "left").select(
        "word",
        "name",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.peer")).alias("form"),
        F.when(frequent, F.col("best.peer_n")).alias("form_n"),
    )
    grouped = staged(grouped, "forms")
    roots = rooted(grouped)
    made = grouped.join(roots, "name")
    made = _spelt(_spelt(made, counted, "form"), counted, "root")
    return made.select("word", "form", "root", "n", "n_near", "form_n")


def rooted(forms: DataFrame) -> DataFrame:
    """``name, root``: each round every word takes the root of its root, until none moves.

    A form is ``RATIO`` times as frequent, so chains are as long as a logarithm of the
    counts, and rounds the logarithm of that.
    """
    roots = forms.select("name", F.coalesce("form", "name").alias("root"))
    while True:
        up = roots.select(F.col("name").alias("_at"), F.col("root").alias("_up"))
        step = roots.join(up, F.col("root") == F.col("_at"))
        step = staged(step.select("name", "root", "_up"), "roots")
        roots = step.select("name", F.col("_up").alias("root"))
        if step.where("root <> _up").isEmpty():
            return roots
