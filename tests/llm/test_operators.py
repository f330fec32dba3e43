"""Operators for training data: awkward rows, brute force and round trips."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from inkveil.llm import (
    chat,
    decontamination,
    html_text,
    jaccard_join,
    language,
    line_templates,
    mixing,
    sharding,
    topk,
    toxicity,
)
from inkveil.llm.classes import connected
from inkveil.llm.common import running
from inkveil.llm.shingles import PIECE, shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string"
#: names that operators use for columns of their own
CLASHES = "size row key bits member band target moments kept text_hash lines label link n".split()
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", "a"),
    (4, "one", "en", None),
    (5, "one", None, "b"),
    (6, LONG, "de", "b"),
    (7, LONG, "de", "b"),
    (8, "same row", "en", "b"),
    (8, "same row", "en", "b"),
    (9, "12 34 !!", "en", ""),
    (None, "no id but text of many words here", "en", "c"),
    (10, "éà ünï\x00 \U0001f600 text of some length, and more words", "fr", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.selectExpr("*", *[f"'x' AS {name}" for name in CLASHES])


@pytest.fixture(scope="module")
def nothing(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "too short")]
    return spark.createDataFrame(rows, "item_id long, text string")


def fitted(docs):
    return language.fit(docs)


PER_DOCUMENT = {
    "lines": line_templates.deduplicated,
    "shards": sharding.shard_documents,
    "language": lambda d: language.identified(d, fitted(d)),
    "classes": jaccard_join.jaccard_classes,
    "mix": mixing.taken,
    "toxicity": lambda d: toxicity.scored(
        d, toxicity.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic"))
    ),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_odd_rows_and_empty_tables(odd, nothing, name):
    out = PER_DOCUMENT[name](odd)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == sorted(r[0] or 0 for r in ODD)
    assert PER_DOCUMENT[name](nothing).count() == 0


def test_stages_on_odd_rows(spark, odd, nothing, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "sharding":
                assert docs.columns == start.columns
        docs.collect()
    kept = corpus_pipeline.identify_language(spark, odd, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, None, 10}
    one = corpus_pipeline.drop_near_duplicates(spark, odd, str(tmp_path))
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 10]


def test_words_and_runs():
    texts = ["a b c d e f", None, "", "x  y", "a b c d e f"]
    runs, begins = shingle_hashes(texts)
    assert np.diff(begins).tolist() == [2, 0, 0, 1, 2]
    assert runs[:2].tolist() == runs[3:].tolist()
    long = "word" * 10 + " " + " ".join(str(i) for i in range(PIECE // 4))
    words, begins = word_hashes([long])
    assert len(words) == len(long.split()) and len(set(words.tolist())) == len(set(long.split()))


def near_copies(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def runs_of(text):
    w = (text or "").split()
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) or frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [runs_of(x) for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = [set() for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 10 * len(a & b) >= 8 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
            if a != b:
                linked[i].add(b)
                linked[j].add(a)
    for row in jaccard_join.jaccard_classes(docs).collect():
        i = row["doc_id"]
        assert (row["class_id"], row["n_links"]) == (find(i), len(linked[i]))
        assert row["n_copies"] == sum(s == sets[i] for s in sets)


def test_links_of_documents_without_id(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (None, base + " more"), (7, base + " end"), (8, "something else in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs).collect())
    assert out == [(7, 2), (7, 2), (7, 2), (8, 0)]


def test_one_document_of_each_class_stays(spark):
    base, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "wv")
    rows = [
        (3, base), (5, base), (5, "a text of its own that only one document has"), (None, base),
        (None, base + " more"), (None, other), (None, other), (None, other + " more"),
        (7, "repeated row of some words"), (7, "repeated row of some words"),
        (8, None), (8, None), (None, None), (9, " "),
    ]
    docs = spark.createDataFrame(
        [(i, t, f"l{n}", "s") for n, (i, t) in enumerate(rows)], SCHEMA
    )
    for part in (1, 5):
        out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(part), "").collect()
        kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:8].strip()) for r in out)
        assert [k for k in kept if k[1][:2] != "v0"] == [
            (0, ""), (3, "w0 w1 w2"), (5, "a text o"), (7, "repeated"), (8, ""), (9, "")
        ]
        assert len(kept) == 7 and [r["doc_id"] for r in out if r["text"] and r["text"][0] == "v"] == [None]
        assert [r["lang"] for r in out if r["doc_id"] == 7] == ["l8"]


def test_documents_without_id_are_not_all_joined(spark):
    rows = [(None, " ".join(f"w{i}x{j // 2}" for i in range(60))) for j in range(40)]
    rows = [(i, f"{text} {n}") for n, (i, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard_join._Join(docs, 0.8, 0.9999)
    named = join.signed.selectExpr("row AS a", "row AS b")
    plan = join.load_sets(named)._jdf.queryExecution().optimizedPlan().toString()
    assert "text_hash" in next(x for x in plan.splitlines() if "Join Inner" in x)
    out = jaccard_join.jaccard_classes(docs).collect()
    assert len(out) == 40 and {r["n_links"] for r in out} == {1}


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.bands_and_rows(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= jaccard_join.MOST_HASHES


def test_large_class_is_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    test_classes_against_brute_force(spark, 3)


def test_connected_chain(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert roots == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_items_inside_long_documents(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (5, 8, 12, 30, 64, 65, 200)]
    texts = []
    for k, item in enumerate(items):
        for cut in (0, len(item) // 12):
            filler = [word() for _ in range(3000)]
            texts.append(" ".join(filler[:1500] + item[cut:] + filler[1500:]))
        texts.append(" ".join(item[: len(item) // 2]) + f" end {k}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(
        [(k, " ".join(x)) for k, x in enumerate(items)] + [(99, "a b"), (100, None)],
        "item_id long, text string",
    )
    want = {}
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            both = len(runs_of(text) & runs_of(" ".join(item)))
            if 10 * both >= 8 * len(runs_of(" ".join(item))):
                want[d, k] = both
    found = decontamination.contained(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["shared"] for r in found} == want
    clean = decontamination.decontaminated(docs, bench).collect()
    assert {r["doc_id"] for r in clean} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contained(docs, bench.limit(0)).count() == 0
    unnamed = docs.selectExpr("cast(NULL AS long) AS doc_id", "text")
    assert decontamination.contained(unnamed, bench).count() == len(want)
    assert decontamination.decontaminated(unnamed, bench).count() == len(clean)


def test_shortest_items_are_never_missed(spark):
    rng = random.Random(9)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(5 + k % 3)) for k in range(300)]
    items += ["the " * 20 + "end", "a b " * 9]  # few different runs for their length
    filler = [f"f{i}" for i in range(400)]
    texts = []
    for item in items:
        rng.shuffle(filler)
        texts.append(" ".join([*filler[:200], item, *filler[200:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.contained(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(len(items))}


def test_shards(spark):
    rows = [(i, f"text {i}" * (1 + i % 7)) for i in range(400)]
    rows += [(1000 + i, "the same text again and again") for i in range(300)]
    rows += [(2000 + i, f"pair {i // 2} of documents") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.asDict() for r in sharding.shard_documents(docs).collect()]
    texts = dict(rows)
    for r in out:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
    load = {s: sum(r["size"] for r in out if r["shard"] == s) for s in range(8)}
    assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in out)
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    where = {r["doc_id"]: r["shard"] for r in out}
    assert sum(where[2000 + i] != where[2001 + i] for i in range(0, 200, 2)) <= 5
    # too large for one shard, but most of it is in the few that it fills
    spread = sorted(([where[1000 + i] for i in range(300)].count(s) for s in range(8)), reverse=True)
    assert sum(spread[:4]) >= 0.8 * 300, spread


def cut_and_loads(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(docs).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in rows)
    texts, where, load = dict(rows), {}, dict.fromkeys(range(8), 0)
    for r in out:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        load[r["shard"]] += r["size"]
    slots = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(8)}
    assert all(x == list(range(len(x))) for x in slots.values())
    return sum(len(x) > 1 for x in where.values()), max(load.values()) - min(load.values())


@pytest.mark.parametrize("sizes", ["even", "pareto"])
@pytest.mark.parametrize("single", [0, 150])
def test_shards_of_linked_documents(spark, sizes, single):
    """Nothing but pairs: sizes are near equal, and few pairs are cut."""
    rng = random.Random(sizes)
    length = lambda: rng.randint(100, 1000) if sizes == "even" else int(80 * rng.paretovariate(1.5))
    pairs = [f"{i} " + "x" * min(length(), 20_000) for i in range(300)]
    rows = [(2 * i + k, text) for i, text in enumerate(pairs) for k in (0, 1)]
    rows += [(1000 + i, f"single {i} " + "y" * length()) for i in range(single)]
    cut, apart = cut_and_loads(spark, rows)
    largest = max(len(t) + 1 for _, t in rows)
    assert cut <= 15 and apart <= (2 if single else 1) * largest


def test_shards_of_few_large_groups(spark):
    rows = [(i, f"group {i % 3} " + "x" * 50) for i in range(900)] + [(2000, "alone")]
    cut, apart = cut_and_loads(spark, rows)
    # every full shard may be over by half a document, which one shard then lacks
    assert cut <= 3 and apart <= 8 / 2 * 60


def test_running_sums_over_buckets(spark, monkeypatch):
    monkeypatch.setattr("inkveil.llm.common.ROWS_PER_BUCKET", 4)  # 50 buckets in 13 stretches
    df = spark.range(200).selectExpr(
        "id", "id % 3 AS part", "xxhash64(id) & 4294967295 AS bits", "id % 5 AS amount"
    )
    out = running(df, "part", "bits", ["bits", "id"], "amount", 200).collect()
    for part in range(3):
        rows = sorted((r for r in out if r["part"] == part), key=lambda r: (r["bits"], r["id"]))
        assert [r["number"] for r in rows] == list(range(len(rows)))
        assert [r["before"] for r in rows] == [
            sum(x["amount"] for x in rows[:i]) for i in range(len(rows))
        ]


def test_mix(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = rng.choice("abcdef" + "a" * 6)
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)), "l", source))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in mixing.taken(docs).collect()}
    sizes = {i: len(t.split()) for i, t, _, _ in rows}
    total = sum(sizes.values())
    by = {}
    for i, _, _, source in rows:
        by.setdefault(source, []).append(i)
    assert sum(out[ids[0]]["target"] for ids in by.values()) == pytest.approx(total)
    for ids in by.values():
        own = sum(sizes[i] for i in ids)
        target = out[ids[0]]["target"]
        assert target <= 3 * own + 1e-6
        assert abs(sum(out[i]["taken"] for i in ids) - target) <= 60
        assert all(out[i]["taken"] <= 3 * sizes[i] for i in ids)
    order = [r["doc_id"] for r in mixing.mixed(docs).collect()]
    assert len(order) == sum(out[i]["taken"] // sizes[i] for i in out if sizes[i])
    again = {r["doc_id"]: r["taken"] for r in mixing.taken(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in out.items()}
    early = [rows[i][3] for i in order[: len(order) // 4]]
    late = [rows[i][3] for i in order[-len(order) // 4 :]]
    assert early.count("a") > late.count("a")  # the heavy source comes early


def test_moments_invert_the_schedule(spark):
    knots = (2.0, 0.5, 0.5, 1.0)
    t = np.linspace(0, 1, 200_001)
    weight = np.interp(t, np.linspace(0, 1, len(knots)), knots)
    done = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    done /= done[-1]
    shares = [0.0, 0.1, 0.37, 0.5, 0.77, 0.999]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r[0] for r in df.select(mixing.due_at(df["s"], knots)).collect()]
    assert np.allclose(got, np.interp(shares, done, t), atol=1e-4)


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 7, 20, 40):
        words = language.codewords(n)
        apart = [int((a != b).sum()) for a, b in itertools.combinations(words, 2)]
        assert min(apart) >= words.shape[1] // 2


def test_language_held_out(spark):
    rng = random.Random(4)
    stems = {"aa": "ka lo mi ta".split(), "bb": "shra wen oth ing".split(), "cc": "ñe ció ra do".split()}
    rows = []
    for i in range(600):
        lang = rng.choice(list(stems))
        text = " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(30))
        rows.append((i, text, lang if i % 10 else None, "s"))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = language.identified(docs, language.fit(docs)).collect()
    assert {r["doc_id"] for r in out if r["held_out"]} == {
        i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1
    }
    tested = [(r["lang_pred"], rows[r["doc_id"]][2]) for r in out if rows[r["doc_id"]][2]]
    assert sum(a == b for a, b in tested) / len(tested) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


@pytest.mark.parametrize("ident", [None, 8], ids=["no id", "one id"])
def test_languages_are_sampled_one_by_one(spark, ident):
    """Many rows that share an id, and copies of one text, push no other language out."""
    rng = random.Random(9)
    stems = {"en": "the wer ing ou".split(), "fr": "eux ié la ret".split(), "de": "sch un ber ein".split()}

    def text(lang):
        return " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(25))

    rows = [(ident, text("en"), "en", "s") for _ in range(8000)]
    rows += [(10_000 + i, text(lang), lang, "s") for i, lang in enumerate(["fr", "de"] * 750)]
    copied = text("de")
    rows += [(20_000 + i, copied, "de", "s") for i in range(5000)] + [(30_000, "zu zo zi " * 9, "xx", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = language.fit(docs)
    assert set(model.languages) >= {"en", "fr", "de"}
    out = language.identified(docs.where("lang <> 'xx'"), model)
    truth = {r[1]: r[2] for r in rows}
    own = out.join(docs.select("doc_id", "text").distinct(), "doc_id")
    pairs = [(r.lang_pred, truth[r.text]) for r in own.where("held_out AND doc_id < 20000").collect()]
    assert len(pairs) > 300 and sum(a == b for a, b in pairs) / len(pairs) >= 0.95
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.where("lang IN ('en', 'fr', 'de')").count() == len(rows) - 1
    sample = language._sampled(docs, 100)
    assert sample.groupby("lang").size().to_dict() == {"en": 100, "fr": 100, "de": 100, "xx": 1}


def test_language_stage_rejects_noise(spark):
    rng = random.Random(7)
    stems = {"aa": "ka lo mi ta".split(), "bb": "shra wen oth ing".split(), "cc": "ñe ció ra do".split()}
    rows = []
    for i in range(900):
        lang = rng.choice(list(stems))
        text = " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(30))
        rows.append((i, text, lang, "s"))
    noise = [" ".join("".join(rng.choices("qzxvjQXZ", k=9)) for _ in range(30)) for _ in range(50)]
    rows += [(1000 + i, x, None, "s") for i, x in enumerate(noise)] + [(2000, "12 34", None, "s")]
    rows += [(2001, "ka lo", None, "s"), (2002, None, "aa", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {*range(900), 2001}
    unknown = docs.where("doc_id % 3 = 1")
    unknown = unknown.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang", "source")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, unknown, "").collect()}
    assert kept == {i for i, x, _, _ in rows if i % 3 == 1 and language.has_letter(x)}


def test_every_text_is_learned_from(spark):
    """Without any one text the model is another, however small the groups; the limit is that
    of all held-out texts."""
    rng = random.Random(11)
    stems = {"aa": "ka lo mi ta".split(), "bb": "shra wen oth ing".split()}
    rows = []
    for i in range(3000):
        lang = "bb" if i % 20 == 0 else "aa"
        text = " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(12))
        rows.append((i, text, lang, "s"))
    docs = spark.createDataFrame(rows, SCHEMA)
    few = docs.where("doc_id < 200").repartition(3)
    model = language.fit(few, 10)
    again = language.fit(few.repartition(5), 10)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.trust, again.trust)
    assert (np.sign(model.offsets + language.features([rows[0][1], rows[1][1]], language._letters())
                    @ model.weights) == model.words[::-1]).all()
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    for i in learned[1:90:30]:
        other = language.fit(few.where(f"doc_id <> {i}"), 10)
        assert not np.array_equal(model.weights, other.weights)
    held = [x for i, x, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    far = model.nearest(language.features(held, language._letters()))
    assert len(held) > 900
    assert language.farthest(docs, model) == pytest.approx(far.max() + language.BEYOND, abs=1e-6)


def test_language_without_learning(spark, odd):
    blank = odd.withColumn("lang", odd["lang"].substr(9, 1).isNull().cast("string").substr(9, 9))
    out = language.identified(odd, language.fit(blank.where("lang = 'never'"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 12)).round(1).astype(np.float32)
    vectors[100:160] = vectors[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(None, [1.0] * 12), (500, None), (550, []), (600, [1.0, None]), (650, [float("nan")]), (700, [float("inf")])]
    short = [(750, [3.0, -1.0])]
    table = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<float>")
    whole = np.floor(256 * vectors.astype(float)).astype(np.int64)
    ids = [*range(400), 750]
    whole = np.vstack([whole, [768, -256] + [0] * 10])
    got = {}
    for r in topk.nearest(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        scores = whole @ whole[ids.index(q)]
        best = sorted((-int(s), i) for s, i in zip(scores, ids, strict=True) if i != q)[:5]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


PAGE = """<html><head><title>t</title></head><body class="no-ads"><header><h2>Site</h2></header>
<div id="cookie-notice">We use cookies, many of them, to do this and that.</div>
<main><article class="post"><header><h1>Head &amp; line</h1></header>
<p>First <b>para&shy;graph</b>,\n with a   long text, and <a href=x>a link</a>.<p>Second one.
<ul><li>One<li>Two</ul><script>if (a < b) "</p>"</script><aside>Beside</aside>
<div class="comments"><p>I think so too, and so does everybody else here.</p></div>
<pre>x &lt; y</pre></article></main><footer>&copy; me</footer></body></html>"""


def test_main_text():
    text = "Head & line\nFirst para\xadgraph, with a long text, and a link.\nSecond one.\nOne\nTwo\nx < y"
    assert html_text.main_text(PAGE) == text
    plain = "<div class=menu><a href=a>A</a></div><div><p>" + "Words, and more words. " * 9 + "</p><p>End.</p></div>"
    assert html_text.main_text(plain) == ("Words, and more words. " * 9).strip() + "\nEnd."
    for page in (None, "", "<", "<p", "<!--", "<script>", "</p></p>", "<p>" * 3000, "&", "<a href='"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("just text &eacute;") == "just text é"


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "widget-wrap", "share-on"])
def test_wrapper_named_like_a_part_of_the_layout(name):
    one, two = "Words, and more of them. " * 9, "Others; and so on. " * 9
    side = "<div class='sidebar'><a href=a>All</a> links</div>"
    page = f"<body><div class='{name}'><h1>Head</h1><p>{one}</p><p>{two}</p>{side}</div></body>"
    assert html_text.main_text(page) == f"Head\n{one.strip()}\n{two.strip()}"
    aside = f"<body><article><p>Short.</p></article><div class='{name}'><p>{one}</p><p>{two}</p></div></body>"
    assert html_text.main_text(aside) == "Short."


@pytest.mark.parametrize("name", ["entry has-comments", "post-notice", "no-comments", "skip-ads"])
def test_content_named_like_what_stands_beside_it(name):
    one, two = "Words, and more of them. " * 9, "Others; and so on. " * 9
    inner = "<div class='comments'><p>So do I.</p><p>So does everybody.</p></div>"
    text = f"Head\n{one.strip()}\n{two.strip()}"
    body = f"<h1>Head</h1><p>{one}</p><p>{two}</p>{inner}"
    assert html_text.main_text(f"<body><div class='{name}'>{body}</div></body>") == text
    article = f"<body><article class='post comments-open'>{body}</article></body>"
    assert html_text.main_text(article) == text
    many = f"<div class='comments'>{'<p>So do I, and so does everybody else.</p>' * 90}</div>"
    beside = f"<body><div class='post'><h1>Head</h1><p>{one}</p><p>{two}</p></div>{many}</body>"
    assert html_text.main_text(beside) == text
    replies = f"<article class='comment'><p>{two}</p></article>" * 5
    assert html_text.main_text(f"<body><article>{body}</article>{replies}</body>") == text


@pytest.mark.parametrize("article", [False, True])
def test_form_around_the_page(article):
    one, two = "Words, and more of them. " * 9, "Others; and so on. " * 9
    search = "<form action=s><label>Search</label><input name=q> the site</form>"
    body = f"<h1>Head</h1><p>{one}</p>{search}<p>{two}</p>"
    body = f"<article>{body}</article>" if article else f"<div>{body}</div>"
    reply = "<form class='respond'><p>Leave a reply, your name is needed.</p><label>Name</label></form>"
    text = f"Head\n{one.strip()}\n{two.strip()}"
    page = f"<body><form method=post action=x><div id=menu><a href=a>A</a></div>{body}{reply}</form></body>"
    assert html_text.main_text(page) == text
    assert html_text.main_text(f"<body>{search}{body}{reply}</body>") == text


def test_all_articles_of_a_page_stay():
    long, short = "Words, and more of them. " * 40, "A short one, but an article."
    page = f"<body><nav><a href=a>A</a></nav><article><h2>One</h2><p>{long}</p></article><article><h2>Two</h2><p>{short}</p></article></body>"
    assert html_text.main_text(page) == f"One\n{long.strip()}\nTwo\n{short}"


@pytest.mark.parametrize("name", ["notice-board", "reply-quote", "share_price", "menu-item-text"])
def test_paragraphs_are_not_named_by_parts_of_words(name):
    one, two = "Words, and more of them. " * 9, "Others; and so on, and on."
    page = f"<body><article><h1>Head</h1><p>{one}</p><p class='{name}'>{two}</p><p class='notice'>We use cookies.</p></article></body>"
    assert html_text.main_text(page) == f"Head\n{one.strip()}\n{two}"


@pytest.mark.parametrize("shape", ["<div>a ", "<font>a<p>b ", "<div class=sidebar>a, b", "<b></i>t"])
def test_deep_pages_take_linear_time(shape):
    begin = time.perf_counter()
    text = html_text.main_text(shape * 50_000)
    assert time.perf_counter() - begin < 20
    if "sidebar" not in shape:
        letters = shape.count("a ") + shape.count("b ") + shape.count("t")
        assert len("".join(text.split())) >= 50_000 * min(1, letters)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_text.extracted(pages.withColumn("text", pages["url"])).collect()}
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == ""


def test_text_travels_once_for_many_items(spark):
    """A long document that holds thousands of items."""
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(9000)}" for _ in range(20)) for _ in range(5000)]
    rows = [(1, " and ".join(items)), (2, " ".join(items[7].split()[:12]) + " end"), (None, items[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.contained(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, i) for i in range(5000)} | {(None, 3)}
    assert all(r["shared"] == r["item_runs"] == 16 for r in found)
    plan = decontamination.contained(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan, "the text meets lists of items"


def test_identical_rows_are_no_hot_bucket(spark, monkeypatch):
    """Very many rows without id and text, and copies of one row, are one row of the sums."""
    seen = []
    run = mixing.running
    monkeypatch.setattr(mixing, "running", lambda df, *a: seen.append(df) or run(df, *a))
    rows = [(i, "some words of text", "l", "a") for i in range(300)] + [(7, "one row", "l", "b")] * 500
    docs = spark.createDataFrame(rows, SCHEMA)
    blank = spark.range(100_000).selectExpr("cast(NULL AS long) AS doc_id", "cast(NULL AS string) AS text",
                                            "'l' AS lang", "cast(NULL AS string) AS source")
    out = mixing.taken(docs.unionByName(blank))
    assert seen[0].count() == 302
    sums = {r["doc_id"]: r for r in out.groupBy("doc_id").agg({"*": "count", "taken": "sum"}).collect()}
    assert sums[None]["count(1)"] == 100_000 and sums[None]["sum(taken)"] == 0
    assert sums[7]["count(1)"] == 501
    again = mixing.taken(docs.unionByName(blank).repartition(7))
    assert sorted(map(str, out.where("size > 0").collect())) == sorted(map(str, again.where("size > 0").collect()))
    mixed = mixing.mixed(docs.unionByName(blank))
    assert mixed.where("text IS NULL").count() == 0
    words = out.where("size > 0").selectExpr("sum(taken) AS n").first()["n"]
    taken = mixed.selectExpr("sum(size(split(text, ' '))) AS n").first()["n"]
    assert taken == words


def test_restored_spans():
    rng = random.Random(3)
    vocabulary = "idiot moron worthless stupid loser the and house letter happy running mouse".split()
    import pandas as pd

    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(200)]
    counts = next(iter(toxicity._counter(iter([pd.DataFrame({"text": texts})]))))
    table = np.zeros(toxicity.TRIGRAMS + toxicity.BIGRAMS, np.float32)
    table[counts["slot"]] = counts["n"]
    model = toxicity.CharacterModel(table[: toxicity.TRIGRAMS], table[toxicity.TRIGRAMS :])
    read = toxicity.restorer(model)
    assert read("you 1d10t!") == "you idiot"
    assert read("an i d i o t here") == "an idiot here"
    assert read("l.o.s.e.r stuuuuupid m0r0n w0rthl3ss") == "loser stupid moron worthless"
    assert read("the happy letter") == "the happy letter"


def reader_of(texts):
    import pandas as pd

    counts = next(iter(toxicity._counter(iter([pd.DataFrame({"text": texts})]))))
    table = np.zeros(toxicity.TRIGRAMS + toxicity.BIGRAMS, np.float32)
    table[counts["slot"]] = counts["n"]
    return toxicity.CharacterModel(table[: toxicity.TRIGRAMS], table[toxicity.TRIGRAMS :])


FORMS = [
    ("idio7", "idiot"), ("scum5", "scums"), ("tras4", "trasa"), ("m-0-r-o-n", "moron"), ("s..c..u..m", "scum"),
    ("i/d/i/o/t", "idiot"), ("i,d,i,o,t", "idiot"), ("mo-ron", "moron"), ("st.up.id", "stupid"),
    ("i  d  i  o  t", "idiot"), ("i\td\ti\to\tt", "idiot"), ("s\nc\nu\nm", "scum"), ("1d1ot", "idiot"),
    ("tra$h", "trash"), ("m-o-r-o-n", "moron"), ("i d i o t", "idiot"), ("idiooot", "idiot"), ("m0r0n!", "moron"),
    ("@ss", "ass"), ("$tup1d", "stupid"), ("s_c_u_m", "scum"), ("i:d:i:o:t", "idiot"), ("\"idio7\",", "idiot"),
]
CLEAN = ["win7", "a/b/c", "e.g.", "co-op", "the end.", "wow!", "on 3 days", "well-known", "and/or", "letter", "(see house)",
         "a b", "2024-05-06", "12:30", "..."]


def test_forms_of_the_channel():
    rng = random.Random(5)
    bad = "idiot moron stupid scum scums trash trasa ass".split()
    good = "win the a b c e g co op end wow on days well known and or letter see house".split()
    texts = [" ".join(rng.choices(bad + good * 3, k=40)) for _ in range(400)]
    model = reader_of(texts)
    read, reader = toxicity.restorer(model), toxicity._Reader()
    for form, word in FORMS:
        text = f"you are {form} today"
        assert reader.suspects([text])[0], form
        assert word in read(text).split(), (form, read(text))
    for text in CLEAN:
        assert read(f"so {text} then") == f"so {text} then", (text, read(f"so {text} then"))


def test_the_first_look_leaves_out_nothing():
    """A text that reads otherwise than it stands is always suspected."""
    rng = random.Random(6)
    model = reader_of(["idiot moron stupid " * 50])
    read, reader = toxicity.restorer(model), toxicity._Reader()
    alphabet = "idmorn 107$.-/, \t!"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(4000)]
    suspected = reader.suspects(texts)
    assert all(s or read(t) == t for t, s in zip(texts, suspected))
    assert not reader.suspects(["plain words, and more. (all) of them; so - be it"])[0]


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in "ka lo mi ta ru".split() for b in "ne so di pa".split()]
    bad = ["grumbly", "snorfel", "wimbash"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = rng.choices(plain, k=40)
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), "l", "s"))
        labels.append((i, int(toxic)))
    rows.append((5000, "ka so grumb1y sn0rf3l w1mb4sh wimbaaaash " + " ".join(plain), "l", "s"))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    tested = [(out[i]["predicted"], y) for i, y in labels if out[i]["held_out"]]
    assert sum(a == b for a, b in tested) / len(tested) > 0.97
    assert out[5000]["predicted"] == 1, (out[5000], toxicity.restorer(model.characters)(rows[-1][1]))


def test_chat_round_trip(spark):
    pool = ["\\", "#", "###", "### ", "</turn>", "\n", "h", "t", "c", ":", ": ", "a", "é", "\U0001f600", ""]
    rng = random.Random(6)
    make = lambda: "".join(rng.choices(pool, k=rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", make()]), make()) for c in range(60) for t in range(5)]
    rows += [(-1, 0, None, None), (None, 1, "user", "x"), (-2, 0, "user", "hi"), (-2, 1, "assistant", "yo")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(table).collect()}
    assert len(out) == 63
    for conv, r in out.items():
        turns = sorted((t, a or "", b or "") for c, t, a, b in rows if c == conv)
        whole = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["loss_chars"] == len(loss)
    assert out[-2]["valid"] and out[-2]["broke_at"] is None
    assert not out[-1]["valid"] and out[-1]["broke_at"] == 0 and out[None]["broke_at"] == 1
    assert chat.digests(table.limit(0)).count() == 0


def test_templates_across_documents(spark):
    rows = [(i, f"user {i} logged in from host\nown line of {chr(97 + i)} alone in here {i}") for i in range(6)]
    rows = [(i, t + "\n\nshared footer line") for i, t in rows]
    words = "red green blue black white pink".split()
    rows += [(20 + i, f"the long line that says {w} and then goes on and on to its end") for i, w in enumerate(words)]
    rows += [(40, "shared footer\nseen twice only"), (41, "seen twice only"), (42, None), (43, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_templates.deduplicated(docs).collect()}
    assert [out[i]["n_lines"] for i in (0, 20, 40, 42, 43)] == [3, 1, 2, 0, 0]
    assert out[0]["text"].startswith("own line of a") or out[0]["text"] == ""
    assert all(out[20 + i]["text"] == "" for i in range(6))
    assert out[40]["text"] == "shared footer\nseen twice only" and out[41]["n_dropped"] == 0
    assert out[42]["text"] is None and out[43]["text"] == ""
