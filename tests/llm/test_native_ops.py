"""Exact dedup, decontamination and near-dedup on planted rows and against brute force."""

import hashlib
import random
import re

import pytest
from oracle import connect, rows_of, rows_of_sql

from abaculus.llm import decontaminate as dc
from abaculus.llm import exact_dedup as ed
from abaculus.llm import minhash as mh
from abaculus.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, bucket int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", 1) for i, t in enumerate(texts)] if not isinstance(texts, dict) else [(i, t, None, None, None, "clash", 1) for i, t in texts.items()], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), SQL[name])


def test_exact_dedup_cases(spark):
    rows = {1: "Same Text É", 2: "same text É", 3: "same text é", 4: None, 5: "", 6: "x" * 200_000, 7: "X" * 200_000}
    got = {r.doc_id: r for r in ed.exact_dedup(documents(spark, rows)).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {1: 2, 2: 2, 3: 3, 4: 5, 5: 5, 6: 7, 7: 7}
    assert got[1].group_size == 2 and not got[1].kept and got[2].kept
    assert got[4].text_sha256 == hashlib.sha256(b"").hexdigest()
    twice = spark.createDataFrame([(8, "t"), (8, "t"), (None, "t"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in ed.exact_dedup(twice).collect()) == [("8", "8", 3), ("8", "8", 3), ("None", "8", 3), ("None", "None", 1)]
    assert ed.exact_dedup(documents(spark, {})).count() == 0
    kept = ed.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns and {r.doc_id for r in kept.collect()} == {2, 3, 5, 7}


def test_clashing_digests_are_told_apart_by_bytes(spark):
    """With a digest of one character most texts clash; groups still follow the texts."""
    from pyspark.sql import functions as F

    texts = {i: f"Text {i % 7}" for i in range(30)} | {30: "alone", 31: None}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(documents(spark, texts), digest=lambda c: F.left(F.sha2(c, 256), F.lit(1))).collect()}
    for i, t in texts.items():
        same = [j for j, u in texts.items() if (u or "").lower() == (t or "").lower()]
        assert got[i] == (max(same), len(same), i == max(same))


def test_registry_continues(spark, tmp_path):
    """The keyed state goes on from its checkpoint as more files arrive."""
    inbox, registry, state = (str(tmp_path / n) for n in ("in", "reg", "state"))
    for n, row in enumerate([(3, "a", "l3"), (9, "a", "l9"), (5, "b", "l5")]):
        df = spark.createDataFrame([row], "doc_id long, digest string, locator string")
        df.write.mode("append").parquet(inbox)
        ed.update_registry(spark, inbox, registry, state, df.schema)
    got = {r.digest: (r.keep_id, r.keep_locator, r.group_size) for r in ed.read_registry(spark, registry).collect()}
    assert got == {"a": (9, "l9", 2), "b": (5, "l5", 1)}


def brute_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in items.items():
        w = word.findall(low(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = {}
    for d, t in docs.items():
        w, hit, found = word.findall(low(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (m := windows.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k)), found.update(m)
        ids = sorted(map(str, found))
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "é", "x9"]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = {i: " ".join(words(r.choice([3, 5, 9, 10, 11, 25]))) for i in range(30)} | {98: "", 99: None, 100: "Lone"}
    docs = {}
    for i in range(60):
        w = words(r.choice([0, 1, 4, 9, 10, 30, 200]))
        if i % 3 == 0:
            take = (items[r.randrange(30)]).upper().split()
            w = w[: len(w) // 2] + take[: r.choice([9, 10, 40])] + w[len(w) // 2 :]
        docs[i] = ", ".join(w)
    docs |= {60: None, 61: "lone", 62: " ".join(words(20_000))}
    df = documents(spark, docs)
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in dc.decontaminate(df, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == brute_contamination(docs, items)
    clean = dc.keep_clean(df, spark.createDataFrame([(1, docs[0])], "item_id long, text string"))
    assert 0 not in {x.doc_id for x in clean.collect()} and clean.columns == df.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(df, none).where("contaminated").count() == 0
    assert dc.decontaminate(documents(spark, {}), none).count() == 0
    null_id = spark.createDataFrame([(None, docs[0]), (None, docs[0])], "doc_id long, text string")
    assert [x.contaminated for x in dc.decontaminate(null_id, spark.createDataFrame([(1, docs[0])], "item_id long, text string")).collect()] == [True]


def brute_components(docs, percent=85):
    sets = {i: set(mh.shingles(t).tolist()) for i, t in docs.items()}
    comp = {i: i for i in docs}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                comp[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_corpus(seed, groups, size):
    r = random.Random(seed)
    docs, vocab = {}, [f"v{i}" for i in range(500)]
    for g in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([3, 12, 60, 300]))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs[len(docs)] = " ".join(w)
    return docs


def test_near_duplicates_equal_brute_force(spark):
    docs = near_corpus(1, 12, 12) | {1000: None, 1001: "", 1002: "  \t", 1003: "One Two", 1004: "one two", 1005: "one two three four five", 1006: "z " * 30_000}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(documents(spark, docs)).collect()}
    assert got == brute_components(docs)


def test_large_bucket_of_unlike_documents(spark):
    """One long passage shared by documents that are below the threshold of one another: nothing is linked, nothing missed."""
    r = random.Random(2)
    passage = [f"p{i}" for i in range(100)]
    docs = {i: " ".join(passage + [f"q{i}_{k}" for k in range(r.choice([12, 25]))]) for i in range(60)}
    docs |= {60 + i: docs[i] + " end" for i in range(0, 60, 7)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(documents(spark, docs)).collect()}
    assert got == brute_components(docs)


def test_many_copies_of_one_text(spark):
    """Changes of their own, changes that a few share, and copies of changed copies, in buckets far beyond all pairs."""
    r = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    shared = {f"s{k}": [(r.randrange(120), f"s{k}_{j}") for j in range(3)] for k in range(8)}
    docs = {}
    for i in range(260):
        words = list(base)
        for at, w in shared[f"s{i % 8}"] if i % 3 == 0 else []:
            words[at] = w
        for at in r.sample(range(120), r.choice([0, 1, 1, 2, 3, 4])):
            words[at] = f"own{i}_{at}"
        docs[i] = " ".join(words)
    for i in range(260, 300):
        docs[i] = docs[i - 200] + f" end{i} of it"
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in mh.near_duplicates(documents(spark, docs)).collect()}
    want = brute_components(docs)
    assert got == want and 1 < len({c for _, c in want.values()}) < 250


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "A b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in mh.near_duplicates(df).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "None", True)]
    assert mh.near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates():
    import numpy as np

    r = np.random.default_rng(0)
    errors = []
    for j in (0.5, 0.85, 0.95):
        n = 3000
        both = r.integers(0, 2**64, int(n * j), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**64, (n - len(both)) // 2, dtype=np.uint64)])) for _ in range(2))
        errors.append(abs(mh.estimate(mh.registers(a)[None], mh.registers(b)[None])[0] - j))
    assert max(errors) < 0.15
    few = np.unique(r.integers(0, 2**64, 3, dtype=np.uint64))
    assert (mh.registers(few) == mh.registers(few)).all()


def test_decontamination_of_repeated_rows(spark):
    """Equal rows of one id give one row; rows of one id with unlike texts one each."""
    passage = " ".join(f"m{i}" for i in range(12))
    rows = [(1, passage), (1, passage), (2, "clean words"), (2, passage + " x"), (None, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, passage)], "item_id long, text string")).collect())
    assert got == [("1", 12, 12), ("2", 2, 0), ("2", 13, 12), ("None", 0, 0)]
