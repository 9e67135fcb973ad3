"""Hard negatives, suffix deduplication and importance resampling on planted rows and against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from abaculus.llm import hard_negatives as hn
from abaculus.llm import resampling as rs
from abaculus.llm import suffix_dedup as sd
from abaculus.llm.queries import QUERIES, SQL

NEW = ("op11_hard_negatives", "op12_suffix_merge", "op13_importance_resampling")


def test_registered():
    assert set(NEW) <= set(QUERIES) and set(NEW) <= set(SQL)  # test_native_ops holds them against their SQL


# --- hard negatives


def brute_negatives(rows, every=50, positives=5, negatives=3):
    kept = {}
    for i, label, v in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or []) if r[2] is None or all(x is not None for x in r[2]) else (True, 0, True, [])):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))  # noqa: E731  shorter ones end in zeros
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {i: dot(v, w) for i, (_, w) in kept.items() if i != a}
        best = sorted((i for i in score if kept[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in best:
            hits = sorted((i for i in score if kept[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))[:negatives]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(hits, 1)]
    return sorted(out)


def mined(df, **k):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hn.hard_negatives(df, **k).collect())


def clustered(n, dim, seed, copies=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = [(i, int(r.integers(4)), (centres[r.integers(6)] + 0.4 * r.normal(size=dim)).tolist()) for i in range(n)]
    return rows + [(n + i, i % 2, rows[0][2]) for i in range(copies)]  # a very common vector, with ties


SCHEMA = "vec_id long, label int, embedding array<double>, score double, id string, block long"


@pytest.mark.parametrize("block", [hn.BLOCK_ROWS, 16])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    rows = clustered(400, 20, 1, copies=150)
    rows += [(600, None, [1.0] * 20), (601, 1, None), (602, 1, [None] * 20), (603, 2, [float("nan")] * 20), (604, 2, [float("inf")] * 20), (None, 1, [1.0] * 20), (650, 2, [2.0, 1.0]), (651, 2, []), (3, 0, rows[8][2]), (50, 3, rows[9][2])]
    df = spark.createDataFrame([(*r, 0.5, "clash", 7) for r in rows], SCHEMA).repartition(5)
    want = brute_negatives(rows)
    assert mined(df) == want and len(want) > 20


def test_anchors_too_many_to_broadcast_meet_as_stored_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "small", lambda df: False)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 8)
    rows = clustered(120, 9, 2)
    df = spark.createDataFrame([(*r, 0.5, "clash", 7) for r in rows], SCHEMA)
    assert mined(df, is_anchor=hn.F.col("id") % 5 == 0) == brute_negatives(rows, every=5)


def test_negatives_of_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mined(df) == []
    one = spark.createDataFrame([(50, 1, [1.0], 0.0, "", 0)], SCHEMA)
    assert mined(one) == []


def test_bounds_hold_at_every_level():
    r = np.random.default_rng(4)
    x, y = np.floor(r.normal(size=(80, 37)) * 300), np.floor(r.normal(size=(70, 37)) * 300)
    x[5], x[6], y[3] = 0, 1000, x[7]
    exact = x @ y.T
    for (mx, dx), (my, dy) in zip(hn._summaries(x), hn._summaries(y), strict=True):
        middle, reach = mx @ my.T, dx @ dy.T + 1e-6
        assert (middle - reach <= exact).all() and (exact <= middle + reach).all()
    block = lambda m: hn.Block(np.arange(len(m)), np.zeros(len(m), int), m, hn._summaries(m), np.empty((len(m), 0)), np.empty((len(m), 0)))
    for least, most in ((-np.inf, np.inf), (2e6, 3e6), (6e6, np.inf)):
        alive = r.random(exact.shape) < 0.7
        got = hn.scored(block(x), block(y), alive, np.full(70, least), np.full(70, most))
        needed = alive & (exact >= least) & (exact <= most)
        assert (got[needed] == exact[needed]).all() and ((got == -np.inf) | (got == exact)).all()


# --- suffix deduplication


def brute_spans(rows):
    first, data = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for a in range(len(b) - 49):
            if i is not None:
                first[b[a : a + 50]] = min(i, first.get(b[a : a + 50], i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if i is not None and first[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def cleaned(df, **sizes):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, **sizes).collect())


def repeating(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij é") for _ in range(r.randint(2, 8))) for _ in range(200)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [*(prose(12) for _ in range(5)), "x y " * 40, "\0" * 70, "exactly fifty bytes, not one more and not one less"[:50].ljust(50, "!")]
    rows = []
    for i in range(70):
        text = prose(r.randint(0, 50))
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(text))
            text = text[:k] + r.choice(passages) + text[k:]
        rows.append((i * 3 % 71, text))
    long = prose(300)
    return rows + [(500, rows[5][1]), (501, rows[5][1]), (502, ""), (503, None), (504, "short"), (505, rows[7][1] + "!"), (506, "q" * 5000), (507, "q" * 3000), (None, passages[0]), (None, rows[9][1]),
                   (508, long), (508, long), (508, "another text of one id " + passages[1]), (2, passages[2] + long[:200])]


@pytest.mark.parametrize("sizes", [{}, {"often": 2}, {"most": 3}, {"often": 4, "most": 6, "run_bytes": 20_000, "part_bytes": 3000}])
def test_suffix_dedup_equals_brute_force(spark, sizes):
    rows = repeating(1)
    df = spark.createDataFrame([(i, t, 1, b"x", "k") for i, t in rows], "doc_id long, text string, mark int, spans binary, part string")
    assert cleaned(df, **sizes) == brute_spans(rows)


def test_text_longer_than_a_slice(spark, monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(2_300_000))
    cut = sd.SLICE
    rows = [(1, text[cut - 40 : cut + 60]), (2, text), (3, text[2 * cut - 10 : 2 * cut + 45])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in sd.remove_repeats(df).collect()}
    assert got == {1: (0, 0), 2: (100, 1), 3: (55, 1)}


def test_kept_bytes_and_no_rows(spark):
    a = "A passage that is long enough to be removed, as it has sixty-odd bytes."
    df = spark.createDataFrame([(1, a), (2, f"<{a}>")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(df, with_kept=True).collect()}
    assert kept == {1: a.encode(), 2: b"<>"}
    assert sd.remove_repeats(df.limit(0)).count() == 0
    assert [r.n_removed for r in sd.remove_repeats(df.where("doc_id = 1")).collect()] == [0]


def prefix(a, b):
    return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_loser_tree_merges_and_knows_common_prefixes():
    r = random.Random(2)
    for _ in range(150):
        runs = []
        for _ in range(r.randint(1, 9)):
            strings = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 30))})
            runs.append((strings, [0, *(prefix(a, b) for a, b in zip(strings, strings[1:]))]))
        run, at, same = sd.merge_runs(runs)
        out = [runs[i][0][j] for i, j in zip(run, at)]
        assert out == sorted(x for s, _ in runs for x in s)
        assert same[1:] == [prefix(a, b) for a, b in zip(out, out[1:])]


def test_merge_does_not_look_at_known_prefixes():
    """With long common prefixes the bytes compared stay near those that differ."""

    class Counted(bytes):
        looked = 0

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    strings = [Counted(b"p" * 1000 + bytes([i])) for i in range(64)]
    runs = [(strings[n::8], [0] + [1000] * 7) for n in range(8)]
    sd.merge_runs(runs)
    assert Counted.looked < 2 * 8 * 125 * 2 + 64 * 8 * 8


def test_runs_come_back_from_front_coding():
    r = np.random.default_rng(1)
    b = r.integers(97, 99, 400).astype(np.uint8)
    place = np.sort(r.integers(0, 390, 120))
    right, left = sd.contexts(b, place, np.zeros(120, int), np.full(120, 400))
    by = sd.sort_order(np.concatenate([right, left], axis=1))
    run = sd.Run(sd.front_coded(right[by], left[by], np.arange(120)[by], np.zeros(120, int), place[by]))
    raw = b.tobytes()
    assert run.suffixes == sorted({raw[p : p + sd.MATCH] for p in place.tolist()})
    assert run.pos.tolist() == place[by].tolist() and run.members_of.sum() == 120


# --- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def brute_resampled(docs, items):
    s, t = [0] * 10000, [0] * 10000
    of = [(i, features(text)) for i, text in docs]
    for counts, texts in ((s, [f for _, f in of]), (t, map(features, items))):
        for f in texts:
            for b in f:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, f in of:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= 39 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = n
    return sorted(map(tuple, rows), key=str)


def resampled(docs, items):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rs.resample(docs, items).collect()), key=str)


@pytest.mark.parametrize("piece", [rs.SLICE, 40])
def test_resampling_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(rs, "SLICE", piece)
    r = random.Random(3)
    words = ["Alpha", "beta", "É", "x1", "née", "don't", "--", "a_b", "42", "\t", "\x7f"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ". ", ""]) for _ in range(n))
    docs = [(i, text(r.randrange(90))) for i in range(120)] + [(200, None), (201, ""), (202, "..."), (None, text(80)), (203, "A" * 300), (204, "a b " * 200), (204, "a b " * 200)]
    items = [text(30) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in docs], "doc_id long, text string, rank int, score double, bucket string").repartition(3)
    got = resampled(df, spark.createDataFrame([(n, t) for n, t in enumerate(items)], "item_id long, text string"))
    want = brute_resampled(docs, items)
    same = lambda rows: [x[:4] for x in rows]  # noqa: E731  the two rows of 204 tie in everything, so they may swap ranks
    assert same(got) == same(want) and sorted(x[4] for x in got if x[4]) == sorted(x[4] for x in want if x[4])
    assert [x for x in got if x[0] != 204] == [x for x in want if x[0] != 204]


def test_resampling_of_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert resampled(docs, items) == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampled(some, items) == brute_resampled([(1, "a b c")], [])


def test_slices_of_a_text_count_each_feature_once(monkeypatch):
    texts = pa.array(["Aa bb CC dd ee! " * 20, None, "", "É x É" * 30, "zz" * 200, " lead and trail "])
    pairs = lambda: sorted((int(a), int(b)) for rows, buckets in rs.features(texts) for a, b in zip(rows, buckets))
    whole = pairs()
    monkeypatch.setattr(rs, "SLICE", 17)
    assert pairs() == whole
    assert [b for a, b in whole if a == 5] == sorted(features(" lead and trail "))
