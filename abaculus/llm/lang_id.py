"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of non-letters becomes one space, and grams of
one to three characters are hashed to ``DIM`` buckets. Document frequencies cover
every labelled row not held out. The classifier is fitted on a sample bounded per language
(``max_train_rows`` distinct texts of each, those with the smallest hashes; tasks count their grams, and
the driver gets the counts, at most ``DIM`` of a text, not the texts) by
follow-the-regularised-leader with elastic-net penalties, which leaves most weights
at zero; a slice of the sample that the fit does not see, every fifth row of a
language, sets the temperature of the softmax. Every whole text is scored
inside Arrow batches; the model (under 2 MB) is the only thing broadcast.

Defined results: a text that is null, empty or without letters is ``und`` with
score 0; with no labelled rows every text is ``und``; rows with null ids are
scored (and held out like the text of an empty id); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.llm.shared import broadcast_if_small, give_back, prepare_workers

DIM = 1 << 15
UNKNOWN = "und"
SLICE_CHARS = 100_000  # characters whose grams are hashed at once


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the text's character grams; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    kept, counts = points[keep], np.zeros(DIM, np.int64)
    for begin in range(0, len(kept), SLICE_CHARS):  # the grams that start in a slice; they reach two characters beyond it
        one = kept[begin : begin + SLICE_CHARS + 2].astype(np.uint64)
        two = one[:-1] * np.uint64(0x110000) + one[1:]
        three = two[:-1] * np.uint64(0x110000) + one[2:]
        grams = [g[:SLICE_CHARS] for g in (one, two, three)]
        mixed = np.concatenate(grams) + np.repeat(np.arange(1, 4, dtype=np.uint64) << np.uint64(62), list(map(len, grams)))
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


class LanguageModel:
    """Weights (DIM x languages), inverse document frequencies and the temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.idf, self.temperature = langs, weights, bias, idf, temperature

    def vector(self, grams: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, counts = grams
        x = (1 + np.log(counts)) * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = self.vector(grams)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or (grams := gram_counts(text)) is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(grams) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]], **settings) -> LanguageModel:
    """Fit on (text, lang) rows."""
    return fit_counts([(gram_counts(text), lang) for text, lang in rows], **settings)


def fit_counts(rows: list[tuple[tuple[np.ndarray, np.ndarray] | None, str]], counted: tuple[int, np.ndarray] | None = None, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> LanguageModel:
    """Fit on (gram counts, lang) rows; every fifth row of a language is kept for the temperature only.

    ``counted`` is the number of documents with letters and how many of them have each bucket (else those of the rows).
    """
    langs = sorted({lang for _, lang in rows})
    seen = [(g, langs.index(lang)) for g, lang in rows if g is not None]
    if not seen:
        return LanguageModel([], np.zeros((DIM, 0)), np.zeros(0), np.zeros(DIM), 1.0)
    tuning, training = seen, seen
    if len(seen) >= 25:
        met, fifth = Counter(), []
        for _, lang in seen:
            met[lang] += 1
            fifth.append(met[lang] % 5 == 0)
        tuning, training = [r for r, f in zip(seen, fifth) if f] or seen, [r for r, f in zip(seen, fifth) if not f]
    if counted is None:
        counted = len(training), np.zeros(DIM)
        for (at, _), _ in training:
            counted[1][at] += 1
    model = LanguageModel(langs, np.zeros((DIM, len(langs))), np.zeros(len(langs)), np.log((1 + counted[0]) / (1 + counted[1])) + 1, 1.0)
    z, n = np.zeros((DIM + 1, len(langs))), np.zeros((DIM + 1, len(langs)))  # the last row is the bias
    vectors = [(*model.vector(g), y) for g, y in training]
    for _ in range(epochs):
        for at, x, y in vectors:
            at1, x1 = np.append(at, DIM), np.append(x, 1.0)
            zs, ns = z[at1], n[at1]
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
            p = softmax(x1 @ w)
            p[y] -= 1
            g = x1[:, None] * p
            z[at1] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[at1] = ns + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    logits, ys = np.array([model.logits(g) for g, _ in tuning]), np.array([y for _, y in tuning])
    aim = np.full(logits.shape, 0.02 / max(1, len(langs)))  # smoothed, so that a faultless slice doesn't make every score 1
    aim[np.arange(len(ys)), ys] += 0.98
    losses = {t: -(aim * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in np.geomspace(0.05, 20, 121)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def document_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with letters, and how many of them have each bucket: one partial sum of DIM counts a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(DIM + 1, np.int64)  # the last one counts the texts
        for batch in batches:
            for text in batch["text"]:
                if (grams := gram_counts(text)) is not None:
                    counts[grams[0]] += 1
                    counts[DIM] += 1
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": counts[at]})
        give_back()

    prepare_workers(docs.sparkSession)
    out = np.zeros(DIM + 1)
    for r in docs.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return int(out[DIM]), out[:DIM]


def _packed_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        grams = [gram_counts(t) for t in batch["text"]]
        packed = [None if g is None else (g[0].astype("<u2").tobytes(), g[1].astype("<u4").tobytes()) for g in grams]
        yield pd.DataFrame({"lang": batch["lang"], "hash": batch["_hash"], "at": [p and p[0] for p in packed], "counts": [p and p[1] for p in packed]})


def training_rows(docs: DataFrame, rows: int) -> list[tuple[tuple[np.ndarray, np.ndarray] | None, str]]:
    """(gram counts, lang) of up to ``rows`` distinct texts of every language, those with the smallest hashes.

    A cut on the hash, by each language's count, leaves about 1.25 times as many before they are ranked.
    """
    hashed = docs.select("lang", F.xxhash64("text").alias("_hash"), "text")
    sizes = hashed.select("lang", "_hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(1.25 * rows) / F.col("_n")
    hashed = hashed.join(broadcast_if_small(sizes), "lang").where((share > 0.6) | (F.col("_hash") < share * 2.0**64 - 2.0**63))
    distinct = hashed.groupBy("lang", "_hash").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    chosen = distinct.withColumn("_rank", rank).where(F.col("_rank") <= rows).select("lang", "_hash", "text")
    prepare_workers(docs.sparkSession)
    found = chosen.mapInPandas(_packed_counts, "lang string, hash long, at binary, counts binary").orderBy("hash", "lang").collect()
    unpack = lambda r: None if r["at"] is None else (np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64))
    return [(unpack(r), r["lang"]) for r in found]


def train(docs: DataFrame, max_train_rows: int = 1000, hold: Column | None = None) -> LanguageModel:
    """Fit on the labelled rows outside ``hold``, up to ``max_train_rows`` texts a language; count buckets in all of them."""
    seen = docs.where("text is not null and lang is not null").where(~(held_out() if hold is None else hold))
    rows = training_rows(seen, max_train_rows)
    return fit_counts(rows, document_counts(seen) if rows else None)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])
        give_back()

    return docs.withColumn("_found", predict(F.col(text_col))).select(*docs.columns, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))


def language_id(docs: DataFrame, max_train_rows: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row, by a model of the rows not held out."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, train(docs, max_train_rows)).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, lift: float = 1.1, max_train_rows: int = 1000) -> DataFrame:
    """``docs`` whose language is known: not ``und``, and with a score ``lift`` times that of chance or more."""
    model = train(docs, max_train_rows)
    found = identify(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), model, "_text")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") * max(1, len(model.langs)) >= lift)).select("_row.*")
