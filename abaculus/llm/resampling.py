"""Importance resampling towards a target distribution of hashed n-gram features.

Texts are lower-cased (A-Z) and cut into words by Arrow kernels (``ascii_lower``,
``split_pattern_regex``, ``list_flatten``); words are dictionary-encoded, so the runs of two
words are pairs of shifted dictionary indices, and only distinct words and distinct pairs get
a CRC. A first pass over both tables counts features per bucket (``BUCKETS`` counters a task,
then one sum per bucket); these give each bucket its gain, the log-ratio of the smoothed shares
in the target and in the documents. A second pass takes the gains by bucket and reduces them by
document. Weight plus Gumbel noise, seeded by the document's id, makes the draw a sampling
without replacement in proportion to the weights; the highest scores are found and ranked by
``operators.numbering``, a range-partitioned sort with prefix sums, as the draw grows with the table.

Only the counts per bucket (a fixed number) go through the driver. Texts are worked on in slices
cut between words, so memory doesn't follow the length of a text.

Defined results: null or empty texts have no features and weight 0. Repeated rows count and are
drawn each by themselves (rows that tie in score and id get any order among them). A null id
gives null score and rank, and its row isn't drawn, but its features count. Extra columns are ignored.
An empty target or empty documents leave the smoothed shares as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.llm.shared import prepare_workers
from abaculus.operators.numbering import numbered

BUCKETS, SCALE = 10_000, 1000
DRAW_PERCENT, LEAST_WORDS, SEED = 25, 20, 7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of text that a step of the kernels takes at least; a longer text is cut at the next separators.
SLICE = 1 << 20

_AFTER_LOWER = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _slices(texts: pa.Array) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """(rows, pieces of text, whether the piece repeats the row's last word) in steps of about SLICE characters."""
    rows: list[int] = []
    pieces: list[str] = []
    goes_on: list[bool] = []
    held = 0
    for row, value in enumerate(texts):
        text, start, first = value.as_py() or "", 0, False
        while True:
            if held >= SLICE:
                yield rows, pieces, goes_on
                rows, pieces, goes_on, held = [], [], [], 0
            cut = _AFTER_LOWER.search(text, start + SLICE) if len(text) - start > SLICE else None
            piece = text[start : cut.start()] if cut else text[start:]
            if first:
                piece = f"{first} {piece}"
            rows.append(row), pieces.append(piece), goes_on.append(bool(first))
            held += len(piece)
            if not cut:
                break
            words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", piece)
            first, start = words[-1] if words else "", cut.start()
    if rows:
        yield rows, pieces, goes_on


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the text, bucket) of the features of ``texts``, slice by slice."""
    for rows, pieces, goes_on in _slices(texts):
        lists = pc.split_pattern_regex(pc.ascii_lower(pa.array(pieces, pa.string())), SEPARATORS)
        words, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(words), 0)
        words, parent = words.filter(full), parent.filter(full).to_numpy()
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        vocabulary = [w.encode() for w in coded.dictionary.to_pylist()]
        crc = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary))
        row = np.asarray(rows, np.int64)[parent]
        start = np.ones(len(at), bool)
        start[1:] = parent[1:] != parent[:-1]
        counted = ~(start & np.asarray(goes_on, bool)[parent])  # the word before a cut was counted before it
        yield row[counted], crc[at[counted]] % BUCKETS
        follows = ~start[1:]
        pairs = pa.array(at[:-1][follows] * max(len(vocabulary), 1) + at[1:][follows]).dictionary_encode()
        first, second = np.divmod(pairs.dictionary.to_numpy(), max(len(vocabulary), 1))
        spaced = [b" " + w for w in vocabulary]
        joined = np.fromiter((zlib.crc32(spaced[b], a) for a, b in zip(crc[first].tolist(), second.tolist(), strict=True)), np.int64, len(first))
        yield row[1:][follows], pc.take(pa.array(joined % BUCKETS), pairs.indices).to_numpy()


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of ``texts``; a task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(target: dict[int, int], source: dict[int, int]) -> np.ndarray:
    """The gain of each bucket: floor(1000 * ln of (share in the target / share in the source)), both smoothed by one per bucket."""
    of_target, of_source = float(sum(target.values())), float(sum(source.values()))
    gain = lambda b: math.floor(SCALE * math.log((target.get(b, 0) + 1.0) * (of_source + BUCKETS) / ((source.get(b, 0) + 1.0) * (of_target + BUCKETS))))
    return np.fromiter(map(gain, range(BUCKETS)), np.int64, BUCKETS)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_features, weight): the floored mean of the gains of a document's features."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, bucket in features(batch.column(1)):
                if len(row):
                    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # rows stand in order
                    n[row[starts]] += np.diff(np.r_[starts, len(row)])
                    total[row[starts]] += np.add.reduceat(gains.take(bucket), starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(reduce, "doc_id long, n_features long, weight long")


def noisy_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with score: weight plus Gumbel noise from the sha256 of seed and id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document as (doc_id, n_features, weight, score, rank): of the N with ``least_words`` words or more
    floor(percent * N / 100) are drawn, the highest scores first, ties to smaller ids; rank is null for others."""
    prepare_workers(docs.sparkSession)
    counts = lambda df: {r.bucket: r.n for r in bucket_counts(df).collect()}  # noqa: E731  BUCKETS rows at most
    gains = bucket_gains(counts(target), counts(docs))
    scored = noisy_scores(weigh(docs, gains), seed).checkpoint()
    enough = (F.col("n_features") >= 2 * least_words - 1) & F.col("doc_id").isNotNull()  # n words make 2n - 1 features
    drawn = scored.where(enough).count() * percent // 100
    ranked = numbered(scored.where(enough), [F.col("score").desc(), F.col("doc_id")], "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")
