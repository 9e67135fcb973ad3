"""Hard-negative mining by inner product, with segment summaries that bound scores.

Vectors are cut into segments (``SEGMENTS`` of them, coarse to fine). Of each segment its mean and
deviation are stored; the product of two means, plus or minus the product of the deviations (times
the segment's length), bounds the segment's share of the inner product. A pair whose bounds can't
reach what an anchor still looks for is ruled out at the coarsest level that shows it, the pairs
left are refined level by level, and only the last of them are scored exactly.

The anchors are a stated query set and meet all rows in blocks: rows and anchors are packed into
blocks of bounded bytes, every block of rows meets every block of anchors (broadcast while counted
small, else a product of stored blocks), and a task keeps the best few rows of each anchor it met
as its running threshold. It sends only these on, and one ranking per anchor joins what the tasks
found. A first round finds positives, a second the negatives of each positive's window of scores.
Of equal vectors with one label in a block only as many of the smallest ids as can be asked for
are compared with the anchors: the others tie with these and have larger ids.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no
part; of rows with one id that with the smallest label, then vector, counts. Shorter vectors count
as filled up with zeros. Components are floor(scale * x). Scores are exact below 2^53; beyond, they carry the
rounding of doubles and stay in the range of long. An anchor without positives or negatives has no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace, prepare_workers, small

SCALE = 256
ANCHOR_EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
SEGMENTS = (1, 4, 16)
#: Bounds of a block: vectors, and bytes of its matrix.
BLOCK_ROWS, BLOCK_BYTES = 2048, 2 << 20
#: With fewer pairs left than this share, pairs are taken one by one instead of as a whole product of matrices.
FEW = 0.05

BLOCK = "block long, dim int, ids binary, labels binary, matrix binary, summaries binary, lo binary, hi binary"


def _summaries(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) per level, each by segment and times the root of the segment's length."""
    out = []
    for n in SEGMENTS:
        edges = np.unique(np.linspace(0, matrix.shape[1], n + 1).astype(int))
        length = np.diff(edges).astype(float)
        mean = np.add.reduceat(matrix, edges[:-1], axis=1) / length
        spread = matrix - np.repeat(mean, np.diff(edges), axis=1)
        deviation = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1) / length)
        out.append((mean * np.sqrt(length), deviation * np.sqrt(length)))
    return out


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        packed, at, levels = np.frombuffer(row["summaries"], float), 0, []
        for n in SEGMENTS:
            size = len(ids) * (len(np.unique(np.linspace(0, row["dim"], n + 1).astype(int))) - 1)
            levels.append((packed[at : at + size].reshape(len(ids), -1), packed[at + size : at + 2 * size].reshape(len(ids), -1)))
            at += 2 * size
        window = lambda c: np.frombuffer(row[c], float).reshape(len(ids), -1)
        return cls(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["matrix"], float).reshape(len(ids), -1), levels, window("lo"), window("hi"))

    def take(self, at: np.ndarray) -> Block:
        return Block(self.ids[at], self.labels[at], self.matrix[at], [(m[at], d[at]) for m, d in self.levels], self.lo[at], self.hi[at])


def _pack(vectors: DataFrame, dim: int, twins: int | None = None, windows: int = 0) -> DataFrame:
    """Blocks of (id, label, vec) rows and, for anchors with windows, of their lo and hi arrays; ``twins`` equal rows stay."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                vec = part.column(2)
                size = np.diff(vec.offsets.to_numpy())
                matrix = np.zeros((len(vec), dim))
                matrix[np.arange(dim) < size[:, None]] = np.floor(SCALE * vec.flatten().to_numpy().astype(float))
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                keep = np.arange(len(ids))
                if twins:
                    keep = np.lexsort((ids, labels))
                    _, group = np.unique(np.ascontiguousarray(np.c_[labels, matrix][keep]).view(f"V{8 * (dim + 1)}").ravel(), return_inverse=True)
                    by = np.argsort(group, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(group[by]) != 0])
                    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
                    keep = np.sort(keep[by[rank < twins]])
                matrix = matrix[keep]
                lo, hi = (np.ascontiguousarray(part.column(3 + n).flatten().to_numpy().reshape(-1, windows)[keep], float) for n in (0, 1)) if windows else (np.empty(0), np.empty(0))
                levels = np.concatenate([x.ravel() for pair in _summaries(matrix) for x in pair])
                row = {"block": int(ids.min()), "dim": dim, "ids": ids[keep].tobytes(), "labels": labels[keep].tobytes(), "matrix": matrix.tobytes(), "summaries": levels.tobytes(), "lo": lo.tobytes(), "hi": hi.tobytes()}
                yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    return vectors.mapInArrow(pack, BLOCK)


_SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "matrix", "summaries", "lo", "hi")]])


class Best:
    """The best ``k`` (score, id) of each slot; higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.score, self.id = np.full((slots, k), -np.inf), np.zeros((slots, k), np.int64)

    def least(self) -> np.ndarray:
        """What a further score has to reach, by slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k, touched = self.score.shape[1], np.unique(slot)
        slot, score, ids = np.r_[slot, np.repeat(touched, k)], np.r_[score, self.score[touched].ravel()], np.r_[ids, self.id[touched].ravel()]
        by = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[by], score[by], ids[by]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        top = rank < k
        self.score[slot[top], rank[top]], self.id[slot[top], rank[top]] = score[top], ids[top]


def scored(rows: Block, anchors: Block, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Exact scores (rows by anchors) of the pairs of ``alive`` that may lie from ``least`` to ``most`` of their anchor; -inf elsewhere."""
    out = np.full(alive.shape, -np.inf)
    for (mean_r, dev_r), (mean_a, dev_a) in zip(rows.levels, anchors.levels, strict=True):
        left = np.count_nonzero(alive)
        if not left:
            return out
        if left > FEW * alive.size:
            middle, reach = mean_r @ mean_a.T, dev_r @ dev_a.T
            reach += 1 + 1e-9 * (np.abs(middle) + reach)  # more than rounding
            alive = alive & (middle + reach >= least) & (middle - reach <= most)
        else:
            r, a = np.nonzero(alive)
            middle, reach = np.einsum("ij,ij->i", mean_r[r], mean_a[a]), np.einsum("ij,ij->i", dev_r[r], dev_a[a])
            reach += 1 + 1e-9 * (np.abs(middle) + reach)
            out_of = (middle + reach < least[a]) | (middle - reach > most[a])
            alive = alive.copy()
            alive[r[out_of], a[out_of]] = False
    if np.count_nonzero(alive) > FEW * alive.size:
        exact = rows.matrix @ anchors.matrix.T
        out[alive] = exact[alive]
    else:
        r, a = np.nonzero(alive)
        step = max(1, BLOCK_BYTES // (8 * rows.matrix.shape[1]))
        for at in range(0, len(r), step):
            s = slice(at, at + step)
            out[r[s], a[s]] = np.einsum("ij,ij->i", rows.matrix[r[s]], anchors.matrix[a[s]])
    edge = float(2**63 - 1024)
    return np.where(alive, np.clip(np.nan_to_num(out, nan=0.0, posinf=edge, neginf=-edge), -edge, edge), -np.inf)


def _offer(best: Best, slots: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
    """Give ``best`` the scores (rows by slots) that can still be among the best of their slot."""
    k = best.score.shape[1]
    least = best.least()[slots]
    hopeful = (score >= least) & (score > -np.inf)
    if np.count_nonzero(hopeful) > 8 * k * len(slots) and len(ids) > k:
        least = np.maximum(least, np.partition(score, len(ids) - k, axis=0)[len(ids) - k])
        hopeful = (score >= least) & (score > -np.inf)
    r, a = np.nonzero(hopeful)
    best.add(slots[a], score[r, a], ids[r])


def _offer_positives(rows: Block, anchors: Block, best: Best) -> None:
    for label in np.intersect1d(rows.labels, anchors.labels):
        r, a = rows.take(np.flatnonzero(rows.labels == label)), np.flatnonzero(anchors.labels == label)
        of = anchors.take(a)
        score = scored(r, of, r.ids[:, None] != of.ids, best.least()[a], np.full(len(a), np.inf))
        _offer(best, a, r.ids, score)


def _offer_negatives(rows: Block, anchors: Block, best: Best) -> None:
    n, w = anchors.lo.shape
    need = np.maximum(anchors.lo, best.least().reshape(n, w))
    score = scored(rows, anchors, rows.labels[:, None] != anchors.labels, need.min(axis=1), anchors.hi.max(axis=1))
    for i in range(w):
        inside = (score >= anchors.lo[:, i]) & (score <= anchors.hi[:, i])
        _offer(best, np.arange(n) * w + i, rows.ids, np.where(inside, score, -np.inf))


def _search(rows: DataFrame, anchors: DataFrame, offer: Callable[[Block, Block, Best], None], slots: int, k: int) -> DataFrame:
    """(anchor_id, slot, score, id): the best ``k`` per task, anchor and slot of every block of rows against every block of anchors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.slice(i, 1).to_pylist()[0]
                of_rows, of_anchors = Block.read({k[2:]: v for k, v in pair.items() if k.startswith("r_")}), Block.read({k[2:]: v for k, v in pair.items() if k.startswith("a_")})
                ids, best = state.setdefault(pair["a_block"], (of_anchors.ids, Best(len(of_anchors.ids) * slots, k)))
                offer(of_rows, of_anchors, best)
        for ids, best in state.values():
            slot, at = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[slot // slots].copy()), pa.array((slot % slots).astype(np.int32)), pa.array(best.score[slot, at].astype(np.int64)), pa.array(best.id[slot, at])], ["anchor_id", "slot", "score", "id"])

    held = F.broadcast(anchors) if small(anchors) else anchors
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return named(rows, "r").crossJoin(named(held, "a")).mapInArrow(search, "anchor_id long, slot int, score long, id long")


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vec) of the rows that take part, one per id."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(~odd)
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if repeated.isEmpty():
        return rows
    one = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("first")).select("id", "first.label", "first.vec")
    return rows.join(repeated, "id", "left_anti").select("id", "label", "vec").union(one)


def hard_negatives(embeddings: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **names: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id`` and ``label``. An anchor's positives are its ``positives`` best other rows of its
    label; to each belong the ``negatives`` best rows of other labels with a score from ``low`` to ``high`` percent of its own.
    """
    spark = embeddings.sparkSession
    prepare_workers(spark)
    ws = Workspace(spark, "hard-negatives")
    is_anchor = (F.col("id") % ANCHOR_EVERY == 0) if is_anchor is None else is_anchor
    rows = usable(embeddings, **names)
    dim = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 1)
    blocks = ws.write(_pack(rows, dim, twins=max(positives, negatives) + 1), "rows")
    chosen = ws.write(rows.where(is_anchor), "anchors")
    parts = -(-chosen.count() // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))) or 1

    # round one: a label's best rows
    anchors = ws.write(_pack(chosen.repartition(parts), dim), "anchor-blocks")
    by_score = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")
    found = _search(blocks, anchors, _offer_positives, 1, positives).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= positives)
    best = ws.write(found.select("anchor_id", (F.col("n") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # round two: the windows of scores below them; an anchor with fewer positives has empty windows
    at_least, at_most = F.ceil(F.col("positive_score") * low / F.lit(100)), F.floor(F.col("positive_score") * high / F.lit(100))
    asked = best.select("anchor_id", "slot", at_least.cast("double").alias("lo"), at_most.cast("double").alias("hi"))
    windows = asked.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("lo", "hi").alias("w")))).alias("w"))  # ``positives`` entries at most
    filled = lambda c, empty: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda s: F.coalesce(F.try_element_at("w", s)[c], F.lit(empty)))
    ranged = chosen.join(windows.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "vec", filled("lo", float("inf")).alias("lo"), filled("hi", float("-inf")).alias("hi"))
    searched = ws.write(_pack(ranged.repartition(parts), dim, windows=positives), "window-blocks")
    by_slot = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    found = _search(blocks, searched, _offer_negatives, positives, negatives).withColumn("rank", F.row_number().over(by_slot)).where(F.col("rank") <= negatives)
    return found.join(best, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
