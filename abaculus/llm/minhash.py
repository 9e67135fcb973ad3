"""Near-duplicate detection with HyperMinHash sketches.

Texts are lower-cased (A-Z), cut into words and taken as sets of 64-bit hashes of
five-word shingles. A sketch has ``BUCKETS`` registers. The top bits of a hash
pick its bucket; of the smallest remainder in a bucket the register stores the
count of leading zeros and ``MANTISSA`` further bits. Empty buckets copy another
bucket along a fixed permutation (so small sets fill their sketch too). The
registers are banded, documents that share a band are candidates, and those
whose estimated Jaccard similarity (corrected for register collisions) could
reach the threshold are verified on their full shingle sets.

Skew: equal shingle sets are first reduced to their smallest id by an aggregate
with partial sums, so copies never meet in a bucket. Buckets are resolved by
``grouping.group``, which links the members of a large one to a few centres per
round instead of making all its pairs, and yet leaves no pair undecided: shingles
that few documents of large buckets hold pair these, and bound all other similarities.

Defined results: null or empty texts have an empty set and stand alone; with
fewer than five words the whole sequence is one shingle; repeated rows (same id)
give one row each; null ids are left out of linking and stand alone; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.llm.grouping import group, shared_buckets
from abaculus.llm.shared import Workspace, broadcast_if_small, give_back, prepare_workers, without_ids

BUCKETS, BANDS, ROWS, MANTISSA = 128, 25, 5, 10
SHINGLE = 5
SCARCE = 12  # texts that may hold a shingle for it to count as scarce in large buckets
MEMO_WORDS = 100_000


class _Words(dict):
    """Hashes of words; forgets all of them when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_memo = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_memo.__getitem__, ws), np.uint64, len(ws))
    k = min(SHINGLE, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(total)])
    return np.unique(total)


_BOUNDS = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)
_DETOUR = np.array([np.random.default_rng(b).permutation(BUCKETS) for b in range(BUCKETS)])  # where an empty bucket looks, in order


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers (leading zeros << MANTISSA | mantissa) of a non-empty sorted set."""
    first = np.searchsorted(hashes, _BOUNDS)
    full = np.zeros(BUCKETS, bool)
    inside = first < len(hashes)
    full[inside] = (hashes[first[inside]] >> np.uint64(57)) == np.flatnonzero(inside).astype(np.uint64)
    rest = hashes[np.minimum(first, len(hashes) - 1)] & np.uint64((1 << 57) - 1)
    zeros = 57 - np.frexp(rest.astype(np.float64))[1]
    zeros = np.minimum(zeros, 57 - MANTISSA - 1)
    mantissa = (rest >> (np.uint64(57 - MANTISSA - 1) - zeros.astype(np.uint64))) & np.uint64((1 << MANTISSA) - 1)
    out = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        look = _DETOUR[empty]
        source = look[np.arange(len(empty)), full[look].argmax(1)]
        out[empty] = out[source]
    return out


def bands(regs: np.ndarray) -> list[int]:
    """One 64-bit key per band of ROWS registers."""
    rows = regs[: BANDS * ROWS].reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(rows[b].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)]


NIBBLES = 0x1111111111111111


def code(regs: np.ndarray) -> list[int]:
    """Four mixed bits of every register, sixteen to a 64-bit word: a sketch of 64 bytes for comparing inside joins."""
    four = ((regs * np.uint16(0x9E35)) >> np.uint16(12)).astype(np.uint64).reshape(-1, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64).tolist()


def likely(threshold: float, a: Column, b: Column) -> Column:
    """Whether two sketches (n, code) allow the threshold: sizes, and registers whose four bits differ.

    Registers of different minima agree in four bits by chance with 1/16; the margin is five standard deviations.
    """
    differ = F.lit(0)
    for i in range(BUCKETS // 16):
        x = a["code"][i].bitwiseXOR(b["code"][i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(NIBBLES))
        differ = differ + F.bit_count(x)
    agree = threshold + (1 - threshold) / 16
    most = BUCKETS * (1 - agree) + 5 * (BUCKETS * agree * (1 - agree)) ** 0.5
    return (F.least(a["n"], b["n"]) >= threshold * F.greatest(a["n"], b["n"]) - 1e-9) & (differ <= int(most) + 1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of paired sketches (n x BUCKETS), less the share of registers that agree by chance.

    Two different minima agree in a register when leading zeros and mantissa
    coincide: sum over z of (2^-(z+1))^2 * 2^-MANTISSA, about a third of 2^-MANTISSA.
    """
    same = (a == b).mean(1)
    chance = 2.0**-MANTISSA / 3
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the hash of the whole set, the registers and the band keys of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingles(text)
                if len(s):
                    r = registers(s)
                    out.append((doc_id, len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), r.tobytes(), bands(r), code(r)))
                else:
                    out.append((doc_id, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_hash", "regs", "bands", "code"]).astype({"doc_id": "Int64"})
        give_back()
        _memo.clear()

    prepare_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_shingles long, set_hash string, regs binary, bands array<long>, code array<long>")


def plausible(threshold: float) -> Column:
    """Whether a candidate pair's sizes and sketches (n_a, n_b, regs_a, regs_b) allow the threshold.

    The margin is five standard deviations of the estimate at the threshold.
    """
    margin = 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        regs = [np.frombuffer(b"".join(x), np.uint16).reshape(len(x), BUCKETS) for x in (a, b)]
        return pd.Series(estimate(*regs) >= threshold - margin)

    fits = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    return F.when(fits, near(F.col("regs_a"), F.col("regs_b"))).otherwise(False)


def similar(percent: int) -> Column:
    """Whether 100 * intersection >= percent * union, on the full shingle sets of text_a and text_b."""

    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, right = [], None, np.zeros(0, np.uint64)
        for x, y in zip(a, b):
            if y is not last and y != last:  # rows of one centre follow one another
                last, right = y, shingles(y)
            left = shingles(x)
            both = len(np.intersect1d(left, right, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
        return pd.Series(out, dtype=bool)

    return check(F.col("text_a"), F.col("text_b"))


def scarce_shingles(ws: Workspace, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (node, text): (node, own), how many shingles each has that ``SCARCE`` texts or fewer hold (none: left out),
    and (a, b), all pairs that may reach ``percent`` and share such a shingle.

    Such a pair shares one among the rarest shingles of both: their first ones by (texts, hash), so many that
    a text without them all is below the threshold (prefix filter). Others need not be joined.
    """

    @F.pandas_udf("array<long>")
    def hashes(batch: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in batch])

    sets = texts.select("node", hashes("text").alias("shingles"))
    held = ws.write(sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "held")
    few = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") <= SCARCE)
    rare = ws.write(held.join(few, "shingle"), "scarce")
    place = F.row_number().over(Window.partitionBy("node").orderBy("texts", "shingle"))
    first = rare.withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100) + 1).where("texts > 1").select("node", "shingle")
    pairs = first.withColumnRenamed("node", "a").join(first.withColumnRenamed("node", "b"), "shingle").where("a < b").select("a", "b").distinct()
    return rare.groupBy("node").agg(F.count(F.lit(1)).alias("own")), pairs


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    rows = ws.write(sketches(docs), "sketches")
    classes = rows.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes = ws.write(classes, "classes")
    reps = rows.join(classes.withColumnRenamed("rep", "doc_id").drop("set_hash"), "doc_id", "left_semi").where("set_hash is not null")
    reps = ws.write(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "regs", "bands", "code").dropDuplicates(["rep"]), "reps")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
        pairs = ws.write(pairs.join(side("a"), "a").join(side("b"), "b").where(plausible(percent / 100)).select("a", "b"), f"pairs-{name}")
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        texts = ws.write(texts, f"texts-{name}")
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        found = ws.write(both.select("a", "b", similar(percent).alias("linked")), f"found-{name}")
        ws.drop(f"texts-{name}")
        return found

    def scarce(crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
        texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(broadcast_if_small(crowd), "node", "left_semi").dropDuplicates(["node"])
        return scarce_shingles(ws, texts, percent)

    def bound(n: Column, own: Column, other_n: Column, other_own: Column) -> Column:
        common = n - own  # at most; the other set holds these and its own scarce ones
        return 100 * common >= percent * (own + F.greatest(other_n, common + other_own))

    def first_met(a: Column, b: Column, place: Column) -> Column:
        earlier = F.lit(False)  # whether the pair shares a band before this one
        for k in range(BANDS - 1):
            earlier = earlier | ((place > k) & (a["bands"][k] == b["bands"][k]))
        return likely(percent / 100, a, b) & ~earlier

    members = shared_buckets(ws, reps.select(F.col("rep").alias("node"), F.posexplode("bands").alias("place", "bucket")))
    nodes = reps.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), F.struct(F.col("n_shingles").alias("n"), "code", "bands").alias("sketch"))
    labels = group(ws, nodes, members, first_met, verify, scarce, bound)
    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(of_class, "set_hash", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce(F.coalesce("comp", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document (the smallest id) of each near-duplicate group."""
    return without_ids(docs, near_duplicates(docs, percent).where("not kept").select("doc_id"))
