"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text is a list of words. Of the hashes of its 5-word grams the smallest of
each 6 neighbours is a fingerprint, so two texts that share 10 words in a row
share a fingerprint. Documents with a fingerprint of the benchmark are then
extended: all their 10-word windows are compared, as text, with the items'
windows. Items of fewer than 10 words are one window of their own length, found
by the hash of that whole window.

The word lists stay arrays inside a row, so only fingerprints and windows of
hit documents are ever exploded. The benchmark's side is broadcast only when its
counted rows are within ``BROADCAST_ROWS``; beyond it the joins shuffle.

Defined results: a null or empty text has no words and no hits; repeated rows
(same id, same text) give one row; an item without words never occurs; null
item ids are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace, broadcast_if_small, lower_az, without_ids

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
NEIGHBOURS = WINDOW - GRAM + 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_hashes(ws: Column, k: int) -> Column:
    """xxhash64 of every ``k`` consecutive words; empty with fewer words."""
    starts = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[ws[i + j] for j in range(k)]))


def fingerprints(grams: Column) -> Column:
    """The smallest hash of each ``NEIGHBOURS`` consecutive grams."""
    starts = F.when(F.size(grams) >= NEIGHBOURS, F.sequence(F.lit(1), F.size(grams) - (NEIGHBOURS - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, NEIGHBOURS))))


def windows(ws: Column, n: int) -> Column:
    """(pos, len, win) of every ``n`` consecutive words."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(ws, i + 1, n), " ").alias("win")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the items, per document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = ws.write(benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0), "items")
    short = sorted(r[0] for r in items.select(F.size("w").alias("n")).where(F.col("n") < WINDOW).distinct().collect())  # at most nine lengths
    sizes = [WINDOW, *short]
    item_windows = items.where(F.size("w") >= WINDOW).select("item", F.inline(windows(F.col("w"), WINDOW)))
    for n in short:
        item_windows = item_windows.unionByName(items.where(F.size("w") == n).select("item", F.inline(windows(F.col("w"), n))))
    item_windows = ws.write(item_windows.groupBy("win").agg(F.collect_set("item").alias("items")), "item_windows")
    long_marks = items.where(F.size("w") >= WINDOW).select("item", gram_hashes(F.col("w"), GRAM).alias("g")).select(F.explode(fingerprints(F.col("g"))).alias("mark"))
    marks = long_marks
    for n in short:
        marks = marks.unionByName(items.where(F.size("w") == n).select(F.explode(gram_hashes(F.col("w"), n)).alias("mark")))
    marks = ws.write(marks.distinct(), "marks")

    key = ["doc_id", "text_hash"]
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    graded = texts.select(*key, F.size("w").alias("n_words"), F.when(F.size("w") >= WINDOW, gram_hashes(F.col("w"), GRAM)).otherwise(F.array().cast("array<bigint>")).alias("g"), *[gram_hashes(F.col("w"), n).alias(f"s{n}") for n in short])
    seen = F.concat(fingerprints(F.col("g")), *[F.array_distinct(f"s{n}") for n in short])
    found = (
        graded.select(*key, "n_words", F.explode_outer(seen).alias("mark"))
        .join(broadcast_if_small(marks.withColumn("hit", F.lit(1))), "mark", "left")
        .groupBy(*key)
        .agg(F.max("n_words").alias("n_words"), F.max("hit").alias("hit"))
    )
    found = ws.write(found, "found")

    hit = found.where("hit = 1").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    near = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(broadcast_if_small(hit), same, "left_semi").select(*key, words(F.col("text")).alias("w"))
    spans = near.select(*key, F.inline(F.concat(*[windows(F.col("w"), n) for n in sizes])))
    spans = spans.join(broadcast_if_small(item_windows), "win").select(*key, "pos", (F.col("pos") + F.col("len")).alias("end"), "items")
    order = Window.partitionBy(*key).orderBy("pos", "end")
    covered = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = (
        spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("pos", covered)))
        .groupBy(*key)
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    hits = hits.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")
    joined = found.join(hits, same, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("items", none).alias("items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents."""
    return without_ids(docs, decontaminate(docs, benchmark).where("contaminated").select("doc_id").distinct())
