"""Account lookup: subject resolution, fuzzy resolution, maintenance and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.functions.accounts import account_key, normalize_account
from abaculus.operators.sizes import broadcast_if_small

#: Accounts in a block of the fuzzy lookup; a tile compares two blocks.
BLOCK = 256
#: Accounts of these lengths are met by keys for up to so many edits first. From seven characters on, a candidate with fewer
#: edits always scores higher; longer accounts than the last would have many keys.
KEYED, KEYED_EDITS = (7, 32), 2


def best_entries(lookup: DataFrame) -> DataFrame:
    """One entry per account key: the highest priority, then the first row."""
    rank = F.row_number().over(Window.partitionBy("account_key").orderBy(F.desc("priority"), "row_id"))
    return lookup.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def resolve(df: DataFrame, lookup: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the lookup's subject of its account (null if none) and extra fields as columns."""
    entries = best_entries(lookup).select("account_key", F.col("subject").alias("found_subject"), *[F.element_at("extra", F.lit(e)).alias(e) for e in extras])
    keyed = df.withColumn("account_key", account_key(F.col("account")))
    return keyed.join(broadcast_if_small(entries), "account_key", "left")


def _blocks(df: DataFrame, length: str, sizes: DataFrame) -> DataFrame:
    """Rows of ``df`` packed by length: (length, block, items), of about BLOCK items each."""
    placed = df.join(F.broadcast(sizes), length).withColumn("block", F.pmod(F.xxhash64(df.columns[0]), F.col("blocks")).cast("int"))
    return placed.groupBy(length, "block").agg(F.collect_list(F.struct(*[c for c in df.columns if c != length])).alias("items"))


def _edited(texts: Column, mark: str) -> Column:
    """The texts with a character replaced by ``mark`` (or left out), at every place."""
    at = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.lit(mark), F.substr(t, i + 1)))
    return F.array_distinct(F.flatten(F.transform(texts, at)))


def _keys(df: DataFrame, text: str, edits: int, ours: bool) -> DataFrame:
    """``df`` (with la, lb) and the keys by which texts at most ``edits`` apart meet: both without the characters that only
    they have, and with a mark at the places where they differ. Keys are hashed; what meets is compared."""
    gap, found = F.col("lb") - F.col("la"), F.array().cast("array<bigint>")
    for away in range(edits + 1):  # characters left out of our text
        for gained in range(edits - away + 1):  # and of the other
            texts = F.array(F.col(text))
            for _ in range(away if ours else gained):
                texts = _edited(texts, "")
            for _ in range(edits - away - gained):
                texts = _edited(texts, "\u0001")
            kind = F.lit(away * 100 + gained)
            hashed = F.transform(texts, lambda t: F.xxhash64("la", "lb", kind, t))  # noqa: B023  called at once
            found = F.concat(found, F.when(gap == gained - away, hashed).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("key", F.explode(F.array_distinct(found)))


def _best_scored(scored: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("candidate", "score"), F.struct((-F.col("score")).alias("s"), "row_id"))
    return scored.groupBy("account").agg(first.alias("first")).select("account", "first.candidate", "first.score")


def fuzzy_accounts(accounts: DataFrame, lookup: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The most similar lookup account of each distinct unmatched account, where similar enough.

    Accounts of common lengths first meet candidates one edit away, those without any then candidates two edits away, by
    keys: no pair that near is missed, and what meets grows with the accounts and not with their square. Only for accounts
    that are left and may be further away, edits may change so much that no part of them is selective. There both sides are
    packed into blocks of accounts of one length, and a tile holds a block of either side, for the lengths that can be near
    enough. A tile is one row: inside it the edit distance is taken with the bound that the lengths give (so most comparisons
    end early), and only an account's best candidate of the tile leaves it. What is shuffled are tiles and bests, never pairs.
    """
    left = accounts.select(normalize_account(F.col("account")).alias("account")).where("account <> ''").distinct()
    keyed = left.withColumn("account_key", account_key(F.col("account")))
    left = keyed.join(lookup.select("account_key").distinct(), "account_key", "left_anti").select("account", F.length("account").alias("la")).checkpoint()
    right = lookup.groupBy(normalize_account(F.col("account")).alias("candidate")).agg(F.min("row_id").alias("row_id")).where("candidate <> ''")
    right = right.withColumn("lb", F.length("candidate")).checkpoint()
    edits = F.floor(F.greatest("la", "lb") * (1 - threshold) + 1e-6).cast("int")
    score = lambda d: F.round(1 - d / F.greatest("la", "lb"), 6)

    lengths = left.groupBy("la").count().select("la").join(F.broadcast(right.groupBy("lb").count().select("lb")), F.abs(F.col("la") - F.col("lb")) <= edits)
    lengths, found = lengths.checkpoint(), None  # a row for each two lengths
    for k in range(1, KEYED_EDITS + 1):
        near = F.broadcast(lengths.where(F.col("la").between(*KEYED) & (F.abs(F.col("la") - F.col("lb")) <= k) & ((edits >= k) | F.lit(k == 1))))
        met = _keys(left.join(near, "la"), "account", k, True).join(_keys(right.join(near, "lb"), "candidate", k, False), ["la", "lb", "key"])
        apart = met.withColumn("d", F.call_function("levenshtein", F.col("account"), F.col("candidate"), F.least(edits, F.lit(k)))).where("d >= 0")
        best = _best_scored(apart.select("account", "candidate", "row_id", score(F.col("d")).alias("score")).where(F.col("score") >= threshold)).checkpoint()
        found = best if found is None else found.unionByName(best)
        left = left.join(best, "account", "left_anti").checkpoint()

    far = lengths.where((edits > KEYED_EDITS) | ~F.col("la").between(*KEYED))
    if far.isEmpty():
        return found
    sizes = lambda df, c: df.groupBy(c).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # noqa: E731  a row per length
    of_left, of_right = sizes(left, "la"), sizes(right, "lb")
    near = F.broadcast(far.join(of_left.withColumnRenamed("blocks", "left_blocks"), "la").join(of_right.withColumnRenamed("blocks", "right_blocks"), "lb"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = _blocks(left, "la", of_left).join(near, "la").select("la", "lb", F.col("block").alias("i"), upto("right_blocks").alias("j"), F.col("items").alias("ours"))
    b = _blocks(right, "lb", of_right).join(near, "lb").select("la", "lb", upto("left_blocks").alias("i"), F.col("block").alias("j"), F.col("items").alias("theirs"))
    tiles = a.join(b, ["la", "lb", "i", "j"]).withColumn("k", edits)

    def best(x: Column) -> Column:
        distances = F.transform("theirs", lambda y: F.struct(F.call_function("levenshtein", x["account"], y["candidate"], F.col("k")).alias("d"), y["row_id"].alias("row_id"), y["candidate"].alias("candidate")))
        return F.struct(x["account"].alias("account"), F.array_min(F.filter(distances, lambda e: e["d"] >= 0)).alias("best"))

    tiled = tiles.select("la", "lb", F.explode(F.transform("ours", best)).alias("f")).where("f.best is not null")
    scored = tiled.select("f.account", "f.best.candidate", "f.best.row_id", score(F.col("f.best.d")).alias("score")).where(F.col("score") >= threshold)
    return found.unionByName(_best_scored(scored))


def add_entries(lookup: DataFrame, new: DataFrame) -> DataFrame:
    """Lookup with those new entries whose key is not taken yet."""
    return lookup.unionByName(new.join(lookup.select("account_key").distinct(), "account_key", "left_anti").select(*lookup.columns))


def update_entries(lookup: DataFrame, changes: DataFrame) -> DataFrame:
    """Lookup with subject and priority of changed keys replaced where given."""
    c = changes.select("account_key", F.col("subject").alias("_subject"), F.col("priority").alias("_priority"))
    return lookup.join(c, "account_key", "left").withColumns({"subject": F.coalesce("_subject", "subject"), "priority": F.coalesce("_priority", "priority")}).select(*lookup.columns)


def delete_entries(lookup: DataFrame, keys: DataFrame) -> DataFrame:
    """Lookup without any row of the keys."""
    return lookup.join(keys.select("account_key").distinct(), "account_key", "left_anti").select(*lookup.columns)


def import_entries(lookup: DataFrame, new: DataFrame) -> DataFrame:
    """Every key of either side with its entry after the import and what happened: insert, update, skip or keep."""
    old = best_entries(lookup).select("account_key", F.struct("subject", "priority", F.to_json("extra").alias("extra")).alias("old"))
    add = best_entries(new).select("account_key", F.struct("subject", "priority", F.to_json("extra").alias("extra")).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old").eqNullSafe(F.col("new")), "skip").otherwise("update")
    return old.join(add, "account_key", "full_outer").select("account_key", action.alias("action"), F.coalesce("new.subject", "old.subject").alias("subject"), F.coalesce("new.priority", "old.priority").alias("priority"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(account_key, change, field, old_value, new_value) between two lookups, blind to outer blanks."""
    side = lambda df, p: best_entries(df).select("account_key", *[F.trim(F.col(c).cast("string")).alias(f"{p}_{c}") for c in ("subject", "priority")], F.lit(True).alias(f"in_{p}"))
    both = side(old, "old").join(side(new, "new"), "account_key", "full_outer")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f"new_{f}").alias("new_value")) for f in ("subject", "priority")])
    change = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "remove").otherwise("modify")
    rows = both.select("account_key", change.alias("change"), F.inline(fields))
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
