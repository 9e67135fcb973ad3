"""Internal transfers: one-to-one pairs of an outgoing and an incoming leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidate_pairs(df: DataFrame, window_days: int = 7, tolerance: str = "0.01", strict: bool = True) -> DataFrame:
    """Pairs of legs of different subjects with like amounts and near dates.

    The legs meet on the pair of names and on a bucket of the amount as wide as the tolerance
    (the incoming leg stands in its own bucket and both neighbours), so the join stays an
    equi-join whose keys are nearly as selective as the amounts themselves.
    """
    width = F.lit(tolerance).cast("decimal(20,4)") * 2 + F.lit("0.0001").cast("decimal(20,4)")
    out = df.where("payment < 0 and subject is not null and trade_date is not null").select(
        F.col("txn_uid").alias("out_id"), F.col("subject").alias("out_subject"), F.col("counterparty").alias("out_party"), F.col("trade_date").alias("out_date"), F.abs("payment").alias("out_amount")
    )
    into = df.where("receipt > 0 and subject is not null and trade_date is not null").select(
        F.col("txn_uid").alias("in_id"), F.col("subject").alias("in_subject"), F.col("counterparty").alias("in_party"), F.col("trade_date").alias("in_date"), F.col("receipt").alias("in_amount")
    )
    out = out.withColumn("bucket", F.floor(F.col("out_amount") / width))
    into = into.withColumn("in_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("in_amount") / width) + i)))
    named_out, named_in = F.col("out_party") == F.col("in_subject"), F.col("in_party") == F.col("out_subject")
    if strict:
        pairs = out.join(into, (F.col("bucket") == F.col("in_bucket")) & named_out & named_in)
    else:  # either side names the other: two equi-joins, the second without what the first finds
        first = out.join(into, (F.col("bucket") == F.col("in_bucket")) & named_out)
        second = out.join(into, (F.col("bucket") == F.col("in_bucket")) & named_in).where(~F.coalesce(named_out, F.lit(False)))
        pairs = first.unionByName(second)
    days, gap = F.abs(F.datediff("in_date", "out_date")), F.abs(F.col("out_amount") - F.col("in_amount"))
    return pairs.where((F.col("out_subject") != F.col("in_subject")) & (gap <= F.lit(tolerance).cast("decimal(20,2)")) & (days <= window_days)).select("out_id", "in_id", "out_subject", "in_subject", "out_date", "in_date", "out_amount", "in_amount", days.alias("days"), gap.alias("gap"))


def _legs(df: DataFrame) -> DataFrame:
    """Both kinds of legs with their class: legs of equal names, date and amounts are one, named by its smallest id."""
    legs = df.where("(payment < 0 or receipt > 0) and subject is not null and trade_date is not null and txn_uid is not null").dropDuplicates(["txn_uid"])
    sides = F.explode(F.array_compact(F.array(F.when(F.col("payment") < 0, "out"), F.when(F.col("receipt") > 0, "in"))))
    legs = legs.select(F.col("txn_uid").alias("id"), sides.alias("side"), "subject", "counterparty", "trade_date", "payment", "receipt")
    legs = legs.withColumns({"payment": F.when(F.col("side") == "out", F.col("payment")), "receipt": F.when(F.col("side") == "in", F.col("receipt"))})
    names = Window.partitionBy("side", "subject", "counterparty", "trade_date", "payment", "receipt")
    return legs.withColumn("cls", F.min("id").over(names))


def internal_transfers(df: DataFrame, window_days: int = 7, tolerance: str = "0.01", strict: bool = True) -> DataFrame:
    """One-to-one pairs, taken best first by days, amount, outgoing date and ids, until no pair is left.

    Classes of equal legs meet instead of the legs. In each round the class pairs that are nearest for both
    sides settle: where one class is the only nearest of all those it is nearest to, their legs pair off by rank
    at once; else (ties across several classes) the first legs of the best class pair do. Either way
    the pairs are those that going through all pairs in order would give. A round has two small checkpoints.
    """
    legs = _legs(df).checkpoint()
    near = candidate_pairs(legs.where("id = cls").withColumnRenamed("id", "txn_uid"), window_days, tolerance, strict).withColumnsRenamed({"out_id": "a", "in_id": "b"}).checkpoint()
    paired_classes = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    legs = legs.select("side", "cls", "id").join(paired_classes, "cls", "left_semi").checkpoint()
    outs, ins = (legs.where(F.col("side") == side).select("cls", "id") for side in ("out", "in"))
    found = None
    while True:
        # what earlier rounds have paired leaves the legs
        left_out, left_in = (legs if found is None else legs.join(found.select(F.col(c).alias("id")), "id", "left_anti") for legs, c in ((outs, "out_id"), (ins, "in_id")))
        first = lambda legs, c: legs.groupBy(F.col("cls").alias(c)).agg(F.min("id").alias(f"first_{c}"))
        live = near.join(first(left_out, "a"), "a").join(first(left_in, "b"), "b")
        if found is not None and live.isEmpty():
            break
        # nearest for both sides; the number of classes that are as near for a and for b
        key, order = ["days", "gap", "out_date"], ["days", "gap", "out_date", "first_a", "first_b"]
        ranked = live
        # a star: all classes as near to its centre have the centre as their only nearest
        star = lambda c, other: F.min(F.when(F.col(f"near_{c}"), F.col(f"near_{other}") & (F.col(f"n_{other}") == 1))).over(Window.partitionBy(c))
        for c in ("a", "b"):  # what is asked of one side stands together, so each side is dealt out once, and a again for its stars
            own = Window.partitionBy(c)
            ranked = ranked.withColumns({f"near_{c}": F.rank().over(own.orderBy(*key)) == 1, f"best_{c}": F.row_number().over(own.orderBy(*order)) == 1})
            ranked = ranked.withColumn(f"n_{c}", F.sum(F.col(f"near_{c}").cast("int")).over(own))
        ranked = ranked.withColumn("star_b", star("b", "a")).withColumn("star_a", star("a", "b"))
        mutual = ranked.where("near_a and near_b").withColumn("centre", F.when(F.col("star_a"), F.concat(F.lit("a"), "a")).when(F.col("star_b"), F.concat(F.lit("b"), "b"))).checkpoint()
        stars, single = mutual.where("centre is not null"), mutual.where("centre is null and best_a and best_b")
        rank = F.row_number().over(Window.partitionBy("centre").orderBy("id"))
        side = lambda legs, c: legs.join(stars.select("centre", F.col(c).alias("cls")).distinct(), "cls").withColumn("n", rank).select("centre", "n", F.col("id").alias(f"{c}_id"), F.col("cls").alias(c))
        paired = side(left_out, "a").join(side(left_in, "b"), ["centre", "n"]).select("a", "b", F.col("a_id").alias("out_id"), F.col("b_id").alias("in_id"))
        paired = paired.unionByName(single.select("a", "b", F.col("first_a").alias("out_id"), F.col("first_b").alias("in_id"))).checkpoint()
        if paired.isEmpty():
            found = paired if found is None else found
            break
        found = paired if found is None else found.unionByName(paired)
    return found.join(near, ["a", "b"]).select("out_id", "in_id", "out_subject", "in_subject", "out_date", "in_date", "out_amount", "in_amount", "days", "gap")


def candidate_legs(df: DataFrame, window_days: int = 7, tolerance: str = "0.01", strict: bool = True) -> DataFrame:
    """``txn_uid`` of every leg that has a fitting leg, paired off or not (A8); classes of equal legs meet instead of the legs."""
    legs = _legs(df).checkpoint()
    near = candidate_pairs(legs.where("id = cls").withColumnRenamed("id", "txn_uid"), window_days, tolerance, strict)
    fitting = near.select("out_id", "in_id").checkpoint()
    classes = fitting.select(F.lit("out").alias("side"), F.col("out_id").alias("cls")).union(fitting.select(F.lit("in"), "in_id")).distinct()
    return legs.join(classes, ["side", "cls"], "left_semi").select(F.col("id").alias("txn_uid")).distinct()


def mark_transfers(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """``df`` with mark, direction and pair id of internal transfers."""
    pair = F.concat_ws("-", "out_id", "in_id").alias("transfer_pair")
    legs = pairs.select(F.col("out_id").alias("txn_uid"), F.lit("转出").alias("transfer_direction"), pair).unionByName(pairs.select(F.col("in_id").alias("txn_uid"), F.lit("转入").alias("transfer_direction"), pair))
    return df.join(legs, "txn_uid", "left").withColumn("is_transfer", F.col("transfer_pair").isNotNull())


def without_transfers(marked: DataFrame, keep_only: bool = False) -> DataFrame:
    return marked.where(F.col("is_transfer") if keep_only else ~F.col("is_transfer"))
