"""A ledger over the star-schema tables, so that every ledger operator can run on them.

Orders are transactions: finished ones payments, others receipts; the nation is
the bank, the market segment the subject. A mirror of some payments (subjects
swapped, up to eight days later) gives internal transfers to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abaculus.functions.accounts import account_key, match_key

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
MONEY = "decimal(20,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # a fixed table of 25 rows
    price = F.col("o_totalprice").cast(MONEY)
    base = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("txn_uid"),
            F.col("n_name").alias("bank"),
            F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("account"),
            F.col("c_mktsegment").alias("subject"),
            F.col("o_orderdate").cast("date").alias("trade_date"),
            F.when(F.col("o_orderstatus") == "F", -price).cast(MONEY).alias("payment"),
            F.when(F.col("o_orderstatus") != "F", price).cast(MONEY).alias("receipt"),
            F.col("o_orderpriority").alias("summary"),
            F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("counterparty"),
            F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("txn_id"),
            "o_orderkey",
        )
    )
    mirrored = base.where("payment is not null and subject <> counterparty and o_orderkey % 10 in (1, 2)")
    key = F.col("o_orderkey").cast("string")
    mirror = mirrored.select(
        F.concat(F.lit("M"), key).alias("txn_uid"),
        "bank",
        F.lpad((F.col("o_orderkey") + 9000000000).cast("string"), 10, "0").alias("account"),
        F.col("counterparty").alias("subject"),
        F.date_add("trade_date", (F.col("o_orderkey") % 9).cast("int")).alias("trade_date"),
        F.lit(None).cast(MONEY).alias("payment"),
        (-F.col("payment")).cast(MONEY).alias("receipt"),
        "summary",
        F.col("subject").alias("counterparty"),
        F.concat(F.lit("M"), key).alias("txn_id"),
        "o_orderkey",
    )
    return base.unionByName(mirror)


#: The same ledger as the opening of a DuckDB query.
LEDGER_SQL = """
with recursive seg(i, s) as (values (0,'AUTOMOBILE'),(1,'BUILDING'),(2,'FURNITURE'),(3,'HOUSEHOLD'),(4,'MACHINERY')),
base as (select 'O'||o_orderkey as txn_uid, n_name as bank, lpad(cast(c_custkey as varchar),10,'0') as account,
    c_mktsegment as subject, cast(o_orderdate as date) as trade_date,
    case when o_orderstatus='F' then -cast(o_totalprice as decimal(20,2)) end as payment,
    case when o_orderstatus<>'F' then cast(o_totalprice as decimal(20,2)) end as receipt,
    o_orderpriority as summary, seg.s as counterparty, 'T'||o_orderkey as txn_id, o_orderkey
  from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join seg on seg.i = o_orderkey % 5),
mirror as (select 'M'||o_orderkey, bank, lpad(cast(9000000000+o_orderkey as varchar),10,'0'), counterparty,
    trade_date + cast(o_orderkey % 9 as integer), null, -payment, summary, subject, 'M'||o_orderkey, o_orderkey
  from base where payment is not null and subject<>counterparty and o_orderkey % 10 in (1,2)),
ledger as (select * from base union all select * from mirror)"""


def with_keys(df: DataFrame) -> DataFrame:
    """account_key and match_key columns."""
    cols = [F.col(c) for c in ("account", "txn_id", "trade_date", "payment", "receipt")]
    return df.withColumns({"account_key": account_key(F.col("account")), "match_key": match_key(*cols)})


def with_balance(df: DataFrame) -> DataFrame:
    """A running balance per account, with a flaw of 1.00 in every 97th order for continuity checks to find."""
    order = Window.partitionBy("account").orderBy("trade_date", "txn_uid").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.coalesce("payment", F.lit(0).cast(MONEY)) + F.coalesce("receipt", F.lit(0).cast(MONEY))
    flaw = F.when(F.col("o_orderkey") % 97 == 0, F.lit(1).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    return df.withColumn("balance", (F.sum(moved).over(order) + flaw).cast(MONEY))


BALANCE_SQL = """,
balanced as (select *, sum(coalesce(payment,0)+coalesce(receipt,0)) over (partition by account order by trade_date, txn_uid rows unbounded preceding)
    + case when o_orderkey % 97 = 0 then 1.00 else 0.00 end as balance from ledger)"""


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an account lookup: one in 17 is missing, one in 5 stands twice with another priority."""
    c = read(spark, sf_dir, "customer")
    one = c.where("c_custkey % 17 <> 0").select(
        F.col("c_mktsegment").alias("subject"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("account"), F.lit(0).alias("priority"),
        F.create_map(F.lit("region"), F.col("c_nationkey").cast("string")).alias("extra"), F.col("c_custkey").cast("long").alias("row_id"),
    )
    two = c.where("c_custkey % 17 <> 0 and c_custkey % 5 = 0").select(
        F.concat(F.col("c_mktsegment"), F.lit(" HQ")).alias("subject"), F.col("c_custkey").cast("string").alias("account"), F.lit(3).alias("priority"),
        F.create_map(F.lit("region"), F.lit("HQ")).alias("extra"), (F.col("c_custkey") + 1_000_000_000).cast("long").alias("row_id"),
    )
    both = one.unionByName(two)
    return both.withColumn("account_key", account_key(F.col("account")))


LOOKUP_SQL = """,
lookup as (select c_mktsegment as subject, lpad(cast(c_custkey as varchar),10,'0') as account, 0 as priority, cast(c_nationkey as varchar) as region,
    c_custkey as row_id, cast(c_custkey as varchar) as account_key from customer where c_custkey % 17 <> 0
  union all select c_mktsegment||' HQ', cast(c_custkey as varchar), 3, 'HQ', c_custkey+1000000000, cast(c_custkey as varchar)
  from customer where c_custkey % 17 <> 0 and c_custkey % 5 = 0)"""


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a personal ledger: purchases are expenses, every 11th event income, every 13th a transfer."""
    e = read(spark, sf_dir, "events")
    merchant = F.when(F.col("event_id") % 6 == 0, "").otherwise(F.concat(F.lit("shop-"), (F.col("user_id") % 40).cast("string")))
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("bank"), (F.col("user_id") % 4).cast("string")).alias("bank_name"),
        F.col("user_id").cast("string").alias("account_number"),
        F.date_format("ts", "yyyy-MM-dd").alias("trade_date"),
        F.abs(F.round("value", 2)).cast(MONEY).alias("amount"),
        F.when(F.col("event_id") % 13 == 0, "transfer").when(F.col("event_id") % 11 == 0, "income").otherwise("expense").alias("direction"),
        F.col("event_type").alias("summary"),
        merchant.alias("merchant"),
        F.concat(F.lit("cat-"), F.col("event_type")).alias("category"),
        "event_id",
    )


PERSONAL_SQL = """
with personal as (select md5(cast(event_id as varchar)) as id, 'bank'||(user_id % 4) as bank_name, cast(user_id as varchar) as account_number,
    strftime(ts, '%Y-%m-%d') as trade_date, abs(cast(round(value, 2) as decimal(20,2))) as amount,
    case when event_id % 13 = 0 then 'transfer' when event_id % 11 = 0 then 'income' else 'expense' end as direction,
    event_type as summary, case when event_id % 6 = 0 then '' else 'shop-'||(user_id % 40) end as merchant, 'cat-'||event_type as category, event_id
  from events)"""
