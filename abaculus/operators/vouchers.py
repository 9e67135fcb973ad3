"""Double-entry vouchers and their layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.operators.numbering import numbered

MONEY = "decimal(20,2)"

#: Account codes and names.
ACCOUNTS = {
    "bank_deposit": ("1002", "银行存款"),
    "accounts_receivable": ("1122", "应收账款"),
    "accounts_payable": ("2202", "应付账款"),
    "operating_revenue": ("6001", "主营业务收入"),
    "operating_cost": ("6401", "主营业务成本"),
    "management_expense": ("6602", "管理费用"),
    "sales_expense": ("6601", "销售费用"),
    "financial_expense": ("6603", "财务费用"),
    "cash": ("1001", "库存现金"),
}
#: Patterns of the summary that choose the counter-account, for payments and for receipts.
PAYMENT_WORDS = (("差旅|办公|招待", "management_expense"), ("广告|推广", "sales_expense"), ("手续费|利息", "financial_expense"), ("主营业务成本", "operating_cost"))
RECEIPT_WORDS = (("主营业务收入|销售", "operating_revenue"), ("利息", "financial_expense"))
LAYOUTS = ("yonyou_voucher", "kingdee_voucher", "bank_journal")


def entries(df: DataFrame, operator: str = "", accounts: dict[str, tuple[str, str]] = ACCOUNTS, payment_words: tuple = PAYMENT_WORDS, receipt_words: tuple = RECEIPT_WORDS) -> DataFrame:
    """Two entries a transaction, the bank's first; debit equals credit; rows without an amount make none.

    Vouchers are numbered 记-202401-0001 by month, date and txn_uid. A month or a day may hold a large share
    of all rows; its places are counted over ranges of the order, each by a task of its own.
    """
    pays = F.coalesce(F.col("payment") != 0, F.lit(False))
    amount = F.when(pays, F.abs("payment")).otherwise(F.nullif(F.abs("receipt"), F.lit(0)))
    rows = df.withColumn("amount", amount.cast(MONEY)).where("amount is not null")

    def other(words: tuple, default: str):
        out = F.lit(default)
        for pattern, name in reversed(words):
            out = F.when(F.col("summary").rlike(pattern), name).otherwise(out)
        return out

    counter = F.when(pays, other(payment_words, "accounts_payable")).otherwise(other(receipt_words, "accounts_receivable"))
    month = F.coalesce(F.date_format("trade_date", "yyyyMM"), F.lit("000000"))
    placed = numbered(rows.withColumns({"_month": month, "_counter": counter, "_pays": pays}), [F.col("trade_date"), F.col("txn_uid")], "_place", within=["_month"])
    vouchers = placed.withColumn("voucher_no", F.concat(F.lit("记-"), "_month", F.lit("-"), F.lpad(F.col("_place").cast("string"), 4, "0")))
    code = F.create_map(*[F.lit(x) for k, (c, _) in accounts.items() for x in (k, c)])
    name = F.create_map(*[F.lit(x) for k, (_, n) in accounts.items() for x in (k, n)])
    zero = F.lit(0).cast(MONEY)

    def entry(line: int, account, debit):
        return F.struct(
            F.lit(line).alias("line_no"), F.element_at(code, account).alias("account_code"), F.element_at(name, account).alias("account_name"),
            F.when(debit, "借").otherwise("贷").alias("side"), F.when(debit, F.col("amount")).otherwise(zero).alias("debit"), F.when(debit, zero).otherwise(F.col("amount")).alias("credit"),
        )

    both = F.array(entry(1, F.lit("bank_deposit"), ~F.col("_pays")), entry(2, F.col("_counter"), F.col("_pays")))
    return vouchers.select("voucher_no", "txn_uid", "trade_date", "summary", "counterparty", F.lit(operator).alias("prepared_by"), F.inline(both))


def layout(rows: DataFrame, kind: str) -> DataFrame:
    """Entries in the column layout of an accounting product, or one journal row per transaction."""
    if kind not in LAYOUTS:
        raise ValueError(f"unknown layout {kind!r}; known: {', '.join(LAYOUTS)}")
    if kind == "yonyou_voucher":
        return rows.select(F.col("trade_date").alias("制单日期"), F.lit("记").alias("凭证类别"), F.col("voucher_no").alias("凭证号"), F.col("summary").alias("摘要"), F.col("account_code").alias("科目编码"), F.col("debit").alias("借方金额"), F.col("credit").alias("贷方金额"), F.col("prepared_by").alias("制单人"))
    if kind == "kingdee_voucher":
        return rows.select(F.col("trade_date").alias("日期"), F.lit("记").alias("凭证字"), F.col("voucher_no").alias("凭证号"), F.col("line_no").alias("分录号"), F.col("summary").alias("摘要"), F.col("account_code").alias("科目代码"), F.col("account_name").alias("科目名称"), F.col("debit").alias("借方"), F.col("credit").alias("贷方"))
    return rows.where("line_no = 1").select(F.col("trade_date").alias("日期"), F.col("voucher_no").alias("凭证号"), F.col("summary").alias("摘要"), F.col("counterparty").alias("对方户名"), F.col("debit").alias("收入"), F.col("credit").alias("支出"))
