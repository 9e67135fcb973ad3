"""Keyword rules compiled to columns: counterparty lists, cash flow, personal categories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abaculus.functions.texts import first_keyword

UNCLASSIFIED = "未分类"


@dataclass
class CounterpartyRule:
    rule_id: str
    name: str
    rule_type: str  # blacklist or whitelist
    keywords: list[str]
    match_mode: str = "contains"
    enabled: bool = True


#: The tag of each list.
TAGS = {"blacklist": "黑名单", "whitelist": "白名单"}


def apply_counterparty_rules(df: DataFrame, rules: list[CounterpartyRule]) -> DataFrame:
    """``df`` with tags, rule names and keywords of all enabled rules that match."""
    active = [r for r in rules if r.enabled]
    hits = [(r, first_keyword(F.col("counterparty"), r.keywords, r.match_mode)) for r in active]
    texts = {
        "cp_tag": [F.when(k.isNotNull(), f"{TAGS[r.rule_type]}:{r.name}") for r, k in hits],
        "cp_rules": [F.when(k.isNotNull(), r.name) for r, k in hits],
        "cp_keywords": [k for _, k in hits],
    }
    return df.withColumns({c: F.concat_ws(",", *parts) if parts else F.lit("") for c, parts in texts.items()})


def counterparty_summary(tagged: DataFrame) -> DataFrame:
    """Rows by rule; rule null: all rows with a tag."""
    rows = tagged.where("cp_rules <> ''")
    each = rows.select(F.explode(F.split("cp_rules", ",")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return each.unionByName(rows.agg(F.lit(None).cast("string").alias("rule"), F.count(F.lit(1)).alias("n")))


@dataclass
class CashflowRule:
    name: str
    subcategory: str
    summary_keywords: list[str] = field(default_factory=list)
    counterparty_keywords: list[str] = field(default_factory=list)
    direction: str = "any"  # any, payment or receipt
    priority: int = 100
    match_mode: str = "contains"
    enabled: bool = True


#: Code of a subcategory, its name, and its main category.
SUBCATEGORIES = {
    "salary": ("工资薪金", "operating"),
    "tax": ("税费缴纳", "operating"),
    "customer": ("客户收款", "operating"),
    "supplier": ("供应商付款", "operating"),
    "expense": ("费用支出", "operating"),
    "fee": ("手续费支出", "operating"),
    "refund": ("退款收入", "operating"),
    "investment_out": ("投资支付", "investing"),
    "investment_in": ("投资收益", "investing"),
    "fixed_asset": ("固定资产", "investing"),
    "asset_sale": ("处置资产", "investing"),
    "loan_in": ("取得借款", "financing"),
    "loan_out": ("偿还借款", "financing"),
    "dividend": ("分配股利", "financing"),
    "interest_out": ("利息支出", "financing"),
    "capital_in": ("实收资本", "financing"),
    "transfer": ("内部转账", "unclassified"),
}
MAIN_CATEGORIES = {"operating": "经营活动现金流", "investing": "投资活动现金流", "financing": "筹资活动现金流", "unclassified": UNCLASSIFIED}

#: The default rules.
CASHFLOW_RULES = [
    CashflowRule("工资薪金", "salary", ["工资", "薪资", "奖金", "社保", "公积金"], [], "payment", 10),
    CashflowRule("税费", "tax", ["税"], ["税务局", "国库"], "payment", 20),
    CashflowRule("分红", "dividend", ["分红", "股利"], [], "payment", 25),
    CashflowRule("实收资本", "capital_in", ["投资款", "增资", "实收资本"], [], "receipt", 28),
    CashflowRule("投资收益", "investment_in", ["理财", "投资收益", "赎回"], [], "receipt", 30),
    CashflowRule("投资支付", "investment_out", ["理财", "投资", "基金申购"], [], "payment", 31),
    CashflowRule("利息支出", "interest_out", ["利息"], [], "payment", 35),
    CashflowRule("取得借款", "loan_in", ["贷款", "借款"], [], "receipt", 40),
    CashflowRule("偿还借款", "loan_out", ["还款", "偿还", "贷款", "还贷"], [], "payment", 41),
    CashflowRule("固定资产", "fixed_asset", ["设备", "固定资产", "车辆"], [], "payment", 45),
    CashflowRule("处置资产", "asset_sale", ["处置", "变卖"], [], "receipt", 46),
    CashflowRule("退款", "refund", ["退款", "退回"], [], "receipt", 50),
    CashflowRule("客户收款", "customer", ["货款", "销售", "回款", "服务费"], [], "receipt", 55),
    CashflowRule("供应商付款", "supplier", ["原材料", "采购", "货款"], [], "payment", 56),
    CashflowRule("手续费", "fee", ["手续费"], [], "payment", 60),
    CashflowRule("费用", "expense", ["报销", "房租", "水电", "差旅"], [], "payment", 65),
    CashflowRule("内部转账", "transfer", ["转账", "划转", "调拨"], [], "any", 90),
]


def _directed(direction: str) -> Column:
    return {"any": F.lit(True), "payment": F.coalesce(F.col("payment") != 0, F.lit(False)), "receipt": F.coalesce(F.col("receipt") != 0, F.lit(False))}[direction]


def classify_cashflow(df: DataFrame, rules: list[CashflowRule] = CASHFLOW_RULES) -> DataFrame:
    """``df`` with main and sub category, their codes, rule, keyword and source of the first rule by priority."""
    fields = ("cf_main", "cf_sub", "cf_main_code", "cf_sub_code", "cf_rule", "cf_keyword", "cf_source")

    def entry(*values) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(fields, values)])

    out = entry(UNCLASSIFIED, UNCLASSIFIED, "unclassified", "unclassified", "", "", "")
    for r in sorted((r for r in rules if r.enabled), key=lambda r: r.priority, reverse=True):
        name, main = SUBCATEGORIES[r.subcategory]
        for source, column, keywords in (("counterpart", "counterparty", r.counterparty_keywords), ("summary", "summary", r.summary_keywords)):
            if keywords:
                k = first_keyword(F.col(column), keywords, r.match_mode)
                out = F.when(_directed(r.direction) & k.isNotNull(), entry(MAIN_CATEGORIES[main], name, main, r.subcategory, r.name, k, source)).otherwise(out)
    return df.withColumn("_cf", out).select(*df.columns, "_cf.*")


def cashflow_summary(classified: DataFrame) -> DataFrame:
    """Count, in, out and net by main category and by main and sub category, in one pass."""
    zero = F.lit(0).cast("decimal(20,2)")
    inflow, outflow = F.coalesce(F.sum("receipt"), zero), F.coalesce(F.sum(F.abs("payment")), zero)
    m, s = F.col("cf_main_code"), F.col("cf_sub_code")
    return classified.groupingSets([[m], [m, s]], "cf_main_code", "cf_sub_code").agg(F.count(F.lit(1)).alias("n"), inflow.alias("inflow"), outflow.alias("outflow"), (inflow - outflow).alias("net"))


@dataclass
class Category:
    name: str
    keywords: list[str]
    priority: int = 0


def classify_personal(df: DataFrame, expense: list[Category], income: list[Category], special: list[Category]) -> DataFrame:
    """``df`` with its category; special rules come first and make the row a transfer."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("merchant", "summary", "transaction_type") if c in df.columns]))

    def chain(categories: list[Category], default: str) -> Column:
        out = F.lit(default)
        for c in sorted(categories, key=lambda c: c.priority):
            if c.keywords:
                out = F.when(first_keyword(text, [k.lower() for k in c.keywords]).isNotNull(), c.name).otherwise(out)
        return out

    moved = F.lit(None).cast("string")
    for c in reversed(special):
        moved = F.when(first_keyword(text, [k.lower() for k in c.keywords]).isNotNull(), c.name).otherwise(moved)
    own = F.when(F.col("direction") == "income", chain(income, "其他收入")).otherwise(chain(expense, "其他支出"))
    return df.withColumns({"category": F.coalesce(moved, own), "direction": F.when(moved.isNotNull(), "transfer").otherwise(F.col("direction"))})


def personal_direction(amount: Column, kind: Column, positive: bool = False, income_types: list[str] | None = None, expense_types: list[str] | None = None) -> Column:
    """The type decides where it names one; else the sign, whose sense depends on the bill; zero is an expense."""
    up, down = ("income", "expense") if positive else ("expense", "income")
    by_sign = F.when(amount > 0, up).when(amount < 0, down).otherwise("expense")
    kind = F.trim(F.coalesce(kind, F.lit("")))
    by_type = F.when(first_keyword(kind, income_types or []).isNotNull(), "income").when(first_keyword(kind, expense_types or []).isNotNull(), "expense")
    return F.coalesce(by_type, by_sign)
