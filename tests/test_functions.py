"""Scalar functions on hand-made values."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from abaculus.functions import accounts, amounts, dates, masks, texts


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_accounts(spark):
    assert one(spark, ["38812345678.0", " 0123 ", None, "nan", "12.50", "x.0"], accounts.normalize_account) == ["38812345678", "0123", "", "", "12.50", "x.0"]
    assert one(spark, ["000123", "000", "", None, "123.0"], accounts.account_key) == ["123", "0", "0", "0", "123"]


def test_match_key(spark):
    df = spark.createDataFrame([("0012", "T1", "2024-01-05", D("-5.00"), None), ("0012", " ", "2024-01-05", D("-5.00"), None), ("0012", "NaN", None, None, D("7.10"))], "a string, t string, d string, p decimal(20,2), r decimal(20,2)")
    got = [r[0] for r in df.select(accounts.match_key(*[F.col(c) for c in "atdpr"])).collect()]
    assert got == ["12::T1", "12::2024-01-05::-5.00::", "12::::::7.10"]


def test_unique_id(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05.678901' as t, 'x' as x")
    value = df.select(accounts.unique_id(F.col("t"), F.col("x"))).first()[0]
    assert value.startswith("20240102030405678901") and len(value) == 52


def test_amounts(spark):
    assert one(spark, [" 1.5 ", "12d", "1_000", "1e3", "", None, "1,000"], amounts.to_float) == [1.5, None, None, 1000.0, None, None, None]
    assert one(spark, ["1,234.50", "(88.10)", "￥５．５", "--", "无", "RMB 7", "x", None, "-3元"], amounts.parse_amount) == [D("1234.50"), D("-88.10"), D("5.50"), None, None, D("7.00"), None, None, D("-3.00")]
    assert one(spark, ["x", None], amounts.parse_amount_or_zero) == [D("0.00")] * 2
    assert one(spark, ["true", "5", " 6.5 ", "", None, "abc"], amounts.is_numeric) == [True, True, True, False, False, False]


def test_pick_net_direction(spark):
    rows = [(D("-5"), None), (None, D("7")), (D("0"), D("0")), (None, None), (D("-1"), D("2"))]
    df = spark.createDataFrame(rows, "p decimal(20,2), r decimal(20,2)")
    p, r = F.col("p"), F.col("r")
    got = df.select(amounts.pick_amount(p, r).alias("a"), amounts.net_amount(p, r).alias("n"), amounts.direction(p, r).alias("d")).collect()
    assert [x.a for x in got] == [D("5.00"), D("7.00"), None, None, D("1.00")]
    assert [x.n for x in got] == [D("-5.00"), D("7.00"), D("0.00"), None, D("1.00")]
    assert [x.d for x in got] == ["支出", "收入", "无流向", "无流向", "收支"]


def test_dates(spark):
    d = dt.date(2024, 1, 5)
    values = ["2024-01-05", "2024/1/5", "2024.1.5", "20240105", "2024年1月5日", "1/5/2024", "2024-01-05 10:11:12", "never", None, ""]
    assert one(spark, values, dates.parse_date) == [d] * 7 + [None] * 3
    assert one(spark, ["2024/1/5", "never"], dates.parse_date_or_keep) == ["2024-01-05", "never"]


@pytest.mark.parametrize(("day", "cutoff", "period"), [("2024-01-10", 25, "2024-01"), ("2024-01-26", 25, "2024-02"), ("2024-12-26", 25, "2025-01"), ("2024-02-29", 31, "2024-02"), ("2024-02-29", 30, "2024-02"), ("2024-01-02", 1, "2024-02"), ("2023-02-28", 29, "2023-02"), (None, 25, "未知期间")])
def test_monthly_period(spark, day, cutoff, period):
    assert one(spark, [day], lambda c: dates.accounting_month(c.cast("date"), cutoff)) == [period]


@pytest.mark.parametrize(("day", "start", "quarter"), [("2024-03-10", 1, "2024-Q1"), ("2024-03-26", 1, "2024-Q2"), ("2024-12-26", 1, "2025-Q1"), ("2024-02-28", 1, "2024-Q1"), ("2024-06-10", 4, "2024-Q1"), ("2024-06-26", 4, "2024-Q2"), ("2024-03-26", 4, "2024-Q1")])
def test_quarters(spark, day, start, quarter):
    assert one(spark, [day], lambda c: dates.accounting_quarter(c.cast("date"), 25, start)) == [quarter]


def test_period_keys(spark):
    f = lambda p: one(spark, ["2024-02-15", None], lambda c: dates.period_key(c.cast("date"), p))
    assert [f(p)[0] for p in ("month", "quarter", "year", "week")] == ["2024-02", "2024Q1", "2024", "2024-W07"]
    assert f("month")[1] == "未知"


def test_masks(spark):
    assert one(spark, ["01090312345678901", "123456", None, ""], masks.mask_account) == ["010***********901", "******", None, ""]
    assert one(spark, ["供应商A公司", "张", "张三", None], masks.mask_name) == ["供****司", "*", "张*", None]
    assert one(spark, ["采购付款", "款"], masks.mask_text) == ["采购***", "款***"]
    assert one(spark, ["-999", "0", "12345", "x", "10000000"], masks.mask_amount) == ["[<1千]", "[0]", "[1万-10万]", "[金额已隐藏]", "[>=1千万]"]
    assert one(spark, ["2024-03-05", "soon"], masks.mask_date) == ["2024年03月", "[日期已隐藏]"]
    assert one(spark, ["/a/b/c.pdf"], masks.mask_path) == ["c.pdf"]
    assert one(spark, ["2024-01-05", "TXN012345", "12345678", "8", ""], masks.mask_by_shape)[1:] == ["TXN0*****", "1234年56月", "8", ""]


def test_levels(spark):
    assert [masks.classify_field(c) for c in ("银行", "subject", "余额", "my_account_no", "对方名称", "other")] == ["info_safe", "debug_only", "forbidden", "forbidden", "debug_only", "info_safe"]
    df = spark.sql("select named_struct('account', '12345678', 'x', 1) as s, array(named_struct('summary', 'hello')) as a, 'n' as `交易时间`")
    r = masks.mask_frame(df).first()
    assert r.s.account == "123**678" and r.s.x == 1 and r.a[0].summary == "he***" and r["交易时间"].startswith("[")
    assert masks.fields_at(["银行", "subject", "account"], "debug_only") == ["银行", "subject"]


def test_texts(spark):
    assert one(spark, ["ＡＢ１", None], texts.half_width) == ["AB1", None]
    for mode, hit, miss in (("contains", "发放工资", "报销"), ("exact", "工资", "发工资"), ("startswith", "工资发", "发工资"), ("endswith", "发工资", "工资发"), ("regex", "a工资1", "b")):
        assert one(spark, [hit, miss, None], lambda c: texts.first_keyword(c, ["x", "工资"], mode)) == ["工资", None, None]  # noqa: B023
    df = spark.createDataFrame([("kitten", "sitting"), ("a", "a"), ("", "a"), (None, "a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(texts.similarity(F.col("a"), F.col("b"))).collect()] == [0.5714, 1.0, 0.0, 0.0]
    assert one(spark, [" 5.0 ", "5", "", None, "a "], texts.comparable) == ["5", "5", None, None, "a"]
