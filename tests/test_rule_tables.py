"""Rules as rows against rules in the plan."""

import random

from pyspark.sql import functions as F

from abaculus.operators import rule_tables, rules


def test_all_modes_equal_plain_comparison(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab费é ") for _ in range(r.randint(1, n)))
    texts = [word(14) for _ in range(150)] + [None, "", "a"]
    table = [(word(5), r.choice(["contains", "exact", "startswith", "endswith"]), n) for n in range(120)] + [(texts[3], "exact", 900), ("", "contains", 901), (None, "contains", 902), ("^a.*b$", "regex", 903), ("xyz", "contains", 904)]
    found = rule_tables.matches(spark.createDataFrame([(t, 1) for t in texts], "t string, n int"), "t", spark.createDataFrame(table, "keyword string, mode string, n int"))
    import re

    test = {"contains": lambda t, k: k in t, "exact": lambda t, k: t == k, "startswith": str.startswith, "endswith": str.endswith, "regex": lambda t, k: re.search(k, t)}
    want = sorted((t, n) for t in {x for x in texts if x} for k, m, n in table if k and test[m](t, k))
    assert sorted((x.t, x.n) for x in found.collect()) == want


def test_cashflow_by_table_equals_compiled_rules(spark):
    r = random.Random(2)
    words = [k for rule in rules.CASHFLOW_RULES for k in rule.summary_keywords + rule.counterparty_keywords] + ["x", "", "公司"]
    own = rules.CASHFLOW_RULES + [rules.CashflowRule("a", "tax", ["公司"], ["x公司"], "any", 41), rules.CashflowRule("b", "fee", ["公司"], [], "any", 41), rules.CashflowRule("off", "fee", ["x"], [], "any", 1, enabled=False)]
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(words) for _ in range(r.randint(0, 3)))
    data = [(n, text(), text(), r.choice([None, -5.0, 0.0]), r.choice([None, 7.0, 0.0]), "clash") for n in range(400)]
    df = spark.createDataFrame(data, "n int, summary string, counterparty string, payment double, receipt double, keyword string")
    rows = lambda d: sorted(map(tuple, d.select("n", "cf_main", "cf_sub", "cf_main_code", "cf_sub_code", "cf_rule", "cf_keyword", "cf_source").collect()))
    assert rows(rule_tables.classify_cashflow(df, rule_tables.cashflow_rule_table(spark, own))) == rows(rules.classify_cashflow(df, own))


def test_plan_does_not_grow_with_rules(spark):
    texts = spark.range(300).select(F.concat(F.lit("text "), F.col("id")).alias("t"))
    table = lambda n: spark.range(n).select(F.concat(F.lit("text "), F.col("id")).alias("keyword"), F.lit("exact").alias("mode"))
    plans = [rule_tables.matches(texts, "t", table(n))._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (10, 10_000)]
    assert plans[0] == plans[1] and rule_tables.matches(texts, "t", table(10_000)).count() == 300


def test_grams_only_of_the_sizes_of_inner_keywords(spark, monkeypatch):
    """Exact, first and last keywords meet without grams; characters of four bytes count as one."""
    sizes, plain = [], rule_tables._grams_of_length
    monkeypatch.setattr(rule_tables, "_grams_of_length", lambda text, size: sizes.append(size) or plain(text, size))
    texts = spark.createDataFrame([("a😀bcd",), ("a",)], "t string")
    table = spark.createDataFrame([("a😀", "startswith"), ("d", "endswith"), ("a", "exact"), ("😀bc", "contains"), ("bcde", "contains")], "keyword string, mode string")
    assert {(r.t, r.keyword) for r in rule_tables.matches(texts, "t", table).collect()} == {("a😀bcd", "a😀"), ("a😀bcd", "d"), ("a", "a"), ("a😀bcd", "😀bc")}
    assert sizes == [3]
