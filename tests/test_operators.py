"""Ledger operators on hand-made rows."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from abaculus.operators import calendar, checks, fees, lookups, merging, query, rollups, rules, transfers, vouchers

COLS = "txn_uid string, bank string, account string, subject string, trade_date date, payment decimal(20,2), receipt decimal(20,2), summary string, counterparty string, balance decimal(20,2), txn_id string"


def rows(spark, *given):
    out = []
    for i, g in enumerate(given):
        base = {"txn_uid": f"U{i}", "bank": "B", "account": "622001", "subject": "S", "trade_date": "2024-01-05", "payment": None, "receipt": None, "summary": "", "counterparty": None, "balance": None, "txn_id": f"T{i:03d}"} | g
        base["trade_date"] = base["trade_date"] and dt.date.fromisoformat(base["trade_date"])
        out.append(tuple(D(str(v)) if k in ("payment", "receipt", "balance") and v is not None else v for k, v in base.items()))
    return spark.createDataFrame(out, COLS)


def test_continuity(spark):
    df = rows(
        spark,
        {"balance": 100, "receipt": 100},
        {"balance": 40, "payment": -60},
        {"balance": 41.01, "receipt": 1},
        {"balance": 50, "receipt": 5},
        {"account": "", "balance": 1},
        {"account": "", "balance": 9},
        {"account": "x", "trade_date": None, "balance": 9},
    )
    got = {r.txn_uid: r.difference for r in checks.balance_breaks(df).collect()}
    assert got == {"U3": D("3.99")}


@pytest.mark.parametrize(("strict", "days", "n"), [(True, 7, 1), (False, 7, 2), (True, 0, 0)])
def test_transfers(spark, strict, days, n):
    df = rows(
        spark,
        {"subject": "A", "counterparty": "B", "payment": -100},
        {"subject": "B", "counterparty": "A", "receipt": 100, "trade_date": "2024-01-03"},
        {"subject": "B", "counterparty": "A", "receipt": 100, "trade_date": "2024-01-09"},
        {"subject": "C", "counterparty": "D", "payment": -7},
        {"subject": "D", "counterparty": "?", "receipt": 7.01},
        {"subject": "A", "counterparty": "A", "payment": -3},
        {"subject": "A", "counterparty": "A", "receipt": 3},
    )
    got = transfers.internal_transfers(df, days, "0.01", strict)
    pairs = {(r.out_id, r.in_id) for r in got.collect()}
    assert len(pairs) == n and (("U0", "U1") in pairs or days == 0)
    marked = transfers.mark_transfers(df, got)
    assert transfers.without_transfers(marked).count() == 7 - 2 * n == 7 - transfers.without_transfers(marked, True).count()


def test_transfer_rounds(spark):
    """Both out legs prefer the same in leg; the second round settles the rest one to one."""
    df = rows(
        spark,
        {"subject": "A", "counterparty": "B", "payment": -5, "trade_date": "2024-01-05"},
        {"subject": "A", "counterparty": "B", "payment": -5, "trade_date": "2024-01-06"},
        {"subject": "B", "counterparty": "A", "receipt": 5, "trade_date": "2024-01-05"},
        {"subject": "B", "counterparty": "A", "receipt": 5, "trade_date": "2024-01-11"},
    )
    assert {(r.out_id, r.in_id) for r in transfers.internal_transfers(df).collect()} == {("U0", "U2"), ("U1", "U3")}


def test_merge_and_diff(spark):
    old = rows(spark, {"receipt": 5}, {"receipt": 6}, {"receipt": 7}).withColumn("match_key", F.col("txn_id"))
    new = rows(spark, {"receipt": 5.001}, {"receipt": 9, "summary": " x"}, {"txn_id": "N"}, {"txn_id": "N"}).withColumn("match_key", F.col("txn_id"))
    assert [r.txn_uid for r in merging.new_rows(old, new).collect()] == ["U2"]
    assert tuple(merging.merge_counts(old, new).first()) == (4, 1, 3)
    got = {r.match_key: (r.change, r.changed_fields) for r in merging.diff(old, new, ("receipt", "summary")).collect()}
    assert got == {"T000": ("未变", ""), "T001": ("变更", "receipt,summary"), "T002": ("删除", ""), "N": ("新增", "")}
    assert merging.merged(old, new).count() == 4


def test_reconcile(spark):
    total = spark.createDataFrame([("1", D("5.00"), None), ("2", D("9.00"), None), ("3", D("1.00"), None)], "account string, balance decimal(20,2), last_date date")
    other = spark.createDataFrame([("1", D("5.01"), None), ("2", D("8.00"), None), ("4", D("1.00"), None)], "account string, statement_balance decimal(20,2), statement_date date")
    r = merging.reconcile(total, other)
    assert {x.account: x.status for x in r.collect()} == {"1": "matched", "2": "diff", "3": "missing_statement", "4": "missing_total"}
    assert merging.reconciliation_summary(r).first().match_rate == "25.0%"
    assert merging.reconciliation_summary(r.limit(0)).first().match_rate == "0.0%"


def test_lookup(spark):
    look = spark.createDataFrame([("A", "00123", "123", 0, {"k": "v"}, 1), ("B", "123", "123", 5, {}, 2), ("C", "9", "9", 0, {}, 3), ("D", "9", "9", 0, {}, 4)], "subject string, account string, account_key string, priority int, extra map<string,string>, row_id long")
    got = {r.account: r.found_subject for r in lookups.resolve(rows(spark, {"account": "0123.0"}, {"account": "9"}, {"account": "77"}), look).collect()}
    assert got == {"0123.0": "B", "9": "C", "77": None}
    near = lookups.fuzzy_accounts(spark.createDataFrame([("12345679",), ("999",)], "account string"), spark.createDataFrame([("A", "12345678", "12345678", 0, {}, 1)], look.schema), 0.6)
    assert [(r.account, r.candidate) for r in near.collect()] == [("12345679", "12345678")]
    assert {r.account_key: r.n for r in rollups.lookup_duplicates(look).collect()} == {"123": 2, "9": 2}
    assert lookups.delete_entries(look, look.where("account_key = '9'")).count() == 2


def test_fuzzy_equals_brute_force(spark):
    import random

    random.seed(3)
    known = [f"{random.randrange(10**8):08d}" for _ in range(60)]
    typed = sorted({k[:i] + random.choice("0123456789") + k[i + random.choice((0, 1)) :] for k in known for i in (random.randrange(8),)} - {k.lstrip("0") for k in known})
    look = spark.createDataFrame([("S", k, k.lstrip("0"), 0, {}, i) for i, k in enumerate(known)], "subject string, account string, account_key string, priority int, extra map<string,string>, row_id long")
    got = {r.account: (r.candidate, r.score) for r in lookups.fuzzy_accounts(spark.createDataFrame([(t,) for t in typed], "account string"), look, 0.75).collect()}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    want = {}
    for t in typed:
        if t.lstrip("0") in {k.lstrip("0") for k in known}:
            continue
        score, i = max((round(1 - lev(t, k) / max(len(t), len(k)), 6), -i) for i, k in enumerate(known))
        if score >= 0.75:
            want[t] = (known[-i], score)
    assert got == want


@pytest.mark.parametrize(("summary", "type_", "category"), [("2024年第一季度存款利息", "利息", "利息收入"), ("贷款利息支出", "利息", "利息支出"), ("结息", "利息", "利息收入"), ("跨行转账手续费", "手续费", "转账手续费"), ("ATM提现手续费", "手续费", "提现手续费"), ("快捷支付手续费", "手续费", "支付手续费"), ("季度账户管理费", "手续费", "账户管理费"), ("银行卡年费", "手续费", "账户管理费"), ("网银服务费", "手续费", "网银服务费"), ("短信通知服务费", "手续费", "短信服务费"), ("银行工本费", "手续费", "其他手续费"), ("Monthly account FEE", "手续费", "其他手续费"), ("采购货款", "", ""), ("", "", ""), (None, "", "")])
def test_fee_classes(spark, summary, type_, category):
    c = spark.createDataFrame([(summary,)], "s string").select(fees.classify(F.col("s")).alias("c")).first().c
    assert (c.type, c.category) == (type_, category)


def test_fee_amounts_and_anomalies(spark):
    df = spark.createDataFrame([("转账手续费", D(10000)), ("转账手续费", D(100)), ("转账手续费", D(1000000)), ("账户管理费", D(0)), ("年费", D(0)), ("?", D(5))], "c string, b decimal(20,2)")
    assert [float(r[0]) for r in df.select(fees.expected_amount(F.col("c"), F.col("b"))).collect()] == [50, 1, 50, 10, pytest.approx(100 / 12, abs=1e-5), 0]
    steady = rows(spark, *[{"summary": "账户管理费", "payment": -x, "trade_date": f"2024-{m:02d}-05"} for m, x in enumerate([10, 10.5, 9.8, 10.2, 10.1, 9.9], 1)])
    assert fees.check(steady).where("is_anomaly").count() == 0
    jump = rows(spark, *[{"summary": "账户管理费", "payment": -x, "trade_date": f"2024-{m:02d}-05"} for m, x in enumerate([10, 12, 9, 11, 10.5, 50], 1)])
    assert {r.period: r.reasons for r in fees.check(jump).where("is_anomaly").collect()} == {"2024-06": "预期费率,历史均值,环比"}


@pytest.mark.parametrize(("summary", "party", "amount", "sub"), [("发放1月工资", None, -5, "工资薪金"), ("往来款", "北京市海淀区税务局", -5, "税费缴纳"), ("收到银行贷款", None, 5, "取得借款"), ("偿还银行贷款本金", None, -5, "偿还借款"), ("购买理财产品", None, -5, "投资支付"), ("收到理财利息", None, 5, "投资收益"), ("账户转账", None, -5, "内部转账"), ("收到货款", None, 5, "客户收款"), ("支付原材料款", None, -5, "供应商付款"), ("购买办公设备", None, -5, "固定资产"), ("分配股东分红", None, -5, "分配股利"), ("股东投资款", None, 5, "实收资本"), ("支付季度利息", "中国工商银行", -5, "利息支出"), ("模糊摘要无匹配关键词", None, -5, "未分类"), ("工资转账", None, -5, "工资薪金"), ("工资", None, 5, "未分类")])
def test_cashflow_defaults(spark, summary, party, amount, sub):
    df = rows(spark, {"summary": summary, "counterparty": party, "payment" if amount < 0 else "receipt": amount})
    assert rules.classify_cashflow(df).first().cf_sub == sub


def test_counterparty_rules(spark):
    df = rows(spark, {"counterparty": "北京XX科技有限公司"}, {"counterparty": ""}, {"counterparty": None})
    given = [rules.CounterpartyRule("1", "A", "blacklist", ["科技"]), rules.CounterpartyRule("2", "B", "whitelist", ["北京"], "startswith"), rules.CounterpartyRule("3", "C", "blacklist", ["公司"], enabled=False)]
    got = rules.apply_counterparty_rules(df, given).orderBy("txn_uid").collect()
    assert [(r.cp_tag, r.cp_rules, r.cp_keywords) for r in got] == [("黑名单:A,白名单:B", "A,B", "科技,北京"), ("", "", ""), ("", "", "")]
    assert rules.apply_counterparty_rules(df, []).first().cp_tag == ""


def test_screening(spark):
    df = rows(spark, {"payment": -600000}, {"receipt": 1200000}, {"payment": -3000000}, {"receipt": -5})
    assert {r.txn_uid: r.risk_level for r in checks.large_amounts(df, 500000).collect()} == {"U0": "low", "U1": "medium", "U2": "high"}
    assert checks.large_amounts(df, 0).count() == 0 == checks.busy_days(df, None).count()
    busy = checks.busy_days(df, 2, with_ids=True).first()
    assert (busy.n, busy.risk_level, busy.txn_ids) == (4, "medium", ["T000", "T001", "T002", "T003"])
    often = rows(spark, *[{"counterparty": "P", "payment": -1, "trade_date": f"2024-01-{d:02d}"} for d in (1, 2, 2, 8, 9)])
    hits = checks.frequent_counterparties(often, (checks.FrequencyRule("r", 7, 3),)).collect()
    assert {(str(r.trade_date), r.n) for r in hits} == {("2024-01-02", 3), ("2024-01-08", 3)}


def test_anomalies(spark):
    df = spark.createDataFrame([("-600,000.00", None, "400000", "a"), (None, None, "1", "c"), ("0", "0", "1", ""), (None, "-5", "1", None), ("5", None, "-1", None), ("-5", "5", "1", None)], "payment string, receipt string, balance string, counterparty string")
    got = [r.anomalies for r in checks.amount_anomalies(df).collect()]
    assert got == [["LARGE_AMOUNT"], ["ZERO_WITH_COUNTERPARTY", "NEITHER_PAYMENT_NOR_RECEIPT"], ["NEITHER_PAYMENT_NOR_RECEIPT"], ["NEGATIVE_RECEIPT"], ["POSITIVE_PAYMENT", "BALANCE_NEGATIVE"], ["BOTH_PAYMENT_AND_RECEIPT"]]
    assert checks.amount_anomalies(df, 0).first().anomalies == []


def test_holidays(spark):
    df = rows(spark, *[{"trade_date": d} for d in ("2024-01-08", "2024-01-06", "2024-01-01", "2024-02-04", None)])
    got = calendar.mark_days(df, calendar.calendar(spark)).orderBy("txn_uid").collect()
    assert [(r.day_tag, r.holiday_name, r.is_workday) for r in got] == [("工作日", "", True), ("周末", "", False), ("节假日", "元旦", False), ("调休工作日", "", True), ("工作日", "", True)]


@pytest.mark.parametrize(("summary", "code"), [("采购付款", "2202"), ("差旅费报销", "6602"), ("办公费", "6602"), ("业务招待费", "6602"), ("广告费", "6601"), ("推广费", "6601"), ("手续费", "6603"), ("利息支出", "6603"), ("主营业务成本", "6401")])
def test_voucher_accounts(spark, summary, code):
    e = vouchers.entries(rows(spark, {"summary": summary, "payment": -50}, {"summary": "nothing"}), "me").orderBy("line_no").collect()
    assert [(x.account_code, x.side, x.debit, x.credit) for x in e] == [("1002", "贷", D("0.00"), D("50.00")), (code, "借", D("50.00"), D("0.00"))]
    assert e[0].voucher_no == "记-202401-0001" and e[0].prepared_by == "me"


def test_voucher_layouts(spark):
    e = vouchers.entries(rows(spark, {"summary": "销售收款-主营业务收入", "receipt": 80}, {"payment": -1}))
    assert vouchers.layout(e, "yonyou_voucher").count() == 4 and vouchers.layout(e, "bank_journal").count() == 2
    assert e.where("account_code = '6001'").first().credit == D("80.00")
    assert e.agg(F.sum("debit") - F.sum("credit")).first()[0] == 0
    with pytest.raises(ValueError):
        vouchers.layout(e, "other")


def test_rollups(spark):
    df = rows(spark, {"receipt": 10}, {"payment": -4, "subject": None}, {"payment": 0, "receipt": 0}, {"receipt": 1, "trade_date": None})
    total = rollups.subject_rollup(df).where("level = 7").first()
    assert (total.income, total.expense, total.net, total.n_income, total.n_expense) == (D("11.00"), D("4.00"), D("7.00"), 2, 1)
    assert rollups.subject_rollup(df).where("subject = '未指定主体' and level = 3").first().expense == D("4.00")
    assert rollups.subject_rollup(df, df.select("txn_uid")).where("subject is not null").count() == 0
    assert rollups.unmatched_accounts(df).first().n == 1
    assert query.page(query.ordered(df), None, 3).count() == 4


def test_edits(spark):
    df = rows(spark, {"summary": "a"}, {"summary": "b"})
    edits = spark.createDataFrame([("U0", " new "), ("U1", " "), ("U9", "z")], "txn_uid string, summary string")
    assert {r.txn_uid: r.summary for r in merging.apply_edits(df, edits, ("summary",)).collect()} == {"U0": "new", "U1": "b"}
    assert merging.unmatched_edits(df, edits).count() == 1
    assert merging.delete_where(df).count() == 2 and merging.delete_where(df, subject="S").count() == 0


@pytest.mark.parametrize("strict", [True, False])
def test_transfers_equal_greedy(spark, strict):
    """Groups of equal legs, ties on either side of a day and near amounts, against all pairs taken in order; more than 20 of one group."""
    r, given = random.Random(4), []
    for _ in range(25):
        given.append({"subject": "A", "counterparty": "B", "payment": -5})
        given.append({"subject": "B", "counterparty": "A", "receipt": 5})
    for _ in range(60):
        a, b = r.choice([("C", "D"), ("D", "C"), ("C", "?"), ("D", None)])
        amount, date = r.choice([7, 7.01, 7.02]), f"2024-03-{r.choice([1, 2, 3, 4, 20]):02d}"
        given.append({"subject": a, "counterparty": b, "trade_date": date} | ({"payment": -amount} if r.random() < 0.5 else {"receipt": amount}))
    df = rows(spark, *given)
    legs = df.collect()
    pairs = []
    for o in legs:
        for i in legs:
            if (o.payment or 0) < 0 and (i.receipt or 0) > 0 and o.subject != i.subject:
                named = [o.counterparty == i.subject, i.counterparty == o.subject]
                days, gap = abs((o.trade_date - i.trade_date).days), abs(-o.payment - i.receipt)
                if (all(named) if strict else any(named)) and gap <= D("0.01") and days <= 7:
                    pairs.append((days, gap, o.trade_date, o.txn_uid, i.txn_uid))
    used, want = set(), set()
    for *_, o, i in sorted(pairs):
        if ("o", o) not in used and ("i", i) not in used:
            used |= {("o", o), ("i", i)}
            want.add((o, i))
    got = [(x.out_id, x.in_id) for x in transfers.internal_transfers(df, strict=strict).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 25


def test_personal_query_is_whole(spark):
    df = spark.range(1500).selectExpr("cast(id as string) as id", "date'2024-01-01' as trade_date", "cast(5 as decimal(20,2)) as amount", "'m' as merchant", "'expense' as direction")
    assert query.personal_query(df, direction="expense").count() == 1500
    assert query.personal_query(df, direction="expense", limit=1000).count() == 1000


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.3])
def test_fuzzy_one_way_for_all_sizes(spark, monkeypatch, threshold):
    """Short accounts that share no gram of two characters, against all pairs; a lookup of any size takes the same way."""
    r = random.Random(3)
    known = ["12345"] + ["".join(r.choice("123") for _ in range(r.randint(1, 12))) for _ in range(60)]
    typed = ["1X3Y5"] + ["".join(r.choice("123X") for _ in range(r.randint(1, 12))) for _ in range(60)]
    known = list({a.lstrip("0"): a for a in known}.values())
    look = spark.createDataFrame([("S", a, a, 0, i) for i, a in enumerate(known)], "subject string, account string, account_key string, priority int, row_id long")

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    want = {}
    for t in set(typed) - set(known):
        s, _, c = min((-round(1 - lev(t, c) / max(len(t), len(c)), 6), i, c) for i, c in enumerate(known))
        if -s >= threshold:
            want[t] = (c, -s)
    accounts = spark.createDataFrame([(t,) for t in typed], "account string")
    for block in (lookups.BLOCK, 4):
        monkeypatch.setattr(lookups, "BLOCK", block)
        got = {x.account: (x.candidate, x.score) for x in lookups.fuzzy_accounts(accounts, look, threshold).collect()}
        assert got == want and (threshold > 0.6 or "1X3Y5" in got)


def test_candidate_legs_without_a_partner_left(spark):
    """Two equal outgoing legs and one incoming leg: one pair, but all three have a fitting leg."""
    legs = [{"subject": "A", "counterparty": "B", "payment": -5}, {"subject": "A", "counterparty": "B", "payment": -5}, {"subject": "B", "counterparty": "A", "receipt": 5}, {"subject": "B", "counterparty": "A", "receipt": 6}]
    df = rows(spark, *legs)
    assert transfers.internal_transfers(df).count() == 1
    assert {r.txn_uid for r in transfers.candidate_legs(df).collect()} == {"U0", "U1", "U2"}


def test_fuzzy_near_accounts_without_tiles(spark, monkeypatch):
    """Up to two edits (a changed, a lost and a new character, two changed, two lost) are met by keys alone."""
    monkeypatch.setattr(lookups, "_blocks", None)
    look = spark.createDataFrame([("S", a, a, 0, i) for i, a in enumerate(["1234567890", "5555555555", "123456789077"])], "subject string, account string, account_key string, priority int, row_id long")
    typed = ["1234567891", "2345678900", "1299567890", "5555555577", "9999999999"]
    got = lookups.fuzzy_accounts(spark.createDataFrame([(a,) for a in typed], "account string"), look, 0.8)
    assert {(r.account, r.candidate, r.score) for r in got.collect()} == {("1234567891", "1234567890", 0.9), ("2345678900", "1234567890", 0.8), ("1299567890", "1234567890", 0.8), ("5555555577", "5555555555", 0.8)}
