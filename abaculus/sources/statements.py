"""Statements from cells, tables and texts: rules, headers, blocks, banks, accounts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.functions.accounts import normalize_account
from abaculus.functions.amounts import parse_amount
from abaculus.functions.dates import parse_date
from abaculus.functions.texts import half_width
from abaculus.operators.sizes import broadcast_if_small

MONEY = "decimal(20,2)"
FIELDS = ("trade_date", "payment", "receipt", "balance", "counterparty", "summary", "txn_id")


@dataclass
class BankRule:
    """Where a bank's sheets hold what; columns and rows count from one."""

    bank: str
    account_cell: tuple[int, int]
    start_row: int
    columns: dict[str, int]
    payment_sign: int = -1
    skip_sheets: tuple[str, ...] = ()
    expected_headers: dict[str, list[str]] = field(default_factory=dict)
    multi_account: bool = False


def rows_by_number(cells: DataFrame) -> DataFrame:
    """One row per sheet row: (file, sheet, row, values), a map from column number to text."""
    return cells.groupBy("file", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("values"))


def _ledger_columns(get, sign: int) -> dict[str, Column]:
    pay = parse_amount(get("payment"))
    return {
        "trade_date": parse_date(get("trade_date")),
        "payment": (-F.abs(pay) if sign < 0 else pay).cast(MONEY),
        "receipt": parse_amount(get("receipt")).cast(MONEY),
        "balance": parse_amount(get("balance")).cast(MONEY),
        "counterparty": F.trim(get("counterparty")),
        "summary": F.trim(get("summary")),
        "txn_id": normalize_account(get("txn_id")),
    }


def extract(cells: DataFrame, rule: BankRule) -> DataFrame:
    """Ledger rows of a bank's sheets: all but those to skip, from the start row, with a date.

    A sheet without an account keeps its rows with a null account. With ``multi_account`` the
    sheet's stacked blocks each have their own (S9).
    """
    used = cells.where(~F.col("sheet").isin(list(rule.skip_sheets))) if rule.skip_sheets else cells
    if rule.multi_account:
        blocks = account_blocks(used)
        rows = rows_by_number(used).join(blocks, ["file", "sheet"]).where((F.col("row") >= F.col("data_start_row")) & (F.col("row") <= F.col("data_end_row")))
    else:
        row, col = rule.account_cell
        account = used.where((F.col("row") == row) & (F.col("col") == col)).select("file", "sheet", normalize_account(F.regexp_replace("value", r"^.*[:：]\s*", "")).alias("account"))
        rows = rows_by_number(used.where(F.col("row") >= rule.start_row)).join(account, ["file", "sheet"], "left")
    get = lambda f: F.element_at("values", F.lit(rule.columns[f])) if f in rule.columns else F.lit(None).cast("string")
    found = rows.select("file", "sheet", "row", F.lit(rule.bank).alias("bank"), F.nullif("account", F.lit("")).alias("account"), *[c.alias(n) for n, c in _ledger_columns(get, rule.payment_sign).items()])
    return found.where("trade_date is not null")


#: Fixed value: what stands before an account.
ACCOUNT_LABEL = r"(?i)账\s*号|账\s*户|卡\s*号|account"


def account_blocks(cells: DataFrame) -> DataFrame:
    """(file, sheet, account, header_row, data_start_row, data_end_row) of stacked account blocks.

    A block opens at a row with an account label and a number of six or more digits; its header is the
    first later row with three or more cells. Blocks without data are dropped.
    """
    by_row = cells.groupBy("file", "sheet", "row").agg(F.concat_ws(" ", F.array_sort(F.collect_list("value"))).alias("text"), F.count_if(F.trim("value") != "").alias("n"))
    marked = by_row.withColumn("found", F.when(F.col("text").rlike(ACCOUNT_LABEL), F.nullif(F.regexp_extract("text", r"(\d{6,})", 1), F.lit(""))))
    so_far = Window.partitionBy("file", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumns({"account": F.last("found", ignorenulls=True).over(so_far), "block": F.count("found").over(so_far)}).where("account is not null and found is null and n >= 3")
    first = filled.groupBy("file", "sheet", "block").agg(F.first("account").alias("account"), F.min("row").alias("header_row"), F.max("row").alias("data_end_row"))
    return first.where("data_end_row > header_row").select("file", "sheet", "account", "header_row", (F.col("header_row") + 1).alias("data_start_row"), "data_end_row")


def header_problems(cells: DataFrame, rule: BankRule) -> DataFrame:
    """(file, sheet, field, found, expected) of header cells with none of the accepted names."""
    wanted = [F.struct(F.lit(f).alias("field"), F.lit(rule.columns[f]).alias("col"), F.array(*map(F.lit, names)).alias("expected")) for f, names in rule.expected_headers.items() if f in rule.columns]
    sheets = cells.select("file", "sheet").distinct()
    if not wanted:
        return sheets.where(F.lit(False)).select("file", "sheet", F.lit("").alias("field"), F.lit("").alias("found"), F.array().cast("array<string>").alias("expected"))
    header = cells.where(F.col("row") == rule.start_row - 1).select("file", "sheet", "col", F.trim("value").alias("found"))
    checks = sheets.select("file", "sheet", F.inline(F.array(*wanted))).join(header, ["file", "sheet", "col"], "left")
    return checks.where(~F.coalesce(F.array_contains("expected", F.col("found")), F.lit(False))).select("file", "sheet", "field", "found", "expected")


def validated(rows: DataFrame, problems: DataFrame, mode: str = "warn") -> DataFrame:
    """Rows as they are (off, warn: with a flag), or a failing job at the first problem (strict)."""
    if mode == "off":
        return rows
    flagged = rows.join(problems.select("file", "sheet").distinct().withColumn("header_problem", F.lit(True)), ["file", "sheet"], "left").withColumn("header_problem", F.coalesce("header_problem", F.lit(False)))
    if mode == "warn":
        return flagged
    return flagged.withColumn("header_problem", F.when(F.col("header_problem"), F.raise_error(F.concat(F.lit("header mismatch in "), F.col("file")))).otherwise(F.lit(False)))


#: Header texts by field, for sheets whose template is inferred.
SHEET_WORDS = {
    "trade_date": ["交易日期", "交易时间日期", "记账日期", "日期", "交易日期时间", "发生日期", "业务日期", "入账日期", "账务日期", "交易发生日期", "transdate", "transactiondate", "date", "交易日期/时间"],
    "payment": ["支出金额", "支出", "借方金额", "付款金额", "付款", "借方发生额", "支出(元)", "借方", "付款(元)", "转出金额", "转出", "debit", "payment", "withdrawal", "支出金额(元)"],
    "receipt": ["收入金额", "收入", "贷方金额", "收款金额", "收款", "贷方发生额", "收入(元)", "贷方", "收款(元)", "转入金额", "转入", "credit", "receipt", "deposit", "收入金额(元)"],
    "balance": ["余额", "账户余额", "当前余额", "可用余额", "实时余额", "balance", "账面余额", "结余"],
    "counterparty": ["对方户名", "对方名称", "交易对方", "对方账户名", "对方", "对方姓名", "交易对方名称", "收付款人", "付款人", "收款人", "counterpart", "对方信息", "交易描述/对方", "对方账户名称"],
    "summary": ["摘要", "交易摘要", "用途", "备注", "交易备注", "交易用途", "摘要/备注", "说明", "交易说明", "摘要说明", "summary", "description", "remark"],
    "txn_id": ["交易流水号", "流水号", "交易号", "凭证号码", "交易编号", "交易序号", "业务流水号", "交易参考号", "参考号", "transactionid", "reference", "refno"],
}
#: Words inside the header cells of each field, for tables taken from documents.
TABLE_WORDS = {
    "trade_date": ["交易日期", "记账日期", "日期", "Date", "Trade Date"],
    "payment": ["支出", "付出", "付款", "借方", "支取", "Debit", "Withdrawal", "支出金额", "借方发生额"],
    "receipt": ["收入", "存入", "收款", "贷方", "Credit", "Deposit", "收入金额", "贷方发生额"],
    "amount": ["金额", "交易金额", "Amount"],
    "direction": ["借贷标志", "借贷", "收付", "方向"],
    "summary": ["摘要", "用途", "备注", "附言", "说明", "Description", "Remark", "Summary"],
    "counterparty": ["对方户名", "对方单位", "收款人", "付款人", "对方名称", "交易对手", "Counterparty", "Beneficiary"],
    "counterpart_account": ["对方账号", "对方账户"],
    "counterpart_bank": ["对方开户行", "对方银行"],
    "balance": ["余额", "结余", "Balance"],
    "txn_id": ["交易流水号", "流水号", "交易编号", "凭证号", "Reference No", "Transaction ID"],
    "currency": ["币种", "货币", "Currency"],
}


def header_text(c: Column) -> Column:
    """Cell text for comparing headers: half-width, lower-cased, without blanks."""
    return F.lower(F.regexp_replace(half_width(F.trim(c)), r"\s+", ""))


def header_score(text: Column, words: list[str]) -> Column:
    """1.0 for an equal word, 0.9 for one at an end, 0.7 inside, 0.5 around the text; the best of all.
    ``text`` is as ``header_text`` gives it."""
    one = lambda w: F.when(text == w, 1.0).when(text.startswith(w) | text.endswith(w), 0.9).when(text.contains(w), 0.7).when((text != "") & w.contains(text), 0.5).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(F.array(*[F.lit(w.replace(" ", "").lower()) for w in words]), one)), F.lit(0.0))


def infer_templates(cells: DataFrame, top: int = 30, least: float = 0.7) -> DataFrame:
    """(file, sheet, header_row, fields, confidence): the first row with two cells that score, the best column
    per field, and 0.5 * share of fields + 0.25 with an account + 0.25 with a date (S11, A23)."""
    head = cells.where(F.col("row") <= top)
    scores = F.array(*[F.struct(F.lit(f).alias("field"), header_score(F.col("text"), ws).alias("score")) for f, ws in SHEET_WORDS.items()])
    named = head.select("file", "sheet", "row", "col", header_text(F.col("value")).alias("text"))
    if least > 0.5:  # so good a text holds a word whole; others, nearly all cells, are neither dealt out nor scored
        words = {w.replace(" ", "").lower() for ws in SHEET_WORDS.values() for w in ws}
        named = named.where(F.col("text").rlike("|".join(map(re.escape, sorted(words)))))
    known = named.select("text").distinct().select("text", F.inline(scores)).where(F.col("score") >= least)  # each text is scored once
    scored = named.join(broadcast_if_small(known), "text").drop("text")
    header = scored.groupBy("file", "sheet", "row").agg(F.countDistinct("col").alias("n")).where("n >= 2").groupBy("file", "sheet").agg(F.min("row").alias("header_row"))
    best = scored.join(header, ["file", "sheet"]).where("row = header_row").groupBy("file", "sheet", "header_row", "field").agg(F.min_by("col", F.struct((-F.col("score")).alias("s"), "col")).alias("col"))
    accounts = head.groupBy("file", "sheet").agg(F.max(F.col("value").rlike(ACCOUNT_LABEL) | F.col("value").rlike(r"^\d{6,30}$")).alias("has_account"))
    fields = best.groupBy("file", "sheet", "header_row").agg(F.array_sort(F.collect_list(F.struct("field", "col"))).alias("fields"))
    sure = 0.5 * F.size("fields") / len(SHEET_WORDS) + F.when(F.col("has_account"), 0.25).otherwise(0.0) + F.when(F.exists("fields", lambda f: f["field"] == "trade_date"), 0.25).otherwise(0.0)
    return fields.join(accounts, ["file", "sheet"]).select("file", "sheet", "header_row", "fields", F.round(sure, 2).alias("confidence"))


def _table_fields(text: Column) -> Column:
    """The fields, in the order of TABLE_WORDS, of which a word stands in a header cell; letter case counts."""
    plain = F.trim(half_width(text))
    return F.array_compact(F.array(*[F.when(plain.rlike("|".join(words)), F.lit(f)) for f, words in TABLE_WORDS.items()]))


def table_header(cells: DataFrame, rows: int = 10, least: int = 3) -> DataFrame:
    """(file, sheet, header_row) of extracted tables: of the first rows that name ``least`` fields the one that names most, the earliest on a tie."""
    counts = cells.where(F.col("row") <= rows).select("file", "sheet", "row", F.explode(_table_fields(F.col("value"))).alias("field")).groupBy("file", "sheet", "row").agg(F.countDistinct("field").alias("n")).where(F.col("n") >= least)
    return counts.groupBy("file", "sheet").agg(F.min_by("row", F.struct((-F.col("n")).alias("n"), "row")).alias("header_row"))


def table_columns(cells: DataFrame, header: DataFrame) -> DataFrame:
    """(file, sheet, field, col): of each field the first header cell that names it; one cell may stand for several."""
    of_header = cells.join(header, ["file", "sheet"]).where("row = header_row")
    return of_header.select("file", "sheet", "col", F.explode(_table_fields(F.col("value"))).alias("field")).groupBy("file", "sheet", "field").agg(F.min("col").alias("col"))


#: Marks of a payment in a direction column.
PAYMENT_MARKS = ["借", "支出", "付款", "付", "debit", "dr"]


def table_rows(rows: DataFrame) -> DataFrame:
    """Signed amounts from texts: two columns, or one amount with a direction or its own sign; rows without a date go.

    ``rows``: trade_date, payment, receipt, amount, direction, balance and others as text.
    """
    pay, get, one = (parse_amount(F.col(c)) for c in ("payment", "receipt", "amount"))
    mark = F.lower(F.trim("direction"))
    known = F.coalesce(F.length(mark) > 0, F.lit(False))
    out = F.when(known, mark.isin(PAYMENT_MARKS)).otherwise(one < 0)
    payment, receipt = F.coalesce(-F.abs(pay), F.when(out, -F.abs(one))), F.coalesce(F.abs(get), F.when(~out, F.abs(one)))
    single = pay.isNull() & get.isNull()
    kept = [c for c in rows.columns if c not in ("trade_date", "payment", "receipt", "amount", "direction", "balance")]
    found = rows.select(*kept, parse_date(F.col("trade_date")).alias("trade_date"), F.when(single, payment).otherwise(-F.abs(pay)).cast(MONEY).alias("payment"), F.when(single, receipt).otherwise(F.abs(get)).cast(MONEY).alias("receipt"), parse_amount(F.col("balance")).cast(MONEY).alias("balance"))
    return found.where("trade_date is not null")


#: A date and an amount in a line of text.
LINE_DATE, LINE_AMOUNT = r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})", r"-?\d[\d,]*\.\d{2}"


def text_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Movements in free text: lines of ten or more characters with a date and amounts after it; the first amount moves,
    the last of several is the balance (S16). Amounts are only sought after the date, whose digits are none."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where((F.length("line") >= 10) & F.col("line").rlike(LINE_DATE))
    found = lines.withColumns({"date_text": F.regexp_extract("line", LINE_DATE, 1), "rest": F.regexp_replace("line", f"^.*?{LINE_DATE}", "")})
    found = found.withColumn("amounts", F.regexp_extract_all("rest", F.lit(LINE_AMOUNT), F.lit(0))).where(F.size("amounts") > 0)
    first = parse_amount(F.col("amounts")[0])
    return found.select(
        key, "line_no", parse_date(F.col("date_text")).alias("trade_date"), F.when(first < 0, first).alias("payment"), F.when(first >= 0, first).alias("receipt"),
        F.when(F.size("amounts") > 1, parse_amount(F.element_at("amounts", -1))).alias("balance"),
    )


def identify_bank_by_text(texts: DataFrame, banks: dict[str, list[str]], key: str, text: str = "text") -> DataFrame:
    """(key, bank, score): the bank whose keywords found in the text are longest in sum; the first on a tie."""
    upper = F.upper(F.regexp_replace(text, r"\s+", ""))
    scores = []
    for n, (bank, words) in enumerate(banks.items()):
        stripped = [w.replace(" ", "").upper() for w in words]
        scores.append(F.struct(sum((F.when(upper.contains(w), len(w)).otherwise(0) for w in stripped), F.lit(0)).alias("score"), F.lit(-n).alias("order"), F.lit(bank).alias("bank")))
    best = F.array_max(F.array(*scores))
    return texts.select(key, best["bank"].alias("bank"), best["score"].alias("score")).where("score > 0")


#: Patterns of an account in a text, tried in order.
ACCOUNT_PATTERNS = (r"(?:账\s*号|账\s*户)[：:\s]*([0-9]{6,25}[-\s]?[0-9]*)", r"(?i)(?:account|a/c|acct)[：:\s#]*([0-9]{6,25}[-\s]?[0-9]*)", r"(\d{16,22})")


def account_in_text(text: Column, least: int = 6) -> Column:
    """The first account of at least ``least`` digits, without hyphens and blanks."""
    found = [F.regexp_replace(F.regexp_extract(text, p, 1), r"[-\s]", "") for p in ACCOUNT_PATTERNS]
    return F.coalesce(*[F.when(F.length(f) >= least, f) for f in found])


def lookup_entries(cells: DataFrame) -> DataFrame:
    """Lookup rows of a sheet: subject and account by header (else the first two columns), priority, others as extra."""
    rows = rows_by_number(cells)
    header = rows.where("row = 1").select("file", "sheet", F.col("values").alias("names"))
    joined = rows.where("row > 1").join(header, ["file", "sheet"])
    named = joined.withColumn("entry", F.map_from_entries(F.transform(F.map_entries("values"), lambda e: F.struct(F.coalesce(F.element_at("names", e["key"]), e["key"].cast("string")), e["value"]))))
    get = lambda *names: F.coalesce(*[F.element_at("entry", F.lit(n)) for n in names])
    known = ["主体名称", "主体", "银行账号", "账号", "优先级"]
    subject, account = F.coalesce(get("主体名称", "主体"), F.element_at("values", F.lit(1))), F.coalesce(get("银行账号", "账号"), F.element_at("values", F.lit(2)))
    found = named.select(
        subject.alias("subject"), normalize_account(account).alias("account"), F.coalesce(get("优先级").try_cast("int"), F.lit(0)).alias("priority"),
        F.map_filter("entry", lambda k, v: ~k.isin(known) & k.rlike(r"\D")).alias("extra"), F.col("row").cast("long").alias("row_id"),
    )
    return found.where("account <> ''")


def personal_rows(cells: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Bill rows by header names with alternatives; rows without amount, merchant and summary go."""
    rows = rows_by_number(cells)
    names = [n for ns in columns.values() for n in ns]
    matched = F.size(F.array_intersect(F.map_values("values"), F.array(*map(F.lit, names))))
    header = rows.withColumn("matched", matched).where("matched >= 2").groupBy("file", "sheet").agg(F.min_by(F.struct("row", "values"), F.struct((-F.col("matched")).alias("m"), "row")).alias("h"))
    joined = rows.join(header, ["file", "sheet"]).where("row > h.row")
    by_name = F.map_from_entries(F.transform(F.map_entries("values"), lambda e: F.struct(F.coalesce(F.trim(F.element_at("h.values", e["key"])), e["key"].cast("string")), e["value"])))
    named = joined.withColumn("entry", by_name)
    found = named.select("file", "sheet", "row", *[F.coalesce(*[F.element_at("entry", F.lit(n)) for n in ns]).alias(f) for f, ns in columns.items()])
    text = lambda c: F.coalesce(F.trim(c), F.lit("")) if c in columns else F.lit("")
    amount = F.coalesce(parse_amount(F.col("amount")), F.lit(0).cast(MONEY)) if "amount" in columns else F.lit(0).cast(MONEY)
    return found.where((amount != 0) | (text("merchant") != "") | (text("summary") != ""))


@dataclass(frozen=True)
class Card:
    """A kind of personal card bill: words of its file names, and its header texts."""

    name: str
    file_words: tuple[str, ...] = ()
    headers: tuple[str, ...] = ()
    enabled: bool = True


def _best_card(cards: list[Card], score: Callable[[Card], Column], least: int) -> Column:
    """The name of the enabled card with the highest score of ``least`` or more, the first on a tie; else null."""
    known = [F.struct(score(c).cast("int").alias("score"), F.lit(-i).alias("order"), F.lit(c.name).alias("name")) for i, c in enumerate(cards) if c.enabled]
    if not known:
        return F.lit(None).cast("string")
    best = F.array_max(F.array(*known))
    return F.when(best["score"] >= least, best["name"])


def personal_bank_by_name(name: Column, cards: list[Card]) -> Column:
    """The card most of whose file words stand in the file name, in any case."""
    lower = F.coalesce(F.lower(name), F.lit(""))
    return _best_card(cards, lambda c: sum((lower.contains(w.lower()).cast("int") for w in c.file_words), F.lit(0)), 1)


def personal_bank_by_headers(headers: Column, cards: list[Card]) -> Column:
    """The card that shares most header texts, two or more, with an array of header cells."""
    seen = F.array_distinct(F.transform(F.filter(F.coalesce(headers, F.array().cast("array<string>")), lambda h: F.coalesce(h, F.lit("")) != ""), F.trim))
    return _best_card(cards, lambda c: F.size(F.array_intersect(seen, F.array(*map(F.lit, dict.fromkeys(c.headers))))) if c.headers else F.lit(0), 2)
