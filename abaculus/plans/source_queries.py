"""Queries of statement parsing, search and streaming over the text and event tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abaculus.adapters import LEDGER_SQL, ledger, read
from abaculus.functions import accounts, amounts, masks
from abaculus.operators import attachments, impact, knowledge, rule_tables, rules
from abaculus.operators.query import first_per_key
from abaculus.plans.ledger_queries import K as KEYED
from abaculus.plans.ledger_queries import QUERIES, SQL, keyed, register
from abaculus.sources import cells, files, ranged, statements, tables, workbooks
from abaculus.streaming import ingest, progress, routing, stability

L = LEDGER_SQL
RANGE_ROWS = 250_000  # rows of a database's range, about


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; on a single machine without one, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="abaculus-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as statement sheets: one file per bank, one sheet per account, account in B1, headers in row 2."""
    df = ledger(spark, sf_dir)
    row = F.row_number().over(Window.partitionBy("bank", "account").orderBy("trade_date", "txn_uid")) + 2
    body = df.withColumn("row", row).select(
        F.col("bank").alias("file"), F.col("account").alias("sheet"), "row",
        F.inline(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in enumerate(
            [F.date_format("trade_date", "yyyy/MM/dd"), F.format_number(F.abs("payment"), 2), F.format_number("receipt", 2), F.col("counterparty"), F.col("summary"), F.col("txn_id")], 1)])),
    ).where("value is not null")
    sheets = df.select(F.col("bank").alias("file"), F.col("account").alias("sheet")).distinct()
    heads = [(1, 1, F.lit("账号")), (1, 2, F.col("sheet"))] + [(2, c, F.lit(h)) for c, h in enumerate(["交易日期", "支出金额", "收入金额", "对方户名", "摘要", "交易流水号"], 1)]
    head = sheets.select("file", "sheet", F.inline(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("value")) for r, c, v in heads])))
    return body.unionByName(head)


def nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of one CSV file per region, with the region in its folder's name, and a file of another kind; scanned."""
    folder = shared_folder(spark, "files")
    nations = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").repartition("n_regionkey").sortWithinPartitions("n_nationkey")
    nations.write.partitionBy("n_regionkey").option("header", "true").option("sep", ";").csv(folder)
    nations.select(F.col("n_name").alias("value")).coalesce(1).write.text(f"{folder}/notes")
    return files.with_format(files.scan(spark, folder)).withColumn("region", F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int"))


@register("s1_scanned_files", "select n_regionkey as region, 'csv' as format, count(distinct n_regionkey) as n from nation group by all", nation_files)
def _(df):
    return df.groupBy("region", "format").agg(F.count(F.lit(1)).alias("n"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file per region with the first bytes of an archive, a document or a table, those of regions above 2 named .PDF; all scanned."""
    folder = shared_folder(spark, "documents")
    k = F.col("r_regionkey") % 3
    read(spark, sf_dir, "region").select("r_regionkey", F.when(k == 0, "PK\x03\x04 archive").when(k == 1, "%PDF-1.7").otherwise(F.col("r_name")).alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").csv(folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/r_regionkey=*/*.csv")):  # a file per region
        region = int(found.getPath().getParent().getName().split("=")[1])
        if region > 2:
            store.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(f"{found.getPath().getParent().toString()}/{region}.PDF"))
    return files.with_format(files.scan_all(spark, folder)).withColumn("region", F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("int"))


@register("s2_document_scan", "select r_regionkey::int as region, case r_regionkey % 3 when 0 then 'xlsx' when 1 then 'pdf' else case when r_regionkey > 2 then 'pdf' else 'csv' end end as format, case when r_regionkey > 2 then 'PDF' else 'csv' end as extension from region", document_files)
def _(df):
    return df.select("region", "format", F.regexp_extract("name", "([^.]+)$", 1).alias("extension"))


@register("s5_csv_cells", """with r as (select n_regionkey as region, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) + 1 as row from nation)
select region, cast(row as integer) as row, 1 as col, cast(n_nationkey as varchar) as value from r union all select region, cast(row as integer), 2, n_name from r
union all select distinct n_regionkey, 1, 1, 'n_nationkey' from nation union all select distinct n_regionkey, 1, 2, 'n_name' from nation""", nation_files)
def _(df):
    regions = df.select(F.col("path").alias("file"), "region")
    return cells.read_cells(df).join(regions, "file").select("region", "row", "col", "value")


def ledger_workbooks(spark: SparkSession, sf_dir: str, **asked) -> DataFrame:
    """The statement sheets as a folder of workbooks, written by tasks and read again by row ranges."""
    folder = shared_folder(spark, "workbooks")
    workbooks.write_cells(statement_cells(spark, sf_dir), folder)
    return workbooks.read_workbooks(spark, folder, rows=500, **asked)


RULE = statements.BankRule("any", (1, 2), 3, {"trade_date": 1, "payment": 2, "receipt": 3, "counterparty": 4, "summary": 5, "txn_id": 6}, expected_headers={"trade_date": ["交易日期"], "payment": ["付款"], "receipt": ["收入金额", "收款"]})


@register("s8_rule_extract", f"{L} select txn_id, account, trade_date, payment, receipt, counterparty, summary from ledger", statement_cells)
def _(df):
    return statements.extract(df, RULE).select("txn_id", "account", "trade_date", "payment", "receipt", "counterparty", "summary")


@register("s4_workbook_rows", f"{L} select txn_id, account, trade_date, payment, receipt, counterparty, summary from ledger", ledger_workbooks)
def _(df):
    return statements.extract(df, RULE).select("txn_id", "account", "trade_date", "payment", "receipt", "counterparty", "summary")


@register("s6_row_ranges", f"""{L}, r as (select bank, account, row_number() over (partition by bank, account order by trade_date, txn_uid) + 2 as row, strftime(trade_date, '%Y/%m/%d') as day, txn_id from ledger)
select account as sheet, cast(row as integer) as row, 1 as col, day as value from r where row between 11 and 40 union all select account, cast(row as integer), 6, txn_id from r where row between 11 and 40""", lambda s, d: ledger_workbooks(s, d, first_row=11, last_row=40, columns=[1, 6]))
def _(df):
    return df.select("sheet", "row", "col", "value")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, folder = ledger(spark, sf_dir), shared_folder(spark, "report")
    banks = df.groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.sum("receipt").alias("received"))
    years = df.groupBy(F.year("trade_date").alias("year")).agg(F.count_distinct("account").alias("accounts"))
    workbooks.write_report({"banks": (banks, [F.col("bank")]), "years": (years, [F.col("year")])}, folder, "report")
    return workbooks.read_workbooks(spark, folder).select("sheet", "row", "col", "value")


QUERIES["k10_report_sheets"] = _report
SQL["k10_report_sheets"] = f"""{L}, b as (select row_number() over (order by bank) + 1 as row, * from (select bank, count(*) as n, sum(receipt) as received from ledger group by bank)),
y as (select row_number() over (order by year) + 1 as row, * from (select year(trade_date) as year, count(distinct account) as accounts from ledger group by 1)),
c as (select 'banks' as sheet, row, unnest([1, 2, 3]) as col, unnest([bank, n::varchar, received::varchar]) as value from b union all select 'years', row, unnest([1, 2]), unnest([year::varchar, accounts::varchar]) from y
union all select 'banks', 1, unnest([1, 2, 3]), unnest(['bank', 'n', 'received']) union all select 'years', 1, unnest([1, 2]), unnest(['year', 'accounts']))
select sheet, row::int as row, col, value from c where value is not null"""


@register("s9_account_blocks", f"{L}, n as (select bank as file, account, count(*) as n from ledger group by all) select file, account, 2 as header_row, 3 as data_start_row, n + 2 as data_end_row from n", statement_cells)
def _(df):
    return statements.account_blocks(df).select("file", "account", "header_row", "data_start_row", "data_end_row")


@register("s10_header_problems", f"{L} select distinct bank as file, account as sheet, 'payment' as field, '支出'||substr(account, -2) as found from ledger where substr(account, -1) <> '7'", statement_cells)
def _(df):
    # payment headers that end in the account's last digits; those of accounts on 7 are as expected
    title = F.when(F.col("sheet").endswith("7"), "付款").otherwise(F.concat(F.lit("支出"), F.right("sheet", F.lit(2))))
    df = df.withColumn("value", F.when((F.col("row") == 2) & (F.col("col") == 2), title).otherwise(F.col("value")))
    return statements.header_problems(df, RULE).select("file", "sheet", "field", "found")


@register("s11_template_inference", f"{L}, k as (select distinct bank, account, length(bank) % 3 as k from ledger) select bank as file, account as sheet, 2 + k as header_row, case when k = 0 then 5 else 6 end as n_fields, case when k = 0 then 0.86 else 0.93 end as confidence from k", statement_cells)
def _(df):
    # notes stand above the header; without notes the header lacks the summary's title
    k = F.length("file") % 3
    df = df.where(~((F.col("row") == 2) & (F.col("col") == 5) & (k == 0)))
    df = df.withColumn("row", F.when(F.col("row") > 1, F.col("row") + k).otherwise(F.col("row")))
    return statements.infer_templates(df).select("file", "sheet", "header_row", F.size("fields").alias("n_fields"), "confidence")


def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement sheets as tables of documents: two columns of amounts, one with a direction, or names of two fields
    only, by the account's last digit; notes stand above the header, as many rows as the file's name asks for."""
    df = statement_cells(spark, sf_dir)
    digit = F.right("sheet", F.lit(1)).cast("int")
    title = F.when(digit % 3 == 1, F.element_at(F.array(*map(F.lit, ["记账日期", "金额", "借贷标志", "余额", "币种", "对方开户行"])), F.col("col"))).when(digit % 3 == 2, F.element_at(F.array(*map(F.lit, ["日期", "金额", "?", "?", "?", "?"])), F.col("col"))).otherwise(F.col("value"))
    header = F.col("row") == 2
    return df.withColumns({"value": F.when(header, title).otherwise(F.col("value")), "row": F.when(F.col("row") > 1, F.col("row") + F.length("file") % 3).otherwise(F.col("row"))})


@register("s13_table_header", f"{L} select distinct bank as file, account as sheet, 2 + length(bank) % 3 as header_row from ledger where cast(right(account, 1) as integer) % 3 <> 2", document_tables)
def _(df):
    return statements.table_header(df)


@register("s15_table_columns", f"""{L}, a as (select distinct bank as file, account as sheet, cast(right(account, 1) as integer) % 3 as k from ledger)
select file, sheet, unnest(['trade_date', 'payment', 'receipt', 'amount', 'counterparty', 'summary', 'txn_id']) as field, unnest([1, 2, 3, 2, 4, 5, 6]) as col from a where k = 0
union all select file, sheet, unnest(['trade_date', 'amount', 'direction', 'balance', 'currency', 'counterpart_bank']), unnest([1, 2, 3, 4, 5, 6]) from a where k = 1""", document_tables)
def _(df):
    return statements.table_columns(df, statements.table_header(df)).select("file", "sheet", "field", "col")


@register("j13_rule_impact", f"{L} select case when payment is null then '未变' else '变更' end as change, count(*) as n from ledger group by 1", statement_cells)
def _(df):
    other = statements.BankRule(RULE.bank, RULE.account_cell, RULE.start_row, RULE.columns, payment_sign=1)
    changes = impact.rule_impact(df, lambda c: statements.extract(c, RULE), lambda c: statements.extract(c, other), ("payment", "receipt", "summary"))
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@register("s18_bank_by_cells", f"{L}, b as (select distinct bank, length(bank) % 3 as k from ledger) select bank as file, case k when 0 then 'B1' else 'C9' end as bank from b where k < 2", statement_cells)
def _(df):
    # the account stays in B1, moves to C9, or loses its digits
    k = F.length("file") % 3
    df = df.where(~((F.col("row") == 9) & (F.col("col") == 3))).withColumns({
        "value": F.when((F.col("row") == 1) & (F.col("col") == 2) & (k == 2), "none").otherwise(F.col("value")),
        "col": F.when((F.col("row") == 1) & (F.col("col") == 2) & (k == 1), 3).otherwise(F.col("col")),
        "row": F.when((F.col("row") == 1) & (F.col("col") == 2) & (k == 1), 9).otherwise(F.col("row")),
    })
    return files.identify_by_cells(df, {"B1": (1, 2), "C9": (9, 3)})


@register("s7_effective_rows", f"{L}, r as (select account, row_number() over (partition by bank, account order by trade_date, txn_uid) + 2 as r, bank from ledger) select bank as file, count(*) as n from r where r <= 20 group by bank", statement_cells)
def _(df):
    sparse = df.where("row > 2").withColumn("row", F.when(F.col("row") > 20, F.col("row") + 50).otherwise(F.col("row")))
    kept = cells.effective_rows(sparse, 10)
    return kept.select("file", "sheet", "row").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, none = ledger(spark, sf_dir), F.lit(None).cast("string")
    k = F.col("o_orderkey") % 3
    amount = F.coalesce("payment", "receipt")
    return df.select(
        "txn_uid", F.date_format("trade_date", "yyyyMMdd").alias("trade_date"),
        F.when(k == 0, F.abs("payment").cast("string")).alias("payment"), F.when(k == 0, F.col("receipt").cast("string")).alias("receipt"),
        F.when(k == 1, F.abs(amount).cast("string")).when(k == 2, amount.cast("string")).alias("amount"),
        F.when(k == 1, F.when(F.col("payment").isNotNull(), "借").otherwise("贷")).alias("direction"), none.alias("balance"),
    )


@register("s15_table_rows", f"{L} select txn_uid, trade_date, payment, receipt from ledger", raw_rows)
def _(df):
    return statements.table_rows(df).select("txn_uid", "trade_date", "payment", "receipt")


@register("s16_text_rows", f"{L} select txn_uid, trade_date, payment, receipt, cast(7.50 as decimal(20,2)) as balance from ledger")
def _(df):
    text = F.concat(F.lit("header\n"), F.date_format("trade_date", "yyyy-MM-dd"), F.lit(" moved "), F.format_number(F.coalesce("payment", "receipt"), 2), F.lit(" then 7.50\nend"))
    return statements.text_rows(df.select("txn_uid", text.alias("text")), "txn_uid").select("txn_uid", "trade_date", "payment", "receipt", "balance")


def labelled_accounts(events: DataFrame) -> DataFrame:
    key, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("账 号：6222"), F.lpad(key, 10, "0"))).when(k == 1, F.concat(F.lit("账户 62-"), key)).when(k == 2, F.concat(F.lit("A/C # 1234567-"), key, F.lit(" of 99998888777766665555")))
    return events.select((F.col("event_id") + 1000000000).alias("doc_id"), text.otherwise(F.concat(F.lit("account 123 or 400000"), F.lpad(key, 12, "0"))).alias("text"))


BANKS = {"first": ["the", "and of"], "second": ["des", "une la"], "third": ["los", "que"]}


@register("s19_bank_by_text", """with d as (select doc_id, upper(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) as t from documents),
s as (select doc_id, case when contains(t,'THE') then 3 else 0 end + case when contains(t,'ANDOF') then 5 else 0 end as a, case when contains(t,'DES') then 3 else 0 end + case when contains(t,'UNELA') then 5 else 0 end as b, case when contains(t,'LOS') then 3 else 0 end + case when contains(t,'QUE') then 3 else 0 end as c from d)
select doc_id, case when a >= b and a >= c then 'first' when b >= c then 'second' else 'third' end as bank, greatest(a, b, c) as score from s where greatest(a, b, c) > 0""", lambda s, d: read(s, d, "documents"))
def _(df):
    return statements.identify_bank_by_text(df, BANKS, "doc_id")


@register("s20_account_in_text", r"""with d as (select doc_id, text from documents union all select event_id + 1000000000, case event_id % 4 when 0 then '账 号：6222'||lpad(event_id::varchar, 10, '0') when 1 then '账户 62-'||event_id
  when 2 then 'A/C # 1234567-'||event_id||' of 99998888777766665555' else 'account 123 or 400000'||lpad(event_id::varchar, 12, '0') end from events),
f as (select doc_id, [regexp_extract(text, '(?:账[ \t\n\x0B\f\r]*号|账[ \t\n\x0B\f\r]*户)[：:\s]*([0-9]{6,25}[-\s]?[0-9]*)', 1), regexp_extract(text, '(?i)(?:account|a/c|acct)[：:\s#]*([0-9]{6,25}[-\s]?[0-9]*)', 1), regexp_extract(text, '([0-9]{16,22})', 1)] as found from d),
a as (select doc_id, list_filter(list_transform(found, lambda x: regexp_replace(x, '[-\s]', '', 'g')), lambda x: length(x) >= 6) as found from f)
select doc_id, found[1] as account from a where len(found) > 0""", lambda s, d: read(s, d, "documents").select("doc_id", "text").unionByName(labelled_accounts(read(s, d, "events"))))
def _(df):
    return df.select("doc_id", statements.account_in_text(F.col("text")).alias("account")).where("account is not null")


@register("s17_bank_by_name", "select c_custkey, case when c_custkey % 4 = 0 then '工商银行' when c_custkey % 4 = 1 then '招商银行' end as bank from customer", lambda s, d: read(s, d, "customer"))
def _(df):
    n, key = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    name = F.when(key == 0, F.concat(F.lit("Ｉ Ｃ Ｂ Ｃ_"), n, F.lit(".xlsx"))).when(key == 1, F.concat(F.lit("2024 招商-银行 "), n, F.lit(".csv"))).otherwise(F.concat(F.lit("other"), n, F.lit(".xls")))
    return files.identify_bank(df.select("c_custkey", name.alias("name")), {"工商银行": ["工商银行", "ICBC"], "招商银行": ["招商银行", "CMB"]}).select("c_custkey", "bank")


SHAPES_SQL = """with v as (select event_id, event_id % 7 as k, case event_id % 7 when 0 then '2024-01-'||lpad(cast(event_id % 28 + 1 as varchar), 2, '0') when 1 then 'TXN'||lpad(cast(event_id as varchar), 9, '0')
  when 2 then '622 '||lpad(cast(event_id as varchar), 12, '0') when 3 then '1,234.5' when 4 then cast(event_id % 10 as varchar) when 5 then '6221'||lpad(cast(event_id as varchar), 13, '0') else '' end as v from events)"""


@register("f17_mask_by_shape", f"""{SHAPES_SQL} select event_id, case k when 0 then substr(v, 1, 4)||'年'||substr(v, 6, 2)||'月' when 1 then substr(v, 1, 4)||repeat('*', length(v) - 4)
  when 2 then substr(v, 1, 3)||repeat('*', length(v) - 6)||substr(v, -3) when 3 then '[金额已隐藏]' when 5 then substr(v, 1, 4)||'年'||substr(v, 5, 2)||'月' else v end as masked from v""", lambda s, d: read(s, d, "events"))
def _(df):
    key = F.col("event_id").cast("string")
    shapes = [F.concat(F.lit("2024-01-"), F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0")), F.concat(F.lit("TXN"), F.lpad(key, 9, "0")), F.concat(F.lit("622 "), F.lpad(key, 12, "0")), F.lit("1,234.5"), (F.col("event_id") % 10).cast("string"), F.concat(F.lit("6221"), F.lpad(key, 13, "0")), F.lit("")]
    value = F.element_at(F.array(*shapes), (F.col("event_id") % 7 + 1).cast("int"))
    return df.select("event_id", masks.mask_by_shape(value).alias("masked"))


ISSUES = [
    knowledge.Issue("A", "login the page", ["error|idiot"], ["with slow"], ["this"]),
    knowledge.Issue("B", "de la", ["pass.*token"], ["une"], ["des", "les"]),
]
ISSUE_SQL = """with m as (select doc_id, text, lower(text) as t from documents),
s as (select doc_id, 'A' as bank, 'login the page' as title, least(1, case when regexp_matches(text, '(?i)error|idiot') then 0.40 else 0 end + case when contains(t,'with') or contains(t,'slow') then 0.15 else 0 end + case when contains(t,'login') or contains(t,'the') or contains(t,'page') then 0.10 else 0 end + case when contains(t,'this') then 0.10 else 0 end) as score from m
union all select doc_id, 'B', 'de la', least(1, case when regexp_matches(text, '(?i)pass.*token') then 0.40 else 0 end + case when contains(t,'une') then 0.15 else 0 end + case when contains(t,'de') or contains(t,'la') then 0.10 else 0 end + case when contains(t,'des') then 0.10 else 0 end + case when contains(t,'les') then 0.10 else 0 end) from m)"""


@register("a22_known_issues", f"{ISSUE_SQL} select doc_id, bank, title, cast(score as decimal(4,2)) as score from s where score >= 0.3", lambda s, d: read(s, d, "documents"))
def _(df):
    return knowledge.search(df, ISSUES).select("doc_id", "bank", "title", "score")


@register("g27_issue_statistics", f"{ISSUE_SQL} select bank, count(*) as n, count(distinct title) as issues from s where score >= 0.3 group by bank", lambda s, d: read(s, d, "documents"))
def _(df):
    return knowledge.statistics(knowledge.search(df, ISSUES))


SEARCH_SQL = """with m as (select conv_id||'-'||turn as msg, text, lower(text) as t, list_distinct(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) as w from conversations),
s as (select msg, 'A' as bank, 'login the page' as title, cast(case when regexp_matches(text, '(?i)error|idiot') then 0.40 else 0 end + case when contains(t,'with') or contains(t,'slow') then 0.15 else 0 end + case when contains(t,'login') or contains(t,'the') or contains(t,'page') then 0.10 else 0 end + case when contains(t,'this') then 0.10 else 0 end as double) as a,
  round(len(list_intersect(w, ['error','idiot'])) / 2 * 0.3 + len(list_intersect(w, ['with','slow'])) / 2 * 0.2 + len(list_intersect(w, ['login','the','page'])) / 3 * 0.25 + case when contains(t,'this') then 0.15 else 0 end, 6) as b from m
union all select msg, 'B', 'de la', cast(case when regexp_matches(text, '(?i)pass.*token') then 0.40 else 0 end + case when contains(t,'une') then 0.15 else 0 end + case when contains(t,'de') or contains(t,'la') then 0.10 else 0 end + case when contains(t,'des') then 0.10 else 0 end + case when contains(t,'les') then 0.10 else 0 end as double),
  round(len(list_intersect(w, ['pass','token'])) / 2 * 0.3 + len(list_intersect(w, ['une'])) * 0.2 + len(list_intersect(w, ['de','la'])) / 2 * 0.25 + case when contains(t,'des') then 0.15 else 0 end + case when contains(t,'les') then 0.15 else 0 end, 6) from m)
select msg, bank, title, max(greatest(case when a >= 0.3 then a end, case when b >= 0.05 then b end)) as score from s where a >= 0.3 or b >= 0.05 group by all"""


@register("o8_merged_search", SEARCH_SQL, lambda s, d: read(s, d, "conversations").withColumn("msg", F.concat_ws("-", "conv_id", "turn")))
def _(df):
    return knowledge.merged_results(knowledge.search(df, ISSUES), knowledge.keyword_search(df, ISSUES), "msg")


@register("f2_numeric_texts", """with v as (select event_id, case event_id % 7 when 0 then ' -'||event_id||' ' when 1 then event_id||',000' when 2 then 'TRUE' when 3 then event_id||'e3' when 4 then '' when 5 then event_type else '.'||event_id end as v from events)
select event_id, coalesce(lower(trim(v)) in ('true', 'false') or (try_cast(trim(v) as double) is not null and not contains(v, ',')), false) as is_numeric, case when contains(v, ',') then null else try_cast(trim(v) as double) end as number from v""", lambda s, d: read(s, d, "events"))
def _(df):
    key, k = F.col("event_id").cast("string"), F.col("event_id") % 7
    texts = [F.concat(F.lit(" -"), key, F.lit(" ")), F.concat(key, F.lit(",000")), F.lit("TRUE"), F.concat(key, F.lit("e3")), F.lit(""), F.col("event_type"), F.concat(F.lit("."), key)]
    value = F.element_at(F.array(*texts), (k + 1).cast("int"))
    return df.select("event_id", amounts.is_numeric(value).alias("is_numeric"), amounts.to_float(value).alias("number"))


@register("f6_unique_ids", "select event_id, strftime(cast(ts as timestamp), '%Y%m%d%H%M%S%f')||md5(event_id||'|'||event_type) as uid from events", lambda s, d: read(s, d, "events"))
def _(df):
    return df.select("event_id", accounts.unique_id(F.col("ts").cast("timestamp"), F.col("event_id"), F.col("event_type")).alias("uid"))


CARDS = [
    statements.Card("debit", ("debit", "借记"), ("日期", "金额", "余额")),
    statements.Card("credit", ("credit", "bill"), ("日期", "金额", "商户", "分期")),
    statements.Card("closed", ("old", "bill"), ("日期", "商户"), enabled=False),
]


@register("s22_personal_bank", """select event_id, case event_id % 5 when 0 then 'debit' when 1 then 'credit' when 2 then 'debit' end as by_name,
  case event_id % 4 when 0 then 'debit' when 1 then 'credit' end as by_headers from events""", lambda s, d: read(s, d, "events"))
def _(df):
    key, k = F.col("event_id").cast("string"), F.col("event_id")
    name = F.element_at(F.array(F.concat(F.lit("2024 DEBIT "), key, F.lit(".xlsx")), F.concat(key, F.lit("-Credit-Bill.csv")), F.concat(F.lit("借记 bill "), key), F.concat(F.lit("old_"), key), F.lit(None)), (k % 5 + 1).cast("int"))
    heads = F.when(k % 4 == 0, F.array(F.lit(" 日期 "), F.lit("金额"), F.lit("余额"), key)).when(k % 4 == 1, F.array(F.lit("商户"), F.lit("日期"), F.lit("分期"), F.lit(None))).when(k % 4 == 2, F.array(F.lit("日期"), F.lit("日期"), key))
    return df.select("event_id", statements.personal_bank_by_name(name, CARDS).alias("by_name"), statements.personal_bank_by_headers(heads, CARDS).alias("by_headers"))


def attachment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("attachment_id"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("txn_id"), F.concat(F.lit("/vault/"), F.col("event_id").cast("string")).alias("path"),
                    F.col("event_type").alias("attachment_type"), F.lit("kept").alias("remark"), F.lit("2024-01-01").alias("created"), F.lit("2024-01-01").alias("updated"))


@register("k15_attachment_edits", """with a as (select event_id as id, 'T'||user_id as txn_id, '/vault/'||event_id as path, event_type as kind from events),
m as (select max(id) as m from a),
kept as (select txn_id, case when id % 10 = 1 then '/moved/'||id else path end as path, kind, case when id % 10 = 2 then '' else 'kept' end as remark, case when id % 10 in (1, 2) then 'now' else '2024-01-01' end as updated, id <= m as old from a, m where id % 10 <> 3)
select * from kept union all select txn_id, '/new'||path, '', null, 'now', false from a where id % 10 = 4""", attachment_table)
def _(df):
    k = F.col("attachment_id") % 10
    edits = df.where((k == 1) | (k == 2) | (k == 5)).select("attachment_id", F.when(k == 1, F.concat(F.lit("/moved/"), F.col("attachment_id").cast("string"))).alias("path"), F.when(k == 2, "").alias("remark"))
    edits = edits.unionByName(df.sparkSession.createDataFrame([(-1, "/unknown", None)], edits.schema))
    changed = attachments.delete(attachments.update(df, edits, "now"), df.where(k == 3))
    grown = attachments.insert(changed, df.where(k == 4).select("txn_id", F.concat(F.lit("/new"), F.col("path")).alias("path")), "now")
    largest = df.agg(F.max("attachment_id").alias("m"))
    return grown.crossJoin(F.broadcast(largest)).select("txn_id", "path", F.col("attachment_type").alias("kind"), "remark", "updated", (F.col("attachment_id") <= F.col("m")).alias("old"))


# --- streams: the events table as a folder of arriving files


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = shared_folder(spark, "arrivals")
    events.write.parquet(folder)  # a stream source watches a folder of files
    return ingest.watch(spark, folder, events.schema)


def run(spark: SparkSession, stream: DataFrame, mode: str = "complete", out: str | None = None, state: str | None = None) -> DataFrame:
    return ingest.run_to_table(spark, stream, out or shared_folder(spark, "stream-out"), state or shared_folder(spark, "stream-state"), mode)


QUERIES["t1_tumbling_days"] = lambda s, d: run(s, ingest.tumbling(event_stream(s, d), "1 day", "1 day", "event_type")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "total")
SQL["t1_tumbling_days"] = "select cast(ts as date) as day, event_type, count(*) as n, sum(cast(value as decimal(20,4))) as total from events group by 1, 2"

QUERIES["t2_sessions"] = lambda s, d: run(s, ingest.sessions(event_stream(s, d), "2 hours", "1 day", "user_id")).groupBy("n").agg(F.count(F.lit(1)).alias("sessions"))
SQL["t2_sessions"] = """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as fresh from events),
s as (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e), c as (select user_id, k, count(*) as n from s group by all) select n, count(*) as sessions from c group by n"""


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals of overlapping rows, each by its own run of the same stream; keys enter once."""
    rows = keyed(spark, sf_dir).select("match_key", "txn_uid", "trade_date")
    folder, table, state = (shared_folder(spark, n) for n in ("inbox", "ledger", "ingest-state"))
    for kept in ("day(trade_date) % 3 = 0", "day(trade_date) % 2 = 0", "month(trade_date) < 4"):
        rows.where(kept).write.mode("append").parquet(folder)
        ingest.ingest(ingest.watch(spark, folder, rows.schema), table, state).awaitTermination()
    return spark.read.parquet(table).select("match_key")


QUERIES["t4_exactly_once"] = _ingested
SQL["t4_exactly_once"] = f"{KEYED} select distinct match_key from keyed where day(trade_date) % 3 = 0 or day(trade_date) % 2 = 0 or month(trade_date) < 4"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the rows of odd days, to which those of the first half of each month are staged twice and committed once."""
    rows = keyed(spark, sf_dir).select("match_key", "txn_uid", "trade_date")
    table, staging = shared_folder(spark, "ledger"), shared_folder(spark, "staging")
    ingest.commit(spark, ingest.stage(rows.where("day(trade_date) % 2 = 1"), table, f"{staging}/1"), table, 1)
    staged = ingest.stage(rows.where("day(trade_date) < 16"), table, f"{staging}/2")
    ingest.commit(spark, staged, table, 2), ingest.commit(spark, staged, table, 2)
    total = spark.read.parquet(table).groupBy("part").agg(F.count(F.lit(1)).alias("n_after"))
    return ingest.manifest(spark, staged).join(total, "part").select("part", "n_incoming", "n_new", "n_duplicate", "n_after")


QUERIES["a25_staged_manifest"] = _staged
SQL["a25_staged_manifest"] = f"""{KEYED}, k as (select match_key, min(strftime(trade_date, '%Y-%m')) as part, max(day(trade_date) % 2) as old, count_if(day(trade_date) < 16) as n from keyed group by match_key)
select part, sum(n)::bigint as n_incoming, count_if(n > 0 and old = 0) as n_new, (sum(n) - count_if(n > 0 and old = 0))::bigint as n_duplicate, count_if(n > 0 or old = 1) as n_after from k group by part having sum(n) > 0"""


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of odd days by month, then all of the first half of the year upserted."""
    rows, path = keyed(spark, sf_dir), shared_folder(spark, "ledger")
    tables.write_ledger(first_per_key(rows.where("day(trade_date) % 2 = 1"), ["match_key"], [F.col("txn_uid")]), path)
    tables.upsert_ledger(spark, rows.where("month(trade_date) < 7"), path)
    return tables.read_ledger(spark, path).select("match_key")


QUERIES["k5_upsert"] = _upserted
SQL["k5_upsert"] = f"{KEYED} select distinct match_key from keyed where day(trade_date) % 2 = 1 or month(trade_date) < 7"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words of the benchmark, as rules of four kinds, the first that each turn of a conversation matches."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0)))).alias("keyword")
    table = read(spark, sf_dir, "benchmark").select(words).distinct()
    k = F.length("keyword") % 4
    table = table.withColumns({"mode": F.when(k == 0, "startswith").when(k == 1, "endswith").when(k == 2, "exact").otherwise("contains"), "priority": -F.length("keyword")})
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("text"))
    return turns.join(rule_tables.first_match(turns, "text", table, ["priority", "keyword"]), "text").select("conv_id", "turn", "keyword", "mode")


QUERIES["j14_rule_table"] = _tagged
SQL["j14_rule_table"] = """with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) as k from benchmark), t as (select distinct lower(text) as t from conversations where text <> ''),
m as (select t, k, case length(k) % 4 when 0 then 'startswith' when 1 then 'endswith' when 2 then 'exact' else 'contains' end as mode from t, w
  where case length(k) % 4 when 0 then starts_with(t, k) when 1 then suffix(t, k) when 2 then t = k else contains(t, k) end),
b as (select t, k, mode from m qualify row_number() over (partition by t order by length(k) desc, k) = 1)
select conv_id, turn, k as keyword, mode from conversations join b on lower(text) = t"""


QUERIES["a17_cashflow_by_table"] = lambda s, d: rule_tables.classify_cashflow(ledger(s, d), rule_tables.cashflow_rule_table(s, TABLE_RULES)).select("txn_uid", "cf_main_code", "cf_rule", "cf_keyword", "cf_source")
TABLE_RULES = [rules.CashflowRule("machines", "fixed_asset", ["URGENT"], ["MACHINERY"], "payment", 5), rules.CashflowRule("homes", "customer", ["HIGH", "SPECIFIED"], ["HOUSE"], "receipt", 7), rules.CashflowRule("any", "transfer", ["4-"], [], "any", 9)]
SQL["a17_cashflow_by_table"] = f"""{L}, m as (select txn_uid, case when coalesce(payment, 0) <> 0 and contains(summary, 'URGENT') then 1 when coalesce(payment, 0) <> 0 and contains(counterparty, 'MACHINERY') then 2
  when coalesce(receipt, 0) <> 0 and contains(summary, 'HIGH') then 3 when coalesce(receipt, 0) <> 0 and contains(summary, 'SPECIFIED') then 4 when coalesce(receipt, 0) <> 0 and contains(counterparty, 'HOUSE') then 5 when contains(summary, '4-') then 6 else 7 end as k from ledger)
select txn_uid, ['investing', 'investing', 'operating', 'operating', 'operating', 'unclassified', 'unclassified'][k] as cf_main_code, ['machines', 'machines', 'homes', 'homes', 'homes', 'any', ''][k] as cf_rule,
  ['URGENT', 'MACHINERY', 'HIGH', 'SPECIFIED', 'HOUSE', '4-', ''][k] as cf_keyword, ['summary', 'counterpart', 'summary', 'summary', 'counterpart', 'summary', ''][k] as cf_source from m"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample file per nation, saved on a day of its own; the records of the newest ten are read."""
    c, folder = read(spark, sf_dir, "customer"), shared_folder(spark, "samples")
    record = F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    saved = c.groupBy("c_nationkey").agg(F.collect_list(record).alias("records")).select("c_nationkey", F.concat(F.lit("N"), "c_nationkey").alias("bank"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey").cast("int")), "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"), "records")
    saved.repartition("c_nationkey").write.partitionBy("c_nationkey").json(folder)
    return tables.read_samples(spark, f"{folder}/*", "id: long, text: string", 10).select("bank", "id", "text")


QUERIES["s24_sample_store"] = _samples
SQL["s24_sample_store"] = "select 'N'||c_nationkey as bank, c_custkey as id, c_mktsegment as text from customer where c_nationkey in (select distinct c_nationkey from customer order by 1 desc limit 10)"


def lookup_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup sheet per nation in a workbook: aliases of headers by nation, accounts as numbers, some of them missing, and one further field."""
    c = read(spark, sf_dir, "customer")
    even = F.col("c_nationkey") % 2 == 0
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1
    sheet = F.concat(F.lit("n"), "c_nationkey").alias("sheet")
    body = c.withColumn("row", place).select(F.lit("lookup").alias("file"), sheet, "row", F.inline(F.array(*[F.struct(F.lit(n).alias("col"), v.alias("value")) for n, v in enumerate([F.col("c_name"), F.when(F.col("c_custkey") % 10 != 3, F.concat(F.lit("622"), F.col("c_custkey"), F.lit(".0"))), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 4).cast("string")), F.col("c_mktsegment")], 1)]))).where("value is not null")
    titles = [F.when(even, "主体名称").otherwise("主体"), F.when(even, "账号").otherwise("银行账号"), F.lit("优先级"), F.lit("segment")]
    head = c.select("c_nationkey").distinct().select(F.lit("lookup").alias("file"), sheet, F.lit(1).alias("row"), F.inline(F.array(*[F.struct(F.lit(n).alias("col"), v.alias("value")) for n, v in enumerate(titles, 1)])))
    folder = shared_folder(spark, "lookups")
    workbooks.write_cells(body.unionByName(head), folder)
    return workbooks.read_workbooks(spark, folder)


@register("s25_lookup_scan", """select c_name as subject, '622'||c_custkey as account, (c_custkey % 4)::int as priority, c_mktsegment as segment,
  row_number() over (partition by c_nationkey order by c_custkey) + 1 as row_id from customer qualify c_custkey % 10 <> 3""", lookup_sheets)
def _(df):
    return statements.lookup_entries(df).select("subject", "account", "priority", F.element_at("extra", F.lit("segment")).alias("segment"), "row_id")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's counts for each order year, appended one after the other, and the latest three; written and read as JSON lines."""
    rows, path, out = read(spark, sf_dir, "orders"), shared_folder(spark, "batches"), shared_folder(spark, "report")
    years = rows.groupBy(F.year("o_orderdate").cast("string").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    tables.append_batch(years.where("batch_id < '1998'"), path)
    tables.append_batch(years.where("batch_id >= '1998'"), path)
    tables.write_report(tables.latest_batches(spark, path, 3), out)
    return spark.read.schema("batch_id string, n_records long, n_done long").json(out)


QUERIES["k17_latest_batches"] = _batches
SQL["k17_latest_batches"] = "select year(o_orderdate)::varchar as batch_id, count(*) as n_records, count_if(o_orderstatus = 'F') as n_done from orders group by 1 order by 1 desc limit 3"


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in a folder without one subject's rows of some years; a month is left of nothing."""
    rows, path = ledger(spark, sf_dir).withColumn("match_key", F.col("txn_uid")), shared_folder(spark, "ledger")
    tables.write_ledger(rows, path)
    tables.delete_in_place(spark, path, subject="BUILDING", start="1996-01-01", end="1997-12-31")
    tables.delete_in_place(spark, path, start="1998-02-01", end="1998-02-28")
    return tables.read_ledger(spark, path).select("txn_uid", "subject", "trade_date")


QUERIES["k7_delete_in_place"] = _deleted
SQL["k7_delete_in_place"] = f"""{L} select txn_uid, subject, trade_date from ledger where not coalesce(subject = 'BUILDING' and trade_date between date '1996-01-01' and date '1997-12-31', false) and not coalesce(trade_date between date '1998-02-01' and date '1998-02-28', false)"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in a folder with the summaries of one bank's rows of a quarter changed."""
    rows, path = ledger(spark, sf_dir).withColumn("match_key", F.col("txn_uid")), shared_folder(spark, "ledger")
    tables.write_ledger(rows, path)
    hit = rows.where("bank = 'NATION_11' and trade_date between date '1996-01-01' and date '1996-03-31'")
    edits = hit.select("txn_uid", F.date_format("trade_date", "yyyy-MM").alias("trade_month"), F.concat(F.lit("seen "), "txn_id").alias("summary"), F.lit(" ").alias("counterparty"))
    tables.edit_in_place(spark, path, edits, ("summary", "counterparty"))
    return tables.read_ledger(spark, path).select("txn_uid", "summary", "counterparty")


QUERIES["k8_edit_in_place"] = _edited
SQL["k8_edit_in_place"] = f"""{L} select txn_uid, case when bank = 'NATION_11' and trade_date between date '1996-01-01' and date '1996-03-31' then 'seen '||txn_id else summary end as summary, counterparty from ledger"""


def _database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of odd customers in a database that all executors reach, all of the first half upserted twice, read again in ranges.

    No database server is at hand, and an embedded one is open in one process at a time: SQLite, a file per range of the key. Prices are in hundredths.
    """
    cents = (F.col("o_totalprice").cast("decimal(20,2)") * 100).cast("long").alias("cents")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", cents)
    low, high, n = orders.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count(F.lit(1))).first()
    stored = ranged.RangedTable(spark, shared_folder(spark, "database"), orders.schema, "o_orderkey", low, high, max(6, n // RANGE_ROWS + 1))
    stored.append(orders.where("o_custkey % 2 = 1"))
    for _ in range(2):
        stored.upsert(orders.where("o_orderkey % 4 < 2"))
    price = (F.col("cents").cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(20,2)")
    return stored.read("cents > 100000").select("o_orderkey", "o_custkey", price.alias("o_totalprice"))


QUERIES["s23_jdbc_ranges"] = _database
SQL["s23_jdbc_ranges"] = "select o_orderkey, o_custkey, cast(o_totalprice as decimal(20,2)) as o_totalprice from orders where (o_custkey % 2 = 1 or o_orderkey % 4 < 2) and o_totalprice > 1000"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of JSON, some cut short and some without a user, told apart by a stream."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id") % 11
    line = F.to_json(F.struct("event_id", F.when(k != 3, F.col("user_id")).alias("user_id"), "event_type"))
    folder, good, bad, state = (shared_folder(spark, n) for n in ("lines", "good", "bad", "routing"))
    e.select(F.when(k == 5, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(folder)
    routing.route(ingest.watch(spark, folder, "value string", "text"), "event_id long, user_id long, event_type string", good, bad, state, ("user_id",)).awaitTermination()
    entered = spark.read.parquet(good).select(F.lit("entered").alias("side"), F.col("event_type").alias("what"), F.col("event_id"))
    left = spark.read.parquet(bad).select(F.lit("left out").alias("side"), F.col("reason").alias("what"), F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))
    return entered.unionByName(left).groupBy("side", "what").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


QUERIES["t5_error_routing"] = _routed
SQL["t5_error_routing"] = """select 'entered' as side, event_type as what, count(*) as n, sum(event_id)::bigint as ids from events where event_id % 11 not in (3, 5) group by event_type
union all select 'left out', case event_id % 11 when 3 then 'no user_id' else 'unreadable' end, count(*), sum(case event_id % 11 when 3 then event_id end)::bigint from events where event_id % 11 in (3, 5) group by event_id % 11"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events in four files, one a batch, whose progress is written as a table."""
    events = read(spark, sf_dir, "events").select("event_id", "value")
    folder, out, state, table = (shared_folder(spark, n) for n in ("arrivals", "stream-out", "stream-state", "progress"))
    events.repartition(4, "event_id").write.parquet(folder)
    listener = progress.ProgressTable(spark, table)
    spark.streams.addListener(listener)
    try:
        stream = progress.observed(ingest.watch(spark, folder, events.schema, files_per_batch=1), "rows", n=F.count(F.lit(1)), ids=F.sum("event_id"))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    told = spark.read.schema(progress.SCHEMA).parquet(table).where("n_rows > 0")
    return told.groupBy("metric").agg(F.count_distinct("batch_id").alias("batches"), F.sum("n_rows").alias("n_rows"), F.sum("value").alias("value"))


QUERIES["t7_progress"] = _progress
SQL["t7_progress"] = "select unnest(['rows.n', 'rows.ids']) as metric, 4::bigint as batches, count(*) as n_rows, unnest([count(*)::double, sum(event_id)::double]) as value from events"


LISTED = "select 'f'||(user_id % 40) as path, (day(ts) // 3 * 10 + user_id % 2)::bigint as size, user_id % 40 as modified, ts as seen_at, event_id % 29 = 0 as locked from events"


def _stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings of growing files, in arrivals of ten days; a file passes when it has stayed for twelve hours."""
    e = read(spark, sf_dir, "events").withColumn("seen_at", F.col("ts").cast("timestamp"))
    seen = e.select(F.concat(F.lit("f"), F.col("user_id") % 40).alias("path"), (F.floor(F.dayofmonth("seen_at") / 3) * 10 + F.col("user_id") % 2).alias("size"), (F.col("user_id") % 40).alias("modified"), "seen_at", (F.col("event_id") % 29 == 0).alias("locked"))
    folder, out, state = (shared_folder(spark, n) for n in ("listings", "stable", "stable-state"))
    for n in range(4):
        seen.where(F.floor((F.dayofmonth("seen_at") - 1) / 10) == n).write.mode("append").parquet(folder)
        found = run(spark, stability.stable_files(ingest.watch(spark, folder, seen.schema), 43_200), "append", out, state)
    return found


QUERIES["t2_stable_files"] = _stable
SQL["t2_stable_files"] = f"""with l as ({LISTED}), s as (select *, coalesce(locked or lag(locked) over f or size <> lag(size) over f or modified <> lag(modified) over f, true) as fresh from l window f as (partition by path order by seen_at)),
r as (select *, count_if(fresh) over (partition by path order by seen_at) as streak from s), b as (select *, min(seen_at) over (partition by path, streak) as since from r)
select path, size, min(seen_at) as seen_at from b where not locked and epoch_us(seen_at) - epoch_us(since) >= 43200000000 group by path, streak, size"""


QUERIES["w2_frequent_spans"] = lambda s, d: run(s, stability.frequent(event_stream(s, d), 7, 5, "1 day", "user_id")).select("user_id", F.col("window.start").cast("date").alias("start"), "n")
SQL["w2_frequent_spans"] = "with d as (select user_id, unnest(generate_series(ts::date - interval 6 day, ts::date::timestamp, interval 1 day))::date as start from events) select user_id, start, count(*) as n from d group by all having count(*) >= 5"


@register("s12_header_scores", """with t as (select event_id, case event_id % 5 when 0 then 'Date' when 1 then 'trade date (utc)' when 2 then 'the date is' when 3 then 'dat' else 'amount' end as x from events)
select event_id, case event_id % 5 when 0 then 1.0 when 1 then 0.9 when 2 then 0.7 when 3 then 0.5 else 0.0 end as score from t""", lambda s, d: read(s, d, "events"))
def _(df):
    k = F.col("event_id") % 5
    cell = F.when(k == 0, "Date").when(k == 1, "trade date (utc)").when(k == 2, "the date is").when(k == 3, "dat").otherwise("amount")
    return df.select("event_id", statements.header_score(statements.header_text(cell), ["date", "trade date"]).alias("score"))


@register("f29_content_hash", "select page_id, sha256(html) as h from pages", lambda s, d: read(s, d, "pages"))
def _(df):
    return files.with_hash(df.select("page_id", F.encode("html", "utf-8").alias("content"))).select("page_id", F.col("content_hash").alias("h"))


@register("s21_personal_rows", "select 'u'||user_id as file, count(*) as n from events where round(abs(value),2) <> 0 or event_id % 6 <> 0 group by 1", lambda s, d: read(s, d, "events"))
def _(df):
    sheet = df.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.lit("bill").alias("sheet"), (F.col("event_id") + 2).cast("int").alias("row"), F.inline(F.array(
        F.struct(F.lit(1).alias("col"), F.format_number(F.abs("value"), 2).alias("value")), F.struct(F.lit(2).alias("col"), F.when(F.col("event_id") % 6 != 0, F.col("event_type")).otherwise(" ").alias("value")))))
    head = df.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.lit("bill").alias("sheet"), F.lit(1).alias("row")).distinct().select("file", "sheet", "row", F.inline(F.array(F.struct(F.lit(1).alias("col"), F.lit("金额").alias("value")), F.struct(F.lit(2).alias("col"), F.lit("商户").alias("value")))))
    rows = statements.personal_rows(sheet.unionByName(head), {"amount": ["交易金额", "金额"], "merchant": ["商户", "商家"]})
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
