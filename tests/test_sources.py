"""Files, sheets and streams."""

import zipfile

from abaculus.operators.merging import manifest
from abaculus.sources import cells, files, statements, tables
from abaculus.streaming import ingest


def make_xlsx(path, sheets):
    """A small workbook with inline strings and plain numbers."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                body += f'<row r="{r}">'
                for c, v in enumerate(row):
                    if v is not None:
                        ref = f"{chr(65 + c)}{r}"
                        body += f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                body += "</row>"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


HEADER = ["交易日期", "支出金额", "收入金额", "余额", "摘要"]
RULE = statements.BankRule("测试银行", (1, 2), 3, {"trade_date": 1, "payment": 2, "receipt": 3, "balance": 4, "summary": 5}, skip_sheets=("说明",), expected_headers={"trade_date": ["交易日期"], "payment": ["付款"]})


def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    make_xlsx(tmp_path / "a.XLSX", {"明细": [["账号", "6222000011112222"], HEADER, ["2024-01-05", "1,000.00", None, 500.5, "采购"], [None, "3", None, None, "no date"], ["2024/1/6", None, 20, 520.5, "销售"]], "说明": [["2024-01-05", "x"]], "空账号": [[None, None], HEADER, ["2024-01-07", 5]]})
    (tmp_path / "sub" / "b.csv").write_bytes("账号;6222\n日期;金额\n2024-01-05;5\n".encode("gbk"))
    (tmp_path / "~$a.xlsx").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "d.csv").write_bytes(b"PK\x03\x04junk")
    return str(tmp_path)


def test_scan_and_format(spark, tmp_path):
    found = files.with_hash(files.with_format(files.scan(spark, folder(tmp_path))))
    assert {r.name: r.format for r in found.select("name", "format").collect()} == {"a.XLSX": "xlsx", "b.csv": "csv", "d.csv": "xlsx"}
    assert all(len(r.content_hash) == 64 for r in found.select("content_hash").collect())


def test_extract(spark, tmp_path):
    found = files.with_format(files.scan(spark, folder(tmp_path))).where("name <> 'd.csv'")
    all_cells = cells.read_cells(found)
    sheets = all_cells.where("file like '%XLSX'")
    rows = {(r.sheet, r.row): r for r in statements.extract(sheets, RULE).collect()}
    assert set(rows) == {("明细", 3), ("明细", 5), ("空账号", 3)}
    first = rows["明细", 3]
    assert (first.account, str(first.trade_date), float(first.payment), first.receipt, float(first.balance)) == ("6222000011112222", "2024-01-05", -1000.0, None, 500.5)
    assert rows["空账号", 3].account is None
    problems = statements.header_problems(sheets.where("sheet = '明细'"), RULE)
    assert [(p.field, p.found) for p in problems.collect()] == [("payment", "支出金额")]
    warned = statements.validated(statements.extract(sheets, RULE), problems)
    assert warned.where("header_problem").count() == 2
    assert {r.value for r in all_cells.where("file like '%csv' and row = 1").collect()} == {"账号", "6222"}
    inferred = statements.infer_templates(sheets.where("sheet = '明细'")).first()
    assert inferred.header_row == 2 and inferred.confidence == round(0.5 * 5 / 7 + 0.5, 2)


def test_blocks_and_effective_rows(spark):
    data = [(1, 1, "账号"), (1, 2, "62220001"), *[(2, c, "h") for c in (1, 2, 3)], *[(3, c, "v") for c in (1, 2, 3)], (5, 1, "账号: 62220002"), *[(6, c, "h") for c in (1, 2, 3)], (9, 1, "账号"), (9, 2, "62220003"), *[(10, c, "h") for c in (1, 2, 3)], *[(11, c, "0") for c in (1, 2, 3)], (40, 1, "late")]
    df = spark.createDataFrame([("f", "s", *x) for x in data], "file string, sheet string, row int, col int, value string")
    got = [(b.account, b.header_row, b.data_start_row, b.data_end_row) for b in statements.account_blocks(df).orderBy("header_row").collect()]
    assert got == [("62220001", 2, 3, 3), ("62220003", 10, 11, 11)]
    assert cells.effective_rows(df, 10).agg({"row": "max"}).first()[0] == 11


def test_lookup_and_personal(spark):
    df = spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate([["主体名称", "银行账号", "优先级", "区域"], ["甲", "00123.0", "2", "北"], ["乙", "", "x", "南"]], 1) for c, v in enumerate(row, 1)], "file string, sheet string, row int, col int, value string")
    assert [(r.subject, r.account, r.priority, r.extra) for r in statements.lookup_entries(df).collect()] == [("甲", "00123", 2, {"区域": "北"})]
    bill = spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate([["title"], ["日期", "金额", "商户"], ["2024-01-01", "5", "店"], ["2024-01-02", "0", " "]], 1) for c, v in enumerate(row, 1)], "file string, sheet string, row int, col int, value string")
    assert [r.merchant for r in statements.personal_rows(bill, {"trade_date": ["日期"], "amount": ["金额", "交易金额"], "merchant": ["商户"]}).collect()] == ["店"]


def test_table_and_sink(spark, tmp_path):
    df = spark.sql("select 'U'||id as txn_uid, 'K'||id as match_key, date'2024-01-01' + cast(id as int) as trade_date from range(40)")
    path = str(tmp_path / "ledger")
    tables.write_ledger(df.where("txn_uid < 'U2'"), path)
    tables.upsert_ledger(spark, df, path)
    tables.upsert_ledger(spark, df, path)
    assert tables.read_ledger(spark, path).count() == 40
    assert manifest(spark.createDataFrame([("ok", 2), ("ok", 3), ("bad", 0)], "status string, n_records long")).where("level = 1").first().n_records == 5


def test_ingest_restart(spark, tmp_path):
    inbox, table, state = (str(tmp_path / n) for n in ("inbox", "table", "state"))
    rows = spark.sql("select 'K'||(id % 7) as match_key, 'U'||id as txn_uid from range(20)")
    rows.write.parquet(inbox)
    for _ in range(2):
        ingest.ingest(ingest.watch(spark, inbox, rows.schema), table, state).awaitTermination()
    rows.write.mode("append").parquet(inbox)
    ingest.ingest(ingest.watch(spark, inbox, rows.schema), table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 7


def test_only_texts_with_header_words_are_scored(spark):
    df = spark.createDataFrame([("f", "s", 1, 1, "交易日期"), ("f", "s", 1, 2, "支出(元)"), ("f", "s", 2, 1, "T123")], "file string, sheet string, row int, col int, value string")
    found = statements.infer_templates(df)
    assert found.first().header_row == 1 and [f.field for f in found.first().fields] == ["payment", "trade_date"]
    assert "|transdate|" in found._jdf.queryExecution().optimizedPlan().toString()
