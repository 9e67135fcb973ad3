"""Canonical schemas and the bilingual names used at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame

LEDGER = """
txn_uid string, bank string, account string, account_key string, subject string, trade_ts timestamp_ntz,
trade_date date, trade_date_raw string, payment decimal(20,2), receipt decimal(20,2), balance decimal(20,2),
summary string, counterparty string, txn_id string, match_key string, batch_id string, imported_at timestamp,
cp_tag string, cp_rules string, cp_keywords string, src_file string, src_relpath string, processed_at timestamp,
ext map<string,string>"""

LOOKUP = "subject string, account string, account_key string, priority int, extra map<string,string>, row_id long"

CELLS = "file string, sheet string, row int, col int, value string"

PERSONAL = """
id string, bank_name string, card_type string, account_number string, trade_date string, transaction_time string,
post_date string, amount double, direction string, balance double, summary string, merchant string,
transaction_type string, transaction_id string, category string, category_icon string, category_color string,
installments int, status string"""

#: Column names of the spreadsheets read and written.
NAMES = {
    "txn_uid": "唯一id",
    "bank": "银行",
    "account": "银行账号",
    "subject": "主体",
    "trade_date": "交易日期",
    "payment": "付款",
    "receipt": "收款",
    "summary": "摘要",
    "counterparty": "对方户名",
    "balance": "余额",
    "txn_id": "交易流水号",
    "match_key": "匹配键",
    "batch_id": "导入批次号",
    "imported_at": "导入时间",
    "cp_tag": "黑白名单标签",
    "cp_rules": "命中规则名称",
    "cp_keywords": "命中关键词",
    "src_file": "来源文件名",
    "src_relpath": "来源相对路径",
    "processed_at": "处理时间",
}


def to_chinese(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in NAMES.items() if k in df.columns})


def to_english(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in NAMES.items() if v in df.columns})
