"""Masking of sensitive values, and the levels of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE, DEBUG, FORBIDDEN = "info_safe", "debug_only", "forbidden"

#: The level of each known column.
LEVELS = {
    SAFE: "银行 银行名称 记录数 条数 总数 处理状态 状态 模式 黑白名单标签 命中规则名称 命中关键词 工作表 sheet_name 模板 类型 币种 序号".split(),
    DEBUG: "唯一id 唯一ID transaction_id 主体 主体名称 subject 摘要 summary 对方户名 counterparty 交易描述 备注 remark 附件类型 导入批次号 导入时间 id workflow_id description handled_by created_at updated_at".split(),
    FORBIDDEN: "银行账号 account 对方账号 付款 payment 支出金额 收款 receipt 收入金额 余额 balance 交易流水号 匹配键 match_key 交易日期 交易时间 附件路径 对方行名 凭证种类 凭证号码 手续费 利息 税费 amount".split(),
}
#: Parts of a column name that set its level, the first list first.
HINTS = {
    FORBIDDEN: "账号 账户 金额 余额 流水号 流水 卡号 account balance payment receipt amount".split(),
    DEBUG: "主体 户名 摘要 备注 名称 描述 subject counterparty summary remark description".split(),
}


def classify_field(name: str) -> str:
    """The level of a column by its name; unknown names are safe."""
    for level, names in LEVELS.items():
        if name in names:
            return level
    for level, hints in HINTS.items():
        if any(h in name.lower() for h in hints):
            return level
    return SAFE


def _filled(c: Column, masked: Column) -> Column:
    return F.when(c.isNull() | (c == ""), c).otherwise(masked)


def _keep(c: Column, head: int, tail: int) -> Column:
    t = F.trim(c)
    return F.concat(F.substring(t, 1, head), F.repeat(F.lit("*"), F.length(t) - (head + tail)), F.right(t, F.lit(tail)) if tail else F.lit(""))


def mask_account(c: Column) -> Column:
    """First and last three characters; up to six characters nothing."""
    t = F.trim(c)
    return _filled(c, F.when(F.length(t) <= 6, F.repeat(F.lit("*"), F.length(t))).otherwise(_keep(c, 3, 3)))


def mask_name(c: Column) -> Column:
    """First and last character; two characters keep the first, one keeps none."""
    t = F.trim(c)
    return _filled(c, F.when(F.length(t) <= 1, "*").when(F.length(t) == 2, F.concat(F.substring(t, 1, 1), F.lit("*"))).otherwise(_keep(c, 1, 1)))


def mask_text(c: Column, keep: int = 2) -> Column:
    t = F.trim(c)
    return _filled(c, F.concat(F.when(F.length(t) <= keep, F.substring(t, 1, 1)).otherwise(F.substring(t, 1, keep)), F.lit("***")))


def mask_txn_id(c: Column) -> Column:
    t = F.trim(c)
    return _filled(c, F.when(F.length(t) <= 4, F.repeat(F.lit("*"), F.length(t))).otherwise(_keep(c, 4, 0)))


def mask_uid(c: Column) -> Column:
    t = F.trim(c)
    short = F.when(F.length(t) > 4, F.concat(F.substring(t, 1, 4), F.lit("****"))).otherwise(F.repeat(F.lit("*"), F.length(t)))
    return _filled(c, F.when(F.length(t) <= 8, short).otherwise(F.concat(F.substring(t, 1, 8), F.lit("****"))))


def mask_amount(c: Column) -> Column:
    """The amount's range instead of its value."""
    v = F.abs(c.try_cast("double"))
    return (
        F.when(v.isNull() | F.isnan(v), "[金额已隐藏]").when(v == 0, "[0]").when(v < 1e3, "[<1千]").when(v < 1e4, "[1千-1万]")
        .when(v < 1e5, "[1万-10万]").when(v < 1e6, "[10万-100万]").when(v < 1e7, "[100万-1千万]").otherwise("[>=1千万]")
    )


def mask_date(c: Column) -> Column:
    """Year and month only."""
    t, p = F.trim(c.cast("string")), r"^(\d{4})[-/.年]?(\d{1,2})"
    return _filled(c.cast("string"), F.when(t.rlike(p), F.concat(F.regexp_extract(t, p, 1), F.lit("年"), F.regexp_extract(t, p, 2), F.lit("月"))).otherwise("[日期已隐藏]"))


def mask_path(c: Column) -> Column:
    return _filled(c, F.regexp_extract(c, r"([^/]*)$", 1))


#: The mask of each known column; other forbidden and debug columns are replaced whole.
MASKS = (
    dict.fromkeys("银行账号 对方账号 account".split(), mask_account)
    | dict.fromkeys("付款 支出金额 收款 收入金额 余额 手续费 利息 税费 amount balance payment receipt".split(), mask_amount)
    | dict.fromkeys("主体 主体名称 对方户名 subject counterparty handled_by".split(), mask_name)
    | dict.fromkeys("摘要 交易描述 备注 summary remark description".split(), mask_text)
    | dict.fromkeys("唯一id 唯一ID transaction_id workflow_id id".split(), mask_uid)
    | {"交易流水号": mask_txn_id, "交易日期": mask_date, "附件路径": mask_path}
)
HIDDEN = {FORBIDDEN: "[已脱敏-禁止落盘]", DEBUG: "[已脱敏]"}


def mask_field(name: str, c: Column) -> Column:
    """``c`` as its column name asks; nulls stay null."""
    level = classify_field(name)
    if level == SAFE:
        return c
    masked = MASKS[name](c.cast("string")) if name in MASKS else F.lit(HIDDEN[level])
    return F.when(c.isNotNull(), masked)


def _mask_nested(name: str, c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_mask_nested(f.name, c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda x: _mask_nested(name, x, kind.elementType))
    return mask_field(name, c)


def mask_frame(df: DataFrame) -> DataFrame:
    """Every column masked by its level, structs and arrays of structs included."""
    return df.select(*[_mask_nested(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def mask_record(df: DataFrame, fields: tuple[str, ...] = ("account", "counterparty")) -> DataFrame:
    """Accounts keep three characters at both ends and names one; other columns are unchanged."""
    return df.withColumns({f: (mask_account if f in ("account", "银行账号") else mask_name)(F.col(f)) for f in fields if f in df.columns})


def mask_by_shape(c: Column) -> Column:
    """Mask of a value without a column name, by its shape: date, transaction number, account, uid, number over ten."""
    t = F.trim(c)
    bare = F.regexp_replace(t, "[- ]", "")
    date = t.rlike(r"^\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}|^\d{8}|^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}")
    txn = (F.length(t) >= 8) & t.rlike("[A-Za-z]") & t.rlike(r"\d")
    account = bare.rlike("^[A-Za-z0-9]{8,}$")
    uid = (t.contains("-") & (F.length(t) >= 10)) | t.rlike("^[A-Za-z0-9]{12,}$")
    number = F.regexp_replace(t, ",", "").try_cast("double")
    return (
        F.when(F.coalesce(t, F.lit("")) == "", c).when(date, mask_date(t)).when(txn, mask_txn_id(t)).when(account, mask_account(t))
        .when(uid, mask_uid(t)).when(F.abs(number) > 10, mask_amount(t)).otherwise(c)
    )


def fields_at(columns: list[str], level: str) -> list[str]:
    """Columns that may be exported at ``level``: safe ones, with debug also debug ones."""
    allowed = {SAFE: (SAFE,), DEBUG: (SAFE, DEBUG), FORBIDDEN: (SAFE, DEBUG, FORBIDDEN)}[level]
    return [c for c in columns if classify_field(c) in allowed]
