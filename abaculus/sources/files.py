"""Folders of statement files: scan, format sniffing, hashes, stability, identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abaculus.functions.texts import name_key

SHEETS, PDFS = r"(?i)\.(xlsx?|xlsm|csv)$", r"(?i)\.pdf$"


def scan(spark: SparkSession, folder: str, pattern: str = SHEETS) -> DataFrame:
    """Files of a folder and its subfolders by extension, whatever its case, without office lock files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(F.col("name").rlike(pattern) & ~F.col("name").startswith("~$") & ~F.col("name").startswith("%7E$"))


def scan_all(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder).unionByName(scan(spark, folder, PDFS))


def with_format(files: DataFrame) -> DataFrame:
    """Format by first bytes, else by extension (S3)."""
    head = F.hex(F.substring("content", 1, 8))
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.when(head.startswith("504B0304"), "xlsx").when(head.startswith("D0CF11E0"), "xls").when(head.startswith("25504446"), "pdf").otherwise(extension)
    return files.withColumn("format", kind)


def with_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of the content."""
    return files.withColumn("content_hash", F.sha2("content", 256))


def stable(files: DataFrame, seconds: int, lock_seconds: int = 3600) -> DataFrame:
    """Files at least ``seconds`` old without a lock file younger than ``lock_seconds``."""
    age = F.unix_timestamp() - F.unix_timestamp("modificationTime")
    locks = files.where(F.col("path").endswith(".lock") & (age < lock_seconds)).select(F.regexp_replace("path", r"\.lock$", "").alias("path"))
    return files.where(~F.col("path").endswith(".lock") & (age >= seconds)).join(locks, "path", "left_anti")


def identify_bank(names: DataFrame, banks: dict[str, list[str]], column: str = "name") -> DataFrame:
    """Bank of a file name: a keyword as its prefix before one inside it, longer keywords first."""
    key = name_key(F.regexp_replace(F.col(column), r"\.[^.]+$", ""))
    pairs = sorted(((bank, k) for bank, ks in banks.items() for k in ks), key=lambda p: (-len(p[1]), p))
    out = F.lit(None).cast("string")
    for test in ("contains", "startswith"):
        for bank, k in reversed(pairs):
            out = F.when(getattr(key, test)(name_key(F.lit(k))), bank).otherwise(out)
    return names.withColumn("bank", out)


def identify_by_cells(cells: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    """(file, bank) where a value with six or more digits stands in a bank's account cell; the first bank by name."""
    hits = None
    for bank, (row, col) in places.items():
        one = cells.where((F.col("row") == row) & (F.col("col") == col) & F.regexp_replace("value", r"[^0-9]", "").rlike(r"^\d{6,}$")).select("file", F.lit(bank).alias("bank"))
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy("file").agg(F.min("bank").alias("bank"))
