"""Keyword rules as a table, of any number, met with texts by equality or by their rarest gram.

``rules.classify_cashflow`` compiles each keyword into the plan, which grows with the rules. Here rules are rows: those for a
whole text, its start or its end meet the texts' starts and ends of their own lengths; every other keyword stands in the table of grams under the one of its grams (of ``GRAM`` characters, or the whole keyword where it is
shorter) that the fewest texts hold; texts meet keywords on grams, and those that meet are compared by the rule's mode. Equal
texts are met once. The plan is the same for ten rules and ten thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abaculus.operators.rules import CASHFLOW_RULES, MAIN_CATEGORIES, SUBCATEGORIES, UNCLASSIFIED, CashflowRule
from abaculus.operators.sizes import broadcast_if_small, is_small

GRAM = 3
#: Regular expressions have no gram; so many of them are tried on each distinct text at most.
MOST_PATTERNS = 1000


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


def _grams_of_length(text: Column, size: int) -> Column:
    """The grams of a text, put together from its characters: places of a long text would be counted from its start for each."""
    def of(chars: Column) -> Column:
        starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - size + 1, F.lit(0)))
        return F.transform(starts, lambda c, i: F.concat(c, *[F.get(chars, i + n) for n in range(1, size)]))

    return F.array_distinct(F.flatten(F.transform(F.array(F.split(text, "")), of)))  # split once


def matches(texts: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """(column, columns of ``rules``) of every distinct text and rule that match.

    ``rules`` has ``keyword``, ``mode`` (contains, exact, startswith, endswith or regex) and others. Null or empty texts and
    keywords match nothing.
    """
    distinct = texts.select(F.col(column).alias("_text")).where("_text <> ''").distinct()
    rules = rules.where("keyword <> ''")
    text, keyword, mode = F.col("_text"), F.col("keyword"), F.col("mode")
    names = [F.col(c) for c in rules.columns]

    # rules for whole texts, starts and ends: equal to one of the texts' starts or ends of the lengths that the rules have
    whole = distinct.join(broadcast_if_small(rules.where(mode == "exact")), text == keyword).select("_text", *names)
    sides = rules.where(mode.isin("startswith", "endswith")).withColumn("_size", F.length("keyword"))
    lengths = F.broadcast(sides.select("mode", "_size").distinct())  # two rows for a length of keywords
    part = F.when(mode == "startswith", F.left("_text", F.col("_size"))).otherwise(F.right("_text", F.col("_size")))
    parts = distinct.join(lengths, F.length("_text") >= F.col("_size")).select("_text", mode.alias("_mode"), part.alias("_part"))
    at_side = parts.join(broadcast_if_small(sides), (F.col("_part") == keyword) & (F.col("_mode") == mode)).select("_text", *names)

    # others: the rarest gram of each
    inside = rules.where(~mode.isin("exact", "startswith", "endswith", "regex")).withColumn("_size", F.least(F.length("keyword"), F.lit(GRAM)))
    own = inside.select("keyword", "_size").distinct().select("keyword", "_size", F.explode(_grams(keyword, F.col("_size"))).alias("_gram"))
    used = [r[0] for r in inside.select("_size").distinct().collect()]  # of 1 to GRAM
    grams = distinct.select("_text", F.explode(F.concat(F.array().cast("array<string>"), *[_grams_of_length(text, n) for n in used])).alias("_gram")).withColumn("_size", F.length("_gram"))
    asked = grams.join(broadcast_if_small(own.select("_size", "_gram").distinct()), ["_size", "_gram"], "left_semi")
    counts = asked.groupBy("_size", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = own.join(counts, ["_size", "_gram"]).groupBy("keyword", "_size").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))  # of those that a text holds
    chosen = broadcast_if_small(inside.join(rarest, ["keyword", "_size"]))
    found = grams.join(chosen, ["_size", "_gram"]).where(F.contains(text, keyword)).select("_text", *names)
    found = found.unionByName(whole).unionByName(at_side)
    patterns = rules.where("mode = 'regex'")
    if not patterns.isEmpty():
        if not is_small(patterns, MOST_PATTERNS):
            raise ValueError(f"more than {MOST_PATTERNS} regular expressions")
        found = found.union(distinct.join(F.broadcast(patterns), F.rlike("_text", F.col("keyword"))).select("_text", *rules.columns))
    return found.withColumnRenamed("_text", column)


def first_match(texts: DataFrame, column: str, rules: DataFrame, order: list[str]) -> DataFrame:
    """(column, columns of ``rules``): of the rules that match a distinct text the first by ``order``."""
    best = F.min_by(F.struct(*rules.columns), F.struct(*order))
    return matches(texts, column, rules).groupBy(column).agg(best.alias("_best")).select(column, "_best.*")


def cashflow_rule_table(spark: SparkSession, rules: list[CashflowRule] = CASHFLOW_RULES) -> DataFrame:
    """The enabled rules, a row for each keyword; of rules with one priority the later one comes first, and in a rule the summary."""
    rows = []
    for n, r in enumerate(rules):
        for source, place, keywords in (("summary", 0, r.summary_keywords), ("counterpart", 1, r.counterparty_keywords)):
            rows += [(r.priority, -n, place, i, r.name, r.subcategory, r.direction, source, k, r.match_mode) for i, k in enumerate(keywords) if r.enabled]
    return spark.createDataFrame(rows, "priority int, rule_no int, source_no int, keyword_no int, name string, subcategory string, direction string, source string, keyword string, mode string")


def classify_cashflow(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` with the columns that ``rules.classify_cashflow`` gives, from a table of rules as ``cashflow_rule_table`` makes."""
    pays, gets = F.coalesce(F.col("payment") != 0, F.lit(False)), F.coalesce(F.col("receipt") != 0, F.lit(False))
    marked = df.withColumns({"_pays": pays, "_gets": gets})
    kinds = marked.select("summary", "counterparty", "_pays", "_gets").distinct()
    order = ["priority", "rule_no", "source_no", "keyword_no"]
    names = ["priority", "rule_no", "source_no", "keyword_no", "name", "subcategory", "direction", "source", "keyword"]
    hits = None
    for column, source in (("summary", "summary"), ("counterparty", "counterpart")):
        met = matches(kinds, column, rules.where(F.col("source") == source)).select(F.col(column).alias("_met"), *names)
        one = kinds.join(met, F.col(column) == F.col("_met")).where((F.col("direction") == "any") | ((F.col("direction") == "payment") & F.col("_pays")) | ((F.col("direction") == "receipt") & F.col("_gets")))
        one = one.select(*kinds.columns, F.struct(*names).alias("hit"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy(*kinds.columns).agg(F.min_by("hit", F.struct(*[f"hit.{c}" for c in order])).alias("hit"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in kinds.columns]
    joined = marked.alias("d").join(best.alias("k"), same, "left")
    label = lambda place: F.element_at(F.create_map(*[F.lit(x) for code, entry in SUBCATEGORIES.items() for x in (code, entry[place])]), F.col("k.hit.subcategory"))
    main = F.element_at(F.create_map(*[F.lit(x) for pair in MAIN_CATEGORIES.items() for x in pair]), label(1))
    text = lambda c, default="": F.coalesce(c, F.lit(default))
    return joined.select(
        *[F.col(f"d.{c}").alias(c) for c in df.columns], text(main, UNCLASSIFIED).alias("cf_main"), text(label(0), UNCLASSIFIED).alias("cf_sub"), text(label(1), "unclassified").alias("cf_main_code"),
        text(F.col("k.hit.subcategory"), "unclassified").alias("cf_sub_code"), text(F.col("k.hit.name")).alias("cf_rule"), text(F.col("k.hit.keyword")).alias("cf_keyword"), text(F.col("k.hit.source")).alias("cf_source"),
    )
