"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to a Spark column.

Statistics are built-in column functions over whole texts, computed once and
written. On a bounded sample of labelled rows (``max_train_rows``, smallest hash
of the id) boosted trees are grown; every path of a tree is a conjunctive rule;
a lasso-penalised logistic regression weighs the rules, its penalty chosen on a
slice of the sample, and most weights end at zero. What remains becomes one
column expression, so scoring needs no Python.

Defined results: a null text counts as empty and is scored like any text; with no
usable labels every score is 0.5, with labels of one class it is their smoothed
share; documents without a label are scored; repeated rows give equal rows; null
ids are scored; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace, smallest_hashes

#: Frequent function words of the languages served.
FUNCTION_WORDS = "the and of to in is that it for a de la le les des et en un une que der die und das den el los las y con von mit".split()


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; all are finite for an empty text."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(t), r"\s+")
    lines = F.split(t, "\n")
    n, n_words, n_lines = F.greatest(F.length(t), F.lit(1)), F.size(words), F.size(lines)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "word_length": F.length(t) / n_words,
        "upper": count("[A-Z]") / n,
        "digits": count("[0-9]") / n,
        "symbols": count(r"[#%&*$@{}<>=_~^\\\[\]+/]") / n,
        "bars": count(r"\|") / n,
        "shouts": count("[!?]") / n,
        "stops": count("[.,;:]") / n_words,
        "line_words": n_words / n_lines,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "function_words": F.size(F.array_intersect(words, F.array(*map(F.lit, FUNCTION_WORDS)))) / F.least(n_words, F.lit(40)),
        "function_share": F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS[:12]))) / n_words,
    }


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, cut, above): all must hold


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 5) -> list[Rule]:
    """The paths of boosted trees, each grown on half the rows and half the statistics."""
    r, score, rules = np.random.default_rng(seed), np.zeros(len(y)), {}
    grid = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(r.random(len(y)) < 0.5)
        stats = r.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
        todo, update = [((), rows, np.arange(len(y)))], np.zeros(len(y))
        while todo:
            path, own, reach = todo.pop()
            best, cut = 1e-9, None
            if len(path) < depth and len(own) >= 20:
                g = residual[own]
                for f in stats:
                    above = x[own, f][None] > grid[f][:, None]
                    n, s = above.sum(1), above @ g
                    m = len(own) - n
                    gain = np.where((n >= 10) & (m >= 10), s**2 / np.maximum(n, 1) + (g.sum() - s) ** 2 / np.maximum(m, 1) - g.sum() ** 2 / len(g), 0)
                    if gain.max() > best:
                        best, cut = gain.max(), (int(f), float(grid[f][gain.argmax()]))
            if cut is None:
                update[reach] = residual[own].mean() if len(own) else 0
                continue
            for above in (True, False):
                rule = (*path, (*cut, above))
                rules[tuple(sorted(rule))] = None
                todo.append((rule, own[(x[own, cut[0]] > cut[1]) == above], reach[(x[reach, cut[0]] > cut[1]) == above]))
        score += 1.5 * update
    return list(rules)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, cut, above in rule:
            out[:, j] *= (x[:, f] > cut) == above
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    w, b, z, zb, t = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0, 1.0
    rate = 4 * len(y) / (np.linalg.norm(np.c_[a, np.ones(len(y))], 2) ** 2 + 1e-9)
    for _ in range(steps):
        d = (1 / (1 + np.exp(-(a @ z + zb))) - y) / len(y)
        step = z - rate * (a.T @ d)
        new, new_b = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), zb - rate * d.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb, w, b, t = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b), new, new_b, after
    return w, b


class RuleModel:
    """Rules over named statistics with their weights and an intercept."""

    def __init__(self, names: list[str], rules: list[Rule], weights: np.ndarray, intercept: float):
        kept = np.flatnonzero(np.abs(weights) > 1e-4)
        self.names, self.rules, self.weights, self.intercept = names, [rules[i] for i in kept], weights[kept], float(intercept)

    def column(self) -> Column:
        """The score as a column over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            tests = [(F.col(self.names[f]) > cut) if above else (F.col(self.names[f]) <= cut) for f, cut, above in rule]
            both = tests[0]
            for t in tests[1:]:
                both = both & t
            total = total + F.when(both, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    if len(y) < 40 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleModel(names, [], np.zeros(0), float(np.log(share / (1 - share))))
    tuning = np.arange(len(y)) % 5 == 0
    rules = grow_rules(x[~tuning], y[~tuning])
    a, found = holds(rules, x), []
    for penalty in (0.001, 0.003, 0.01, 0.03):
        w, b = lasso(a[~tuning], y[~tuning], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[tuning] @ w + b))), 1e-6, 1 - 1e-6)
        losses = -(y[tuning] * np.log(p) + (1 - y[tuning]) * np.log(1 - p))
        found.append((losses.mean(), losses.std() / np.sqrt(len(losses)), penalty))
    least, error, _ = min(found)
    chosen = max(penalty for loss, _, penalty in found if loss <= least + error)  # the sparsest within one standard error
    return RuleModel(names, rules, *lasso(a, y, chosen))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; only rows not held out teach."""
    stats = statistics(F.col("text"))
    names = list(stats)
    ws = Workspace(docs.sparkSession, "quality")
    table = ws.write(docs.select("doc_id", held_out().alias("held_out"), *[c.cast("double").alias(k) for k, c in stats.items()]), "statistics")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table.where(~F.col("held_out")).join(known, "doc_id")
    got = smallest_hashes(rows, max_train_rows, "doc_id").select("quality", *names).collect()
    model = fit(np.array([r[1:] for r in got], float).reshape(len(got), len(names)), np.array([r[0] for r in got], float), names)
    return table.select("doc_id", "held_out", model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
