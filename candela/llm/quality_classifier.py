"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to a column expression.

Shallow trees are grown on random parts of a bounded labelled sample. Every path from a root becomes a conjunctive
rule; a logistic model with an L1 penalty weighs the rules and drops most. What is left is one Spark expression over
the statistics, so scoring all documents runs in the JVM without Python.

Fitting uses the texts of at most `sample_rows` labelled doc_ids (a documented bound), chosen by a hash of doc_id, and
at most twice as many rows where texts share a doc_id. Everything else covers all rows.

Cases: null text counts as empty and gets a score like any text. Labels that are null are ignored; a doc_id labelled
more than once counts by its smallest label. With no usable label, or labels of one kind only, the score is the
smoothed share of good labels for every row. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import text_or_empty, words_of

SAMPLE_ROWS = 20_000
FEATURES = ["n_words", "word_length", "symbols", "capitals", "punctuation", "digits", "distinct_words", "stutter", "line_words", "repeated_lines", "bars", "shouts"]


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep and one double per feature."""
    text = F.col("t_text")
    df = docs.select(*(keep or []), text_or_empty(text_col).alias("t_text"))
    df = df.withColumn("t_words", words_of(text)).withColumn("t_lines", F.array_remove(F.split(text, "\n"), ""))
    df = df.withColumns({"t_n": F.size("t_words"), "t_chars": F.length(text), "t_l": F.size("t_lines")})
    without = lambda pattern: F.col("t_chars") - F.length(F.regexp_replace(text, pattern, ""))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
    n, pairs = F.col("t_n"), F.zip_with("t_words", F.slice("t_words", 2, F.greatest("t_n", F.lit(1))), lambda a, b: a == b)
    return df.select(
        *(keep or []),
        n.cast("double").alias("n_words"),
        per(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), n).alias("word_length"),
        per(without(r"[#*$%&|<>]+"), n).alias("symbols"),
        per(without(r"\p{Lu}+"), F.col("t_chars")).alias("capitals"),
        per(without(r"[.,;:!?]+"), n).alias("punctuation"),
        per(without(r"[0-9]+"), F.col("t_chars")).alias("digits"),
        per(F.size(F.array_distinct("t_words")), n).alias("distinct_words"),
        per(F.size(F.filter(pairs, lambda same: same)), n).alias("stutter"),
        per(n, F.col("t_l")).alias("line_words"),
        per(F.col("t_l") - F.size(F.array_distinct("t_lines")), F.col("t_l")).alias("repeated_lines"),
        per(without(r"\|+"), n).alias("bars"),
        per(without("!+"), n).alias("shouts"),
    )


@dataclass(frozen=True)
class Model:
    """bias and (weight, conditions); a condition is (feature, above, threshold): value > threshold where above, else <=."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for feature, above, threshold in conditions:
                holds = holds & ((F.col(feature) > threshold) if above else (F.col(feature) <= threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rng: np.random.Generator, out: set, least: int) -> None:
    """Adds the path of every node below the root; splits by the largest drop of Gini impurity over quantile cuts."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None)
    for f in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        v, t = x[rows, f], y[rows]
        cuts = np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25)))
        order = np.argsort(v, kind="stable")
        ones = np.r_[0, np.cumsum(t[order])]
        k = np.searchsorted(v[order], cuts, side="right")
        ok = (k >= least) & (len(rows) - k >= least)
        if not ok.any():
            continue
        k, cuts, n, total = k[ok], cuts[ok], len(rows), ones[-1]
        left, right = ones[k], total - ones[k]
        gain = (left**2 / k + (k - left) ** 2 / k + right**2 / (n - k) + (n - k - right) ** 2 / (n - k)) / n - (total**2 + (n - total) ** 2) / n**2
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (f, float(cuts[i])))
    if best[1] is None:
        return
    f, cut = best[1]
    above = x[rows, f] > cut
    _grow(x, y, rows[~above], depth - 1, (*path, (int(f), False, cut)), rng, out, least)
    _grow(x, y, rows[above], depth - 1, (*path, (int(f), True, cut)), rng, out, least)


def _matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    return np.stack([np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in r]) for r in rules], axis=1).astype(float)


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Logistic loss with an L1 penalty on the weights, by accelerated proximal gradient."""
    a = np.c_[np.ones(len(m)), m]
    step = 4.0 * len(m) / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / len(y)
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / nt * (new - w), new, nt
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3, rounds: int = 300, seed: int = 7) -> Model:
    """x: rows by FEATURES; y: 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        return Model(float(np.log(p / (1 - p))), ())
    rng, found = np.random.default_rng(seed), set()
    least = max(5, len(y) // 500)
    for _ in range(trees):
        rows = rng.choice(len(y), size=max(1, min(len(y), 5_000, len(y) // 2 + 1)), replace=False)
        _grow(x, y.astype(float), rows, depth, (), rng, found, least)
    rules = sorted(found)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    m = _matrix(x, rules)
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold for the same rows are one rule
    rules = [rules[i] for i in sorted(first)]
    bias, w = _lasso(_matrix(x, rules), y.astype(float), penalty, rounds)
    return Model(bias, tuple((float(v), tuple((FEATURES[f], above, t) for f, above, t in r)) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-9))


def held_out(id_col: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4) == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on the labelled rows that are not held out, sample_rows of them at most."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).alias("l_y"))
    sample = known.orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("l_text")).join(F.broadcast(sample), "l_id")
    table = statistics(rows, "l_text", ["l_id", "l_y"]).orderBy("l_id").limit(2 * sample_rows).toPandas()
    return fit(table[FEATURES].to_numpy(float), table["l_y"].to_numpy(int))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    rows = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("l_text")), "l_text", ["doc_id"])
    scored = rows.select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
