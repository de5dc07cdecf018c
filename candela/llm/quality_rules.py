"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once per document. The ledger keeps the measurements and one integer with a bit per failed
rule; policies are named masks over these bits, so another policy version or an ablation reads the ledger and never
the texts again.

Cases: null or blank text has no words and fails "few_words". Repeated rows each get their own ledger row; an empty
table gives an empty ledger. Extra columns are ignored by the ledger and kept by the filter. Measurements count over
the whole text, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import WS, durable, text_or_empty, words_of

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where the SQL predicate over the measurements holds."""

    name: str
    fails: str


#: The position in this list is the rule's bit; append only, so that stored ledgers stay readable.
RULES = [
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * n_upper > n_letters"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
]

#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "short_words", "long_words"],
}


def mask_of(names: list[str], rules: list[Rule] = RULES) -> int:
    return sum(1 << i for i, rule in enumerate(rules) if rule.name in names)


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Adds the measurements of column `text` (never null). Each step is a projection of its own, as later ones refer to it more than once."""
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    df = df.withColumn("m_words", words_of(F.col(text))).withColumn("m_lines", F.filter(F.split(text, "\n"), has_word))
    df = df.withColumns({
        "n_words": F.size("m_words").cast("long"),
        "m_grams": F.when(F.size("m_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("m_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("m_words", i, WINDOW)))).otherwise(F.array().cast("array<long>")),
        "n_lines": F.size("m_lines").cast("long"),
        "n_dup_lines": (F.size("m_lines") - F.size(F.array_distinct("m_lines"))).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
    })
    df = df.withColumn("m_repeats", F.size(F.array_distinct("m_grams")) < F.size("m_grams"))
    # Only where a window recurs: sort the windows with their places, keep those that have an equal neighbour.
    df = df.withColumn("m_sorted", F.when(F.col("m_repeats"), F.sort_array(F.transform("m_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda x, at: F.get("m_sorted", at)["h"].eqNullSafe(x["h"])
    at = F.transform("m_sorted", lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"]).otherwise(F.lit(-1)))
    covered = F.flatten(F.transform(F.filter(at, lambda p: p >= 0), lambda p: F.sequence(p, p + (WINDOW - 1))))
    return df.withColumn("n_repeat_words", F.when(F.col("m_repeats"), F.size(F.array_distinct(covered))).otherwise(0).cast("long"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"]


def failure_bits(rules: list[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits, one row per document; stored, so that policies never evaluate a rule again."""
    df = _measured(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("m_text")), "m_text")
    return durable(df.select("doc_id", *MEASURES).withColumn("fail_bits", failure_bits(rules)))


def apply_policy(book: DataFrame, policy: str | list[str], rules: list[Rule] = RULES) -> DataFrame:
    """Adds kept: none of the policy's rules failed."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) == 0)


def ablations(book: DataFrame, policy: str | list[str], rules: list[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents it rejects, those it alone rejects, and those kept without it."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    mask = mask_of(names, rules)
    masked = book.select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in names])).alias("r")
    has = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    return masked.select("b", "n", one).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", policy: str | list[str] = "v1") -> DataFrame:
    """The rows of docs that pass the policy, with all their columns."""
    row, text = "d_row", "m_text"
    df = docs.select(F.struct(*docs.columns).alias(row), text_or_empty(text_col).alias(text))
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = _measured(df, text).withColumn("fail_bits", failure_bits())
    # Not deterministic, so the optimizer keeps the filter above the measurements and evaluates them once.
    bits = apply_policy(bits, names).withColumn("m_once", F.monotonically_increasing_id())
    return bits.where("kept and m_once >= 0").select(f"{row}.*")
