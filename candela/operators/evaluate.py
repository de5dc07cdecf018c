"""Retrieval metrics, summaries, calibration, confidence intervals and sampling for evaluation sets.

Cases: questions without hits or gold have metrics of 0, and all of no gold pages are found. Null measures are left out
of means. Ties are broken by id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions import text as T


#: Slices of a unit of score, and rounds of a block, over which running sums go before they go within.
SLICES, BLOCK_ROUNDS = 1000, 1000


def retrieval_metrics(hits: DataFrame, gold: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """hits: qid, page, rank; gold: qid, page. One row a question: recall@k, all@k, mrr, ndcg@10."""
    firsts = hits.groupBy("qid", "page").agg(F.min("rank").alias("rank"))  # a page counts once, at its best rank
    rel = gold.select("qid", "page").distinct().join(firsts, ["qid", "page"], "left").groupBy("qid").agg(F.count("*").alias("n_gold"), F.min("rank").alias("first"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    df = questions.select("qid").join(rel, "qid", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0))).withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    gain = F.aggregate(F.filter("ranks", lambda r: r <= 10), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + F.lit(1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest("n_gold", F.lit(1)), F.lit(10))), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + F.lit(1.0)))
    cols = [F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"recall_{k}") for k in ks]
    cols += [(F.size(F.filter("ranks", lambda r: r <= k)) == F.col("n_gold")).cast("int").alias(f"all_{k}") for k in ks]
    return df.select("qid", "n_gold", *cols, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n_gold") > 0, gain / ideal).otherwise(0.0).alias("ndcg_10"))


def summary(rows: DataFrame, by: str, measures: list[str], subsets: dict[str, Column]) -> DataFrame:
    """Means of each measure over all rows and over each subset, by conditional aggregation; empty subsets are null."""
    aggs = [F.count("*").alias("n")] + [F.avg(m).alias(m) for m in measures]
    aggs += [F.avg(F.when(cond, F.col(m))).alias(f"{name}_{m}") for name, cond in subsets.items() for m in measures]
    return rows.groupBy(by).agg(*aggs)


def youden_threshold(scored: DataFrame) -> DataFrame:
    """(score, positive): the threshold with the largest true- minus false-positive rate; the smallest of equals.

    Candidates are 0 and every score. Counts by distinct score are pre-aggregated; running sums go over slices of the
    scores first and within a slice after, so no task sorts all scores.
    """
    by = scored.groupBy("score").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum(1 - F.col("positive").cast("int")).alias("n"))
    zero = scored.sparkSession.range(1).select(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    by = by.unionByName(zero).groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # Slices follow the range of the scores, so there are as many for logits as for shares.
    ends = by.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    by = by.crossJoin(F.broadcast(ends)).withColumn("slice", F.floor((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * SLICES)).drop("lo", "hi")
    up = W.partitionBy("slice").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    above = W.orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    zeros = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    slices = by.groupBy("slice").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn")).select("slice", zeros("sp").alias("bp"), zeros("sn").alias("bn"))
    total = by.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    run = by.select("slice", "score", F.sum("p").over(up).alias("cp"), F.sum("n").over(up).alias("cn")).join(slices, "slice")
    run = run.select("score", (F.col("cp") + F.col("bp")).alias("cp"), (F.col("cn") + F.col("bn")).alias("cn")).crossJoin(F.broadcast(total))
    j = F.col("cp") / F.greatest("tp", F.lit(1)) - F.col("cn") / F.greatest("tn", F.lit(1))
    return run.select(F.col("score").alias("threshold"), j.alias("j")).orderBy(F.round("j", 9).desc(), "threshold").limit(1)


def bootstrap_ci(values: DataFrame, by: str, rounds: int = 1000, seed: int = 0, order: str = "value") -> DataFrame:
    """(by, value, order): half the width of the 95 % bootstrap interval of the mean; null for fewer than two values.

    Values are drawn by their places in the given order, so one seed gives one result.
    """

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        v = [x for x in group.sort_values(order, kind="stable")["value"] if x == x]
        if len(v) < 2:
            return pd.DataFrame({by: [key[0]], "half_width": [None]})
        rng = random.Random(seed)
        means = sorted(sum(rng.choices(v, k=len(v))) / len(v) for _ in range(rounds))
        return pd.DataFrame({by: [key[0]], "half_width": [round((means[int(0.975 * rounds)] - means[int(0.025 * rounds)]) / 2, 3)]})

    return values.groupBy(by).applyInPandas(one, f"{by} {values.schema[by].dataType.simpleString()}, half_width double")


def limit_per_type(items: DataFrame, n: int, kind: str = "type", order: str = "id") -> DataFrame:
    return items.withColumn("k", F.row_number().over(W.partitionBy(kind).orderBy(order))).where(F.col("k") <= n).drop("k")


def round_robin(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(source, id): whole rounds over the sources, each in hash order, until 2n are taken."""
    ranked = items.withColumn("round", F.row_number().over(W.partitionBy("source").orderBy(F.sha1(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), "id")))
    sizes = ranked.groupBy("round").agg(F.count("*").alias("c"))
    sizes = sizes.withColumn("block", F.floor(F.col("round") / BLOCK_ROUNDS))
    earlier = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("block").agg(F.sum("c").alias("c")).select("block", earlier(W.orderBy("block")).alias("base"))
    before = sizes.select("round", "block", earlier(W.partitionBy("block").orderBy("round")).alias("within")).join(blocks, "block")
    kept = before.where(F.col("base") + F.col("within") < 2 * n).select("round")
    return ranked.join(kept, "round")


def similar_pairs(vectors: DataFrame, low: float, high: float, queries: DataFrame) -> DataFrame:
    """(unit_id, vec): for each query row its most similar other unit within [low, high]."""
    from candela.operators.retrieval import dense

    near = dense(queries, vectors, 40).where((F.col("score") >= low) & (F.col("score") <= high))
    best = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "unit_id"))
    return near.withColumn("b", best).where("b = 1").select("qid", "unit_id", "score")


def matched_pairs(units: DataFrame, kind: str, low: float = 0.55, high: float = 0.9, n: int | None = None, seed: int = 0) -> DataFrame:
    """units: unit_id, vec, source, section, page. Related pairs a, b, score of passages that are in one pair at most.

    In hash order each free unit takes its most similar free one within [low, high] among its 40 nearest, itself
    included; for 'comparison' of another source, for 'bridge' of the same source, another section and a page gap over
    1. n keeps the first pairs. All units are compared with all. A round settles every unit that no earlier one can touch.
    """
    from candela.operators.retrieval import dense
    from candela.session import durable

    if kind not in ("comparison", "bridge"):
        raise ValueError(f"unknown kind of pairs {kind}")
    near = dense(units.select(F.col("unit_id").alias("qid"), "vec"), units.select("unit_id", "vec"), 39).where((F.col("score") >= low) & (F.col("score") <= high))
    side = lambda c: units.select(F.col("unit_id").alias(c), F.struct("source", "section", "page").alias(f"{c}_at"))
    both = near.select(F.col("qid").alias("a"), F.col("unit_id").alias("b"), "score").join(side("a"), "a").join(side("b"), "b")
    same, other = F.col("a_at.source").eqNullSafe(F.col("b_at.source")), ~F.col("a_at.section").eqNullSafe(F.col("b_at.section"))
    fits = ~same if kind == "comparison" else same & other & (F.abs(F.col("a_at.page") - F.col("b_at.page")) > 1)
    turn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("id"))
    live, pairs = durable(both.where(fits).select("a", "b", "score", turn("a").alias("turn"))), None
    while live.limit(1).count():
        first = live.select(F.col("b").alias("x"), "turn").union(live.select(F.col("a").alias("x"), "turn")).groupBy("x").agg(F.min("turn").alias("first"))
        best = F.row_number().over(W.partitionBy("a").orderBy(F.round("score", 9).desc(), "b"))
        wish = live.withColumn("k", best).where("k = 1").drop("k")
        for c in ("a", "b"):
            wish = wish.join(first.withColumnRenamed("x", c), c).where("first = turn").drop("first")
        settled = durable(wish)
        used = settled.select(F.explode(F.array("a", "b")).alias("x"))
        for c in ("a", "b"):
            live = live.join(used.withColumnRenamed("x", c), c, "left_anti")
        live, pairs = durable(live), settled if pairs is None else pairs.unionByName(settled)
    out = live.limit(0) if pairs is None else pairs
    return (out if n is None else out.orderBy("turn").limit(n)).select("a", "b", "score")


def score_spread(scored: DataFrame, by: str) -> DataFrame:
    """Least, median and largest score of each kind; the median is the element at half the count, from 0."""
    at = W.partitionBy(by).orderBy("score")
    ranked = scored.select(by, "score", F.row_number().over(at).alias("r"), F.count("*").over(W.partitionBy(by)).alias("n"))
    middle = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("score")))
    return ranked.groupBy(by).agg(F.min("score").alias("least"), middle.alias("median"), F.max("score").alias("largest"))


def refusal_rates(rows: DataFrame, by: str) -> DataFrame:
    """rows: answerable, insufficient, action. Shares of wrong refusals among answerable and of refusals among other items."""
    refused = F.col("insufficient") | (F.col("action") == "ANSWER_DIRECTLY")
    return rows.groupBy(by).agg(
        F.avg(F.when(F.col("answerable"), F.col("insufficient").cast("double"))).alias("false_refusal"),
        F.avg(F.when(~F.col("answerable"), refused.cast("double"))).alias("unanswerable_refusal"),
    )


def verdict_score(verdict: Column) -> Column:
    """A judge's verdict as 1, 0.5 or 0; null for any other word."""
    scores = F.create_map(F.lit("correct"), F.lit(1.0), F.lit("partially_correct"), F.lit(0.5), F.lit("incorrect"), F.lit(0.0))
    return F.try_element_at(scores, F.lower(F.trim(verdict)))


def usable_questions(rows: DataFrame) -> DataFrame:
    """rows: usable, needs_both (null for single questions), question. Those long enough, and that need both passages."""
    several = F.col("needs_both").isNotNull()
    return rows.where(F.col("usable") & F.when(several, F.col("needs_both") & (F.length("question") >= 20)).otherwise(F.length("question") >= 15))


def citation_metrics(claims: DataFrame, passages: DataFrame, gold: DataFrame) -> DataFrame:
    """claims: qid, citations, supported; passages: qid, rank, source, page, page_end; gold: qid, source, page.

    qid, cited_claim_rate, cites_gold, cites_all_gold over the claims that are not known to be unsupported. A passage
    stands for all pages of its range. Questions without such claims have no rate; those without gold no gold columns.
    """
    kept = claims.where("supported is null or supported")
    rate = kept.groupBy("qid").agg(F.avg((F.size("citations") > 0).cast("double")).alias("cited_claim_rate"))
    cited = kept.select("qid", F.explode("citations").alias("rank")).distinct()
    used = cited.join(passages, ["qid", "rank"]).select("qid", "source", F.explode(T.page_range(F.col("page"), F.col("page_end"))).alias("page")).distinct()
    found = gold.select("qid", "source", "page").distinct().join(used.withColumn("hit", F.lit(1)), ["qid", "source", "page"], "left")
    gold_rows = found.groupBy("qid").agg((F.count("hit") > 0).cast("double").alias("cites_gold"), (F.count("hit") == F.count("*")).cast("double").alias("cites_all_gold"))
    return rate.join(gold_rows, "qid", "full")


#: Which subset each measure of a summary is taken over, by the measure's name in the rows.
SUBSETS = {
    "r_5": ("recall_5", "single"), "mrr": ("mrr", "single"), "multi_all_5": ("all_5", "multi"), "multi_all_10": ("all_10", "multi"), "correct": ("correctness", "single"), "multi_correct": ("correctness", "multi"),
    "faithful": ("faithfulness", "all"), "cited": ("cited_claim_rate", "all"), "cites_gold": ("cites_gold", "single"), "multi_cites_all": ("cites_all_gold", "multi"), "latency_s": ("latency", "all"),
}


def subset_summary(rows: DataFrame, by: str = "variant") -> DataFrame:
    """rows: variant, type, answerable, insufficient, action and any measures of SUBSETS. One row a variant: counts and means to three digits.

    Single questions, those of two passages (comparison, bridge) and unanswerable ones are apart; a measure without a
    value is null. Measures that rows lack are left out.
    """
    kind = F.coalesce("type", F.lit("single"))
    subset = {"single": F.col("answerable") & (kind == "single"), "multi": F.col("answerable") & kind.isin("comparison", "bridge"), "unanswerable": ~F.col("answerable"), "all": F.lit(True)}
    aggs = [F.count("*").alias("n")] + [F.count(F.when(subset[s], 1)).alias(f"n_{s}") for s in ("single", "multi", "unanswerable")]
    aggs += [F.round(F.avg(F.when(subset[s], F.col(c))), 3).alias(name) for name, (c, s) in SUBSETS.items() if c in rows.columns]
    aggs.append(F.round(F.avg(F.when(F.col("answerable"), F.col("insufficient").cast("double"))), 3).alias("false_refusal"))
    refused = (F.col("insufficient") | (F.col("action") == "ANSWER_DIRECTLY")).cast("double")
    aggs.append(F.round(F.avg(F.when(~F.col("answerable"), refused)), 3).alias("unans_refusal"))
    return rows.groupBy(by).agg(*aggs)
