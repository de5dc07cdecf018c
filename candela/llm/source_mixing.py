"""Mixing sources to target weights by temperature, in DataFrame functions only.

A token is a word here. A source's share of the tokens is raised to an exponent and normalised. The exponent is found by repeated section of
[0, 1] (each round evaluates a grid of exponents in one grouped sum and keeps the bracket) so that the mixture is the
flattest whose most repeated source stays within the repetition limit, or the one that meets a target entropy. The
token budget is the largest under which the least repeated source is seen exactly once, so no document is dropped;
other sources repeat: whole epochs, then a prefix of one more permutation up to the quota.

Each epoch of a source is a permutation by a hash of the epoch and the document. The stream of a source is cut into
blocks by its cumulative tokens, so each block holds every source in proportion. Cumulative sums run over hash ranges
first and within a range after, so that a source with a third of all rows is no single task.

Cases: null text has no tokens; sources without tokens keep their documents once and take no weight. Null sources are
one source. Repeated rows share a hash and so their fate. Empty tables give empty results; extra columns are kept by
mix() and ignored by schedule().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.llm.common import durable, fresh, hot_join, text_or_empty, words_of

MAX_EPOCHS = 2.0
BLOCK_TOKENS = 1_000_000
GRID, ROUNDS = 32, 4
RANGES, ROWS_PER_RANGE = 64, 50_000


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(text_or_empty(text_col))).cast("long").alias("n_tokens"))


def _fraction(u: Column) -> Column:
    """A 64-bit hash as a double in [0, 1), in the order of the signed hash."""
    return u.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def hash_of(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), "doc_id", "n_tokens")


def exponent(shares: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, grid: int = GRID, rounds: int = ROUNDS) -> float:
    """shares: source, tokens > 0. The smallest exponent in [0, 1] within the repetition limit, or the largest with the entropy (nats).

    The entropy falls as the exponent grows from 0 (uniform) to 1 (natural); a target beyond either end gives that end.
    """
    top = shares.agg(F.max("tokens").alias("t")).first()["t"]
    if top is None:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        step = (high - low) / grid
        a = F.col("k") * step + low
        ratio = F.col("tokens") / F.lit(float(top))
        mass = F.pow(ratio, a)
        sums = shares.select("tokens", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("k")).groupBy("k").agg(
            F.sum(mass).alias("z"), F.sum(mass * a * F.log(ratio)).alias("zl"), F.max(F.pow(1 / ratio, 1 - a)).alias("epochs"),
        ).select("k", "epochs", (F.log("z") - F.col("zl") / F.col("z")).alias("h"))
        if entropy is not None:
            fit = sums.where(F.col("h") >= entropy).agg(F.max("k").alias("k")).first()["k"]
            k = 0 if fit is None else fit
            low, high = low + k * step, min(1.0, low + (k + 1) * step)
        else:
            fit = sums.where(F.col("epochs") <= max_epochs * (1 + 1e-12)).agg(F.min("k").alias("k")).first()["k"]
            k = grid if fit is None else fit
            low, high = max(0.0, low + (k - 1) * step), low + k * step
    return low if entropy is not None else high


def plan(docs: DataFrame, max_epochs: float = MAX_EPOCHS, entropy: float | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", counted: DataFrame | None = None) -> DataFrame:
    """source, tokens, weight, quota, full (whole epochs), cutoff: the hash up to which one more epoch goes, null for none."""
    rows = counted if counted is not None else durable(_counted(docs, id_col, text_col, source_col))
    totals = durable(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    live = totals.where("tokens > 0")
    a = exponent(live, max_epochs, entropy)
    ends = live.agg(F.max("tokens").alias("t"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z"), F.max("rows").alias("n")).first()
    if ends["t"] is None:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).cast("long").alias("full"), F.lit(None).cast("long").alias("cutoff"))
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(ends["z"])
    budget = ends["t"] ** (1.0 - a) * ends["z"]
    shares = totals.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(0.0))
    shares = shares.withColumn("quota", F.greatest("tokens", F.floor(F.col("weight") * F.lit(budget)).cast("long")))
    shares = shares.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long"))
    shares = durable(shares.withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens")))
    n = shares.count()
    # The partial epoch: token sums of hash ranges find the range in which the quota ends; only its rows are sorted.
    ranges = max(RANGES, -(-ends["n"] // ROWS_PER_RANGE))
    last = hot_join(rows, shares.where("rest > 0").select("source", "full", "rest"), ["source"], n, F.struct("doc_id", "n_tokens"))
    last = last.withColumn("u", hash_of(F.col("full"), seed)).withColumn("r", F.least(F.floor(_fraction(F.col("u")) * ranges), F.lit(ranges - 1)))
    sums = last.groupBy("source", "r").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"), F.max("u").alias("top"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = durable(sums.withColumn("before", before))
    whole = sums.where("before + t <= rest").groupBy("source").agg(F.max("top").alias("cut"))
    edge = sums.where("before <= rest and before + t > rest").select("source", "r", "before")
    inner = hot_join(last, edge, ["source", "r"], n, F.struct("doc_id", "n_tokens"))
    inner = inner.withColumn("end", F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "r").orderBy("u").rangeBetween(W.unboundedPreceding, 0)))
    part = inner.where("end <= rest").groupBy("source").agg(F.max("u").alias("cut"))
    cuts = whole.unionByName(part).groupBy("source").agg(F.max("cut").alias("cutoff"))
    return durable(shares.join(cuts, shares["source"].eqNullSafe(cuts["source"]), "left").select(shares["source"], "tokens", "weight", "quota", "full", "cutoff"))


def copies(seed: int) -> Column:
    """How often a row of doc_id, n_tokens, full, cutoff is taken."""
    return (F.col("full") + F.when(hash_of(F.col("full"), seed) <= F.col("cutoff"), 1).otherwise(0)).cast("int")


def _named(df: DataFrame) -> DataFrame:
    """Null sources need a key that joins."""
    return df.withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))


def schedule(docs: DataFrame, max_epochs: float = MAX_EPOCHS, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block, place: each taken copy, its block and the order within it."""
    rows = durable(_named(_counted(docs, id_col, text_col, source_col)))
    shares = plan(docs, max_epochs, entropy, seed, counted=rows)
    n = shares.count()
    top = shares.agg(F.sum("quota").alias("b"), F.max("tokens").alias("t")).first()
    blocks = max(1, -(-(top["b"] or 0) // block_tokens))
    ranges = max(RANGES, -(-(top["t"] or 0) // (ROWS_PER_RANGE * 100)))
    taken = hot_join(rows, shares, ["source"], n, F.struct("doc_id", "n_tokens"))
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), copies(seed) - 1)))
    taken = taken.withColumn("u", hash_of(F.col("epoch"), seed)).withColumn("r", F.least(F.floor(_fraction(F.col("u")) * ranges), F.lit(ranges - 1)))
    sums = taken.groupBy("source", "epoch", "r").agg(F.sum("n_tokens").alias("t"))
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(W.partitionBy("source", "epoch").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("t")
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "epoch", "r").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = taken.withColumn("within", within).join(sums, ["source", "epoch", "r"])
    at = (F.col("epoch") * F.col("tokens") + F.col("before") + F.col("within")) / F.greatest(F.col("quota"), F.lit(1))
    block = F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long")
    source = F.when(F.col("source") == "null", F.lit(None)).otherwise(F.substr("source", F.lit(2))).alias("source")
    return placed.select("doc_id", source, "n_tokens", "weight", "epoch", block.alias("block")).withColumn("place", F.xxhash64(F.lit(seed), "block", "doc_id", "epoch"))


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, entropy: float | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The taken copies of docs as rows, with all their columns. Texts are not shuffled while sources are within the broadcast bound."""
    shares = plan(docs, max_epochs, entropy, seed, counted=durable(_named(_counted(docs, id_col, text_col, source_col))))
    row = fresh(docs, "d_row")
    tagged = docs.select(
        F.struct(*docs.columns).alias(row), F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("source"), F.size(words_of(text_or_empty(text_col))).cast("long").alias("n_tokens"),
    )
    joined = hot_join(tagged, shares.select("source", "full", "cutoff"), ["source"], shares.count(), F.struct("doc_id", "n_tokens"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), copies(seed)))).select(f"{row}.*")
