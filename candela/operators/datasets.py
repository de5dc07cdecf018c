"""Evaluation items and training examples from chunks, retrieved passages and completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions import prompts
from candela.functions import text as T
from candela.operators import answers, evaluate

#: Kinds of questions, dealt in turn.
STYLES = ("factual", "practical", "definition")


def substantive(text: Column, min_chars: int = 400) -> Column:
    """Long enough, and no table."""
    return (F.length(text) >= min_chars) & (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) < 10)


def split_of(split: Column, key: Column) -> Column:
    """An item's own split, or else that of its key."""
    return F.coalesce(F.nullif(split, F.lit("")), T.assign_split(key))


def styled(pool: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 0) in the order, and style, which goes round. The pool is a bounded sample."""
    place = F.row_number().over(W.orderBy(*order)) - 1
    style = F.get(F.array(*[F.lit(s) for s in STYLES]), F.col("place") % len(STYLES))
    return pool.withColumn("place", place).withColumn("style", style)


def numbered(rows: DataFrame, prefix: str, order: list[str], n: int) -> DataFrame:
    """The first n rows with ids of the prefix and a running number."""
    at = F.row_number().over(W.orderBy(*order)) - 1
    return rows.withColumn("at_", at).where(F.col("at_") < n).withColumn("id", F.concat(F.lit(prefix), F.lpad(F.col("at_").cast("string"), 4, "0"))).drop("at_")


def _place(c: Column) -> Column:
    return F.concat_ws("|", c["source"], c["page"].cast("string"))


def single_items(chunks: DataFrame, generate: Callable[..., Column], n: int, min_chars: int = 400, seed: int = 0) -> DataFrame:
    """chunks: id, source, page, section, text. n items of one passage each, round the sources, twice as many being tried."""
    some = chunks.where(substantive(F.col("text"), min_chars))
    pool = evaluate.round_robin(some, n, seed)
    pool = styled(pool, ["round", "source"]).where(F.col("place") < 2 * n)
    said = pool.withColumn("said", F.from_json(generate(prompts.question_of(F.col("source"), F.col("section"), F.col("text"), F.col("style")), prompts.QUESTION, 500, 0.3), "usable boolean, question string, answer string"))
    asked = said.select("*", F.col("said.usable").alias("usable"), F.lit(None).cast("boolean").alias("needs_both"), F.trim("said.question").alias("question"), F.trim("said.answer").alias("answer"))
    kept = numbered(evaluate.usable_questions(asked).drop("id"), "s", ["place"], n)
    gold = F.array(F.struct("source", "page"))
    return kept.select("id", F.lit("single").alias("type"), "style", "question", "answer", F.lit(True).alias("answerable"), gold.alias("gold"), F.array("text").alias("evidence"), T.assign_split(F.concat_ws("|", "source", F.col("page").cast("string"))).alias("split"))


def pair_items(pairs: DataFrame, generate: Callable[..., Column], n: int) -> DataFrame:
    """pairs: kind, turn, a, b (structs of source, page, section, text). n // 2 items of each kind."""
    said = pairs.withColumn("said", F.from_json(generate(prompts.question_of_two(F.col("kind"), F.col("a"), F.col("b")), prompts.QUESTION_OF_TWO, 700, 0.3), "usable boolean, needs_both boolean, question string, answer string"))
    asked = said.select("*", F.col("said.usable").alias("usable"), F.coalesce(F.col("said.needs_both"), F.lit(False)).alias("needs_both"), F.trim("said.question").alias("question"), F.trim("said.answer").alias("answer"))
    first = evaluate.usable_questions(asked).withColumn("k_", F.row_number().over(W.partitionBy("kind").orderBy("turn"))).where(F.col("k_") <= n // 2)
    kept = numbered(first, "m", [F.col("kind").desc(), "turn"], n)
    gold = F.array(F.struct("a.source", "a.page"), F.struct("b.source", "b.page"))
    return kept.select("id", F.col("kind").alias("type"), F.col("kind").alias("style"), "question", "answer", F.lit(True).alias("answerable"), gold.alias("gold"), F.array("a.text", "b.text").alias("evidence"), T.assign_split(_place(F.col("a"))).alias("split"))


def unanswerable_items(batches: DataFrame, n: int) -> DataFrame:
    """batches: batch, questions (array). n items; of questions that share their first 60 characters the first stays."""
    asked = batches.select("batch", F.posexplode("questions").alias("pos", "question"))
    first = asked.withColumn("k_", F.row_number().over(W.partitionBy(F.substring("question", 1, 60)).orderBy("batch", "pos"))).where("k_ = 1")
    kept = numbered(first, "u", ["batch", "pos"], n)
    none = F.array().cast("array<struct<source:string,page:int>>")
    return kept.select("id", F.lit("unanswerable").alias("type"), F.lit("unanswerable").alias("style"), F.trim("question").alias("question"), F.lit("").alias("answer"), F.lit(False).alias("answerable"), none.alias("gold"), F.array().cast("array<string>").alias("evidence"), T.assign_split(F.col("id")).alias("split"))


def asked_batches(spark, generate: Callable[..., Column], sources: list[str], n: int, seen: int = 8, most: int = 20) -> DataFrame:
    """Calls for questions, five at a time, until n differ in their first 60 characters; each call names the last themes. At most `most` calls."""
    told: list[tuple[int, list[str]]] = []
    themes: list[str] = []
    while len(themes) < n and len(told) < most:
        one = spark.createDataFrame([(", ".join(sources), "; ".join(themes[-seen:]))], "sources string, avoid string")
        got = one.select(F.from_json(generate(prompts.unanswerable(F.col("sources"), F.col("avoid")), prompts.QUESTIONS, 600, 1.0), "questions array<string>")["questions"].alias("q")).first()["q"] or []
        told.append((len(told), got))
        themes += [t for t in dict.fromkeys(q[:60] for q in got) if t not in themes]
    return spark.createDataFrame(told, "batch int, questions array<string>")


# Training examples

def answer_examples(items: DataFrame, hits: DataFrame, split: str = "train") -> DataFrame:
    """items: id, type, question, answer, answerable, gold, split; hits: id, rank, source, page, section, text. What a reward needs, one row a question."""
    mine = items.where(split_of(F.col("split"), F.col("id")) == split)
    found = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "page", "section", "text"))).alias("found"))
    rows = mine.join(found, "id", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    gold = F.transform(F.filter("found", lambda h: F.exists("gold", lambda g: (g["source"] == h["source"]) & (g["page"] == h["page"]))), lambda h: h["rank"])
    return rows.select("id", F.coalesce("type", F.lit("single")).alias("type"), prompts.grounded(F.col("question"), answers.format_passages(F.col("found"))).alias("prompt"), F.transform("found", lambda h: h["text"]).alias("passages"), gold.alias("gold"), "answerable", F.col("answer").alias("reference"))


def decompose_examples(items: DataFrame, split: str = "train", most: int = 3) -> DataFrame:
    """The answerable items of a split with the prompt to decompose them."""
    mine = items.where((split_of(F.col("split"), F.col("id")) == split) & F.col("answerable"))
    return mine.select("id", F.coalesce("type", F.lit("single")).alias("type"), prompts.decompose(F.col("question"), most).alias("prompt"), "question", "gold")


def completion_rewards(rows: DataFrame, scorer: Callable[[Column, Column], Column], threshold: float = 0.05) -> DataFrame:
    """rows: id, completion, passages (array of texts), gold (array of ranks), answerable, reference. Adds reward, read from the completion."""
    read = rows.withColumn("claims_", answers.parse_claims(F.col("completion"), F.size("passages"))).withColumn("object_", F.coalesce(F.from_json(T.json_object(F.col("completion")), "map<string,string>").isNotNull(), F.lit(False)))
    claims = read.select("id", F.posexplode("claims_").alias("pos", "c")).select(F.struct("id", "pos").alias("cid"), F.col("id").alias("qid"), "c.text", "c.citations")
    passages = read.select(F.col("id").alias("qid"), F.posexplode("passages").alias("at", "text")).select("qid", (F.col("at") + 1).alias("rank"), "text")
    supported = answers.verify(claims, passages, scorer, threshold).groupBy(F.col("cid.id").alias("id")).agg(F.sum(F.col("supported").cast("int")).alias("supported"))
    told = answers.coverage(read.select("id", "reference", F.coalesce(F.transform("claims_", lambda c: c["text"]), F.array().cast("array<string>")).alias("claims")), scorer, threshold)
    cites = F.exists("claims_", lambda c: F.arrays_overlap(c["citations"], F.col("gold")))
    full = read.join(supported, "id", "left").join(told, "id", "left").select(
        *rows.columns, F.col("claims_").isNotNull().alias("parsed"), F.col("object_").alias("object"), F.coalesce(F.size("claims_"), F.lit(0)).alias("n_claims"), F.coalesce("supported", F.lit(0)).alias("supported"),
        (F.size("gold") > 0).alias("has_gold"), F.coalesce(cites, F.lit(False)).alias("cites_gold"), (F.coalesce("reference", F.lit("")) != "").alias("has_reference"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )
    return answers.answer_reward(full)


def training_pairs(*parts: DataFrame) -> DataFrame:
    """prompt, chosen, rejected, kind of all parts, one below the other."""
    out = parts[0].select("prompt", "chosen", "rejected", "kind")
    for p in parts[1:]:
        out = out.unionByName(p.select("prompt", "chosen", "rejected", "kind"))
    return out


def unsupported_cases(items: DataFrame, hits: DataFrame, scorer: Callable[[Column, Column], Column], top: int, below: float = 0.5, most: int = 80, seed: int = 0) -> DataFrame:
    """items: qid, reference; hits: qid, page, rank, text off the gold pages, see counterfactual_hits. Questions none of whose passages supports a sentence of the reference.

    The first `most` in hash order; questions without hits or sentences are left out.
    """
    parts = items.select("qid", F.explode(T.reference_sentences(F.col("reference"))).alias("sentence")).join(hits.where(F.col("rank") <= top).select("qid", "text"), "qid")
    best = parts.groupBy("qid").agg(F.max(scorer(F.col("sentence"), F.col("text"))).alias("best")).where(F.col("best") < below)
    key = F.sha1(F.concat_ws("|", F.lit(seed), F.col("qid").cast("string")))
    return best.withColumn("key", key).orderBy("key", "qid").limit(most).select("qid", "best")
