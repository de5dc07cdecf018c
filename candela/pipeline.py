"""Ingest and answering over tables: a whole table of questions goes through each step together."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela import models
from candela.config import Config
from candela.operators import answers, chunking, retrieval
from candela.session import durable


def ingest(blocks: DataFrame, config: Config) -> DataFrame:
    """blocks: source, ord, kind, text, page, section. Chunks, or children where child_size is set."""
    kept = blocks.where((F.col("kind") != "paragraph") | (F.length("text") >= config.ingest.min_block_chars))
    chunks = chunking.chunk_blocks(kept, config.ingest.chunk_size, config.ingest.chunk_overlap)
    return chunking.make_children(chunks, config.ingest.child_size, config.ingest.child_overlap) if config.ingest.child_size else chunks


def fused(asked: DataFrame, units: DataFrame, config: Config, children: DataFrame | None = None) -> DataFrame:
    """asked: qid, text, weight, several rows a question. qid, unit_id, score, rank by the reciprocal ranks of all searches.

    children: unit_id, text, parent_id. Where there are any they are searched, and the units they are of take their best
    child's place.
    """
    r, parents = config.retrieval, units
    units = parents if children is None else children
    keyed = asked.select(F.struct("qid", "text", "weight").alias("qid"), "text")
    found = []
    if r.mode in ("dense", "hybrid"):
        vectors = units.select("unit_id", models.embed("text").alias("vec"))
        found.append(retrieval.dense(keyed.select("qid", models.embed("text").alias("vec")), vectors, r.fetch_k, same_ids=False))
    if r.mode in ("sparse", "hybrid") and r.sparse == "bm25":
        found.append(retrieval.bm25(keyed, units, r.fetch_k, r.k1, r.b))
    elif r.mode in ("sparse", "hybrid"):
        weights = retrieval.query_terms(keyed).withColumn("w", F.lit(1.0))
        found.append(retrieval.sparse_of_lists(weights, retrieval.token_lists(units), r.fetch_k))
    ranked = [f.select("qid.qid", "qid.weight", "unit_id", "rank") for f in found]
    both = ranked[0] if len(ranked) == 1 else ranked[0].unionByName(ranked[1])
    ranked = retrieval.held(retrieval.reciprocal_ranks(both, r.rrf_k))
    return ranked if children is None else retrieval.held(retrieval.to_parents(ranked, children.select("unit_id", "parent_id")))


def candidates(questions: DataFrame, units: DataFrame, config: Config, agents=models, children: DataFrame | None = None) -> DataFrame:
    """Rankings of each question (weight 2) and its parts (weight 1), fused by reciprocal ranks."""
    asked = questions.select("qid", "text", F.lit(2.0).alias("weight"))
    if config.agent.decompose:
        parts = questions.select("qid", F.explode(agents.split_question(F.col("text"), config.agent.max_subqueries)).alias("part"), "text")
        asked = asked.unionByName(parts.where("lower(trim(part)) <> lower(trim(text))").select("qid", F.col("part").alias("text"), F.lit(1.0).alias("weight")))
    return fused(asked, units, config, children)


def _reranked(found: DataFrame, questions: DataFrame, units: DataFrame, config: Config, most: int | None = None) -> DataFrame:
    """qid, unit_id, score, rank, question, text of found (qid, unit_id, score, rank), by the reranker where there is one."""
    r = config.retrieval
    found = retrieval.held(found.select("qid", "unit_id", "score", "rank"))
    texts = found.join(units.select("unit_id", "text"), "unit_id").join(questions.select("qid", F.col("text").alias("question")), "qid")
    if r.reranker is None:
        return texts.where(F.col("rank") <= (most or r.top_k)).select("qid", "unit_id", "score", "rank", "question", "text")
    top = retrieval.rerank(texts, models.SCORERS[r.reranker], most or r.top_k, most or r.rerank_k)
    return top.select("qid", "unit_id", "score", "rank", "question", "text")


def _gathered(hits: DataFrame) -> DataFrame:
    """qid, question, texts: a question's hits as an array in rank order; there are top_k of them at most."""
    return hits.groupBy("qid", "question").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))


def corrected(hits: DataFrame, questions: DataFrame, units: DataFrame, config: Config, agents=models, children: DataFrame | None = None) -> DataFrame:
    """Questions whose best score is below crag_threshold are searched again, with a rewrite beside them; old hits are reranked with the new."""
    rerank_k = config.retrieval.rerank_k
    for _ in range(config.agent.crag_retries):
        weak = durable(retrieval.weak_questions(hits, config.agent.crag_threshold).select("qid"))
        mine = hits.join(weak, "qid", "left_semi")
        again = questions.join(weak, "qid", "left_semi")
        rewrites = _gathered(mine).select("qid", agents.rewritten(F.col("question"), F.col("texts")).alias("text"), F.lit(1.0).alias("weight"))
        asked = again.select("qid", "text", F.lit(2.0).alias("weight")).unionByName(rewrites)
        found = durable(fused(asked, units, config, children).where(F.col("rank") <= rerank_k))
        extra = retrieval.unseen(mine, found).select("qid", "unit_id", F.lit(0.0).alias("score"), F.lit(rerank_k).alias("rank"))
        better = _reranked(found.unionByName(extra), again, units, config)
        hits = durable(hits.join(weak, "qid", "left_anti").unionByName(better))
    return hits


def iterated(hits: DataFrame, questions: DataFrame, units: DataFrame, config: Config, agents=models, children: DataFrame | None = None) -> DataFrame:
    """Follow-up searches for what the passages lack; the best new hit of each hop is pinned behind the best of the rest.

    A follow-up is searched and reranked as a question of its own; its unseen hits join the old ones, and all are
    reranked against the original question. A question leaves the loop when nothing is missing, or when a follow-up
    repeats, but for case and outer blanks, or finds nothing new.
    """
    top = config.retrieval.top_k
    most = 2 * top + config.agent.max_hops
    hits = hits.withColumn("pinned", F.lit(0))
    said = None
    live = questions.select("qid")
    for hop in range(1, config.agent.max_hops + 1):
        wanted = _gathered(hits.join(live, "qid", "left_semi")).select("qid", agents.missing_tokens(F.col("question"), F.col("texts")).alias("text")).where("text is not null")
        wanted = wanted.withColumn("asked", F.lower(F.trim("text")))
        if said is not None:
            wanted = wanted.join(said, ["qid", "asked"], "left_anti")
        wanted = durable(wanted.select("qid", "text", "asked"))
        said = wanted.select("qid", "asked") if said is None else said.unionByName(wanted.select("qid", "asked"))
        asked = wanted.select("qid", "text", F.lit(2.0).alias("weight"))
        more = _reranked(fused(asked, units, config, children).where(F.col("rank") <= config.retrieval.rerank_k), wanted, units, config)
        new = durable(retrieval.pinned_best(retrieval.unseen(more, hits).select("qid", "unit_id", "rank"), hop))
        live = new.select("qid").distinct()
        old = hits.join(live, "qid", "left_semi").select("qid", "unit_id", "rank", "pinned")
        pool = durable(old.unionByName(new.withColumn("rank", F.col("rank") + top + config.agent.max_hops)))
        scored = _reranked(pool.select("qid", "unit_id", F.lit(0.0).alias("score"), F.row_number().over(retrieval.W.partitionBy("qid").orderBy("rank", "unit_id")).alias("rank")), questions, units, config, most)
        if config.retrieval.reranker is None:
            scored = scored.withColumn("score", -F.col("rank").cast("double"))  # as they came
        scored = scored.drop("rank").join(pool.select("qid", "unit_id", "pinned"), ["qid", "unit_id"])
        chosen = retrieval.follow_up(scored, top).join(scored.select("qid", "unit_id", "question", "text"), ["qid", "unit_id"])
        hits = durable(hits.join(live, "qid", "left_anti").unionByName(chosen.select(*hits.columns)))
    return hits.drop("pinned")


def retrieve(questions: DataFrame, units: DataFrame, config: Config, agents=models, children: DataFrame | None = None) -> DataFrame:
    """qid, unit_id, score, rank, question, text: the top_k after reranking against the whole question, corrected and iterated as set."""
    found = candidates(questions, units, config, agents, children).where(F.col("rank") <= config.retrieval.rerank_k)
    hits = _reranked(found, questions, units, config)
    crag = config.agent.crag and config.retrieval.reranker
    if crag or config.agent.retrieval_strategy == "iterative":
        hits = durable(hits)
    if crag:
        hits = corrected(hits, questions, units, config, agents, children)
    if config.agent.retrieval_strategy == "iterative":
        hits = iterated(hits, questions, units, config, agents, children)
    return hits


def _expanded(hits: DataFrame, units: DataFrame, config: Config) -> DataFrame:
    """Each hit as its window or section; hits within an earlier span go. units needs source, section, ord and page."""
    a = config.agent
    spans = answers.expand(units, a.context_chars, a.context_window if a.context == "window" else None, only=hits)
    where = units.select("unit_id", "source", "section", F.col("page").alias("at"))
    merged = answers.merge_spans(hits.join(where, "unit_id").join(spans, "unit_id"))
    return hits.drop("text", "rank").join(merged.select("qid", "unit_id", "rank", F.col("big").alias("text")), ["qid", "unit_id"])


def _claims(passages: DataFrame, generator, sources: DataFrame, config: Config) -> DataFrame:
    """qid, pos, text, citations, supported: the claims of a generator's answers, checked against the uncompressed sources."""
    said = passages.withColumn("said", generator(F.col("question"), F.col("passages"))).withColumn("claims", answers.parse_claims(F.col("said"), F.size("passages")))
    claims = said.select("qid", F.posexplode("claims").alias("pos", "c")).select(F.struct("qid", "pos").alias("cid"), "qid", "pos", "c.text", "c.citations")
    scorer = models.verifier_of(config.agent.verifier, config.retrieval.reranker)
    if scorer is None:
        return claims.withColumn("supported", F.lit(None).cast("boolean")).drop("cid")
    checked = answers.verify(claims.select("cid", "qid", "text", "citations"), sources.select("qid", "rank", "text"), scorer, config.agent.support_threshold)
    return claims.join(checked, "cid").select("qid", "pos", "text", "citations", "supported")


def _told(claims: DataFrame) -> DataFrame:
    """qid, kept (claims that are not known to be unsupported), n_claims, n_good."""
    kept: Column = F.filter(F.array_sort(F.collect_list(F.struct("pos", "text", "citations", "supported"))), lambda c: ~c["supported"].eqNullSafe(F.lit(False)))
    good = F.sum(F.coalesce(F.col("supported").cast("int"), F.lit(0)))
    return claims.groupBy("qid").agg(kept.alias("kept"), F.count("*").alias("n_claims"), good.alias("n_good"), F.coalesce(F.avg(F.col("supported").cast("int")), F.lit(1.0)).alias("support"))


def answer(questions: DataFrame, units: DataFrame, config: Config, agents=models, children: DataFrame | None = None) -> DataFrame:
    """qid, action, text, n_claims, n_supported, refused for each question.

    agents makes the calls that need a generator: the stand-ins, or `generation.Agents`. children (unit_id, text,
    parent_id) are searched in place of the units that answers are made of.
    """
    a = config.agent
    action = agents.route(F.col("text")) if a.route else F.lit("SEARCH")
    routed = questions.withColumn("action", action)
    searched = routed.where("action = 'SEARCH'").select("qid", "text")
    hits = retrieve(searched, units, config, agents, children)
    if a.min_relevance > 0 and config.retrieval.reranker:
        hits = hits.join(retrieval.weak_questions(hits, a.min_relevance).select("qid"), "qid", "left_anti")
    if a.context != "chunk":
        hits = _expanded(hits, units, config)
    hits = durable(hits)  # read by the generator, the verifier and the correction; bounded by top_k a question
    shown = hits
    if a.compression != "none":
        short = answers.compress(hits, retrieval.overlap_scorer, a.compress_sentences)
        shown = hits.drop("text").join(short, ["qid", "unit_id"])
    passages = shown.groupBy("qid", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("passages"))
    told = _told(_claims(passages, agents.extractive_answer, hits, config))
    if a.self_correct:
        told = durable(told)
        weak = told.where(F.col("support") < a.self_correct_below).select("qid", F.col("n_good").alias("before"))
        retry = _told(_claims(passages.join(weak, "qid", "left_semi"), agents.corrected_answer, hits, config))
        better = durable(retry.join(weak, "qid").where(F.col("n_good") > F.col("before")).drop("before"))
        told = told.join(better, "qid", "left_anti").unionByName(better)
    cited = F.transform("kept", lambda c: F.concat(c["text"], F.array_join(F.transform(c["citations"], lambda i: F.concat(F.lit(" ["), i.cast("string"), F.lit("]"))), "")))
    n_kept = F.greatest(F.coalesce(F.size("kept"), F.lit(0)), F.lit(0))
    direct = F.col("action") == "ANSWER_DIRECTLY"
    refused = ~direct & (n_kept == 0)
    text = F.when(direct, F.lit(models.DIRECT_ANSWER)).when(refused, F.lit(answers.REFUSAL_TEXT)).otherwise(F.array_join(cited, " "))
    return routed.select("qid", "action").join(told, "qid", "left").select(
        "qid", "action", text.alias("text"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), n_kept.alias("n_supported"), refused.alias("refused"),
    )


class Timings:
    """Seconds of named steps, summed; steps that only declare a plan cost what their action does."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def ablate(variants: dict[str, list[str]], questions: DataFrame, units: DataFrame, out: str | None = None, resume: bool = False, agents=models) -> DataFrame:
    """The answers of each variant (dotted overrides) over the same questions.

    out: a folder that takes each variant's answers as its own partition; resume leaves out those that are there.
    """
    from candela.config import load_config

    spark = questions.sparkSession
    parts = []
    for name, overrides in variants.items():
        if out and resume and _exists(spark, f"{out}/variant={name}/_SUCCESS"):
            continue
        part = answer(questions, units, load_config(overrides=overrides), agents)
        if out:
            part.write.mode("overwrite").parquet(f"{out}/variant={name}")
        else:
            parts.append(part.withColumn("variant", F.lit(name)))
    if out:
        return spark.read.parquet(out)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
