"""Context for answers, and claims: expansion, compression, parsing, verification, rendering and rewards.

Cases: null texts stay null and are joined to nothing. Claims whose passages are missing have a score of 0 and are not
supported. Ties go to the earlier sentence, passage or prompt. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions import text as T

REFUSAL_TEXT = "The documents do not contain the answer."


def context_window(chunks: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(unit_id, source, section, ord, text): each chunk with its neighbours in the section, the one before first, within max_chars."""
    w = W.partitionBy("source", "section").orderBy("ord")
    df = chunks.withColumn("before", F.lag("text").over(w)).withColumn("after", F.lead("text").over(w))
    size = F.length("text")
    left = F.coalesce(size + F.length("before") <= max_chars, F.lit(False))
    room = size + F.when(left, F.length("before")).otherwise(0)
    right = F.coalesce(room + F.length("after") <= max_chars, F.lit(False))
    return df.select("unit_id", F.concat_ws("\n", F.when(left, F.col("before")), "text", F.when(right, F.col("after"))).alias("text"), left.alias("took_before"), right.alias("took_after"))


def compress(passages: DataFrame, scorer, keep: int = 4) -> DataFrame:
    """(qid, unit_id, question, text): the best `keep` sentences in their order, gaps marked; shorter passages as they are."""
    sents = passages.select("qid", "unit_id", "question", "text", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    best = W.partitionBy("qid", "unit_id").orderBy(F.round(scorer(F.col("question"), F.col("sentence")), 9).desc(), "pos")
    kept = sents.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep)
    ordered = kept.withColumn("last", F.lag("pos").over(W.partitionBy("qid", "unit_id").orderBy("pos")))
    part = F.when(F.col("pos") != F.col("last") + 1, F.concat(F.lit("… "), "sentence")).otherwise(F.col("sentence"))
    short = ordered.groupBy("qid", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"]), " ").alias("short"))
    return passages.join(short, ["qid", "unit_id"], "left").select("qid", "unit_id", F.when(F.size(T.sentences(F.col("text"))) <= keep, F.col("text")).otherwise(F.col("short")).alias("text"))


def compression_ratio(passages: DataFrame, shown: DataFrame) -> DataFrame:
    """passages and shown: qid, unit_id, text before and after compression. qid, ratio of their characters."""
    sizes = passages.select("qid", "unit_id", F.length("text").alias("whole")).join(shown.select("qid", "unit_id", F.length("text").alias("kept")), ["qid", "unit_id"])
    return sizes.groupBy("qid").agg((F.sum("kept") / F.greatest(F.lit(1), F.sum("whole"))).alias("ratio"))


def context_excerpt(chunks: DataFrame, first: int = 4, chars: int = 3000) -> DataFrame:
    """(source, ord, text): the first chunks of each source, joined and cut."""
    top = chunks.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("ord"))).where(F.col("n") <= first)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    return top.groupBy("source").agg(F.substring(joined, 1, chars).alias("excerpt"))


COMPLETION = "claims array<struct<text:string,citations:array<string>>>"


def parse_claims(completion: Column, n_passages: Column) -> Column:
    """Merged claims of a JSON answer; null if it does not parse or a claim cites nothing or out of range."""
    parsed = F.from_json(T.json_object(completion), COMPLETION, {"mode": "PERMISSIVE"})["claims"]
    whole = lambda c: F.transform(c["citations"], lambda x: x.try_cast("double").try_cast("int"))
    valid = F.forall(parsed, lambda c: c["text"].isNotNull() & (F.size(c["citations"]) > 0) & F.forall(whole(c), lambda i: F.coalesce((i >= 1) & (i <= n_passages), F.lit(False))))
    cleaned = F.transform(parsed, lambda c: F.struct(F.trim(c["text"]).alias("text"), F.array_sort(F.array_distinct(whole(c))).alias("citations")))
    real = F.filter(cleaned, lambda c: (c["text"] != "") & ~T.is_refusal(c["text"]))
    return F.when(parsed.isNotNull() & valid, T.merged_claims(real))


def freetext_claims(text: Column, passages: Column) -> Column:
    """text: a free answer; passages: array of rank, source, page. Its sentences without tags, each citing the passages that its tags name; empty ones go."""
    cites = lambda s: F.array_sort(F.transform(F.filter(passages, lambda p: F.exists(T.citation_tags(s), lambda t: (t["source"] == p["source"]) & (t["page"] == p["page"]))), lambda p: p["rank"]))
    told = F.transform(F.split(F.trim(text), T.FREE_SENTENCE), lambda s: F.struct(T.without_tags(s).alias("text"), F.array_distinct(cites(s)).alias("citations")))
    return F.filter(told, lambda c: c["text"] != "")


def parse_queries(completion: Column) -> Column:
    queries = F.from_json(T.json_object(completion), "queries array<string>")["queries"]
    kept = F.filter(F.transform(queries, F.trim), lambda q: q != "")
    return F.when(F.size(kept) > 0, kept)


def verify(claims: DataFrame, passages: DataFrame, scorer, threshold: float = 0.05) -> DataFrame:
    """claims: cid, qid, text, citations; passages: qid, rank, text. cid, support_score, supported.

    A claim's score is the best over its cited passages and, if it cites several, over their concatenation.
    """
    cited = claims.select("cid", "qid", F.col("text").alias("claim"), F.explode_outer("citations").alias("rank")).join(passages, ["qid", "rank"], "left")
    one = cited.select("cid", "claim", "text")
    many = cited.where("text is not null").groupBy("cid", "claim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n")).where("n > 1").select("cid", "claim", "text")
    scored = one.unionByName(many).withColumn("s", F.when(F.col("text").isNotNull(), scorer(F.col("claim"), F.col("text"))))
    best = scored.groupBy("cid").agg(F.greatest(F.lit(0.0), F.max("s")).alias("support_score"))
    return best.select("cid", F.coalesce("support_score", F.lit(0.0)).alias("support_score"), (F.coalesce("support_score", F.lit(-1.0)) >= threshold).alias("supported"))


def answer_reward(rows: DataFrame) -> DataFrame:
    """rows: parsed (boolean), object (boolean), n_claims, supported, answerable, has_gold, cites_gold, has_reference, coverage. Adds reward."""
    support = F.col("supported") / F.col("n_claims")
    gold = F.when(F.col("answerable") & F.col("has_gold"), 0.5 * F.col("cites_gold").cast("double")).otherwise(0.0)
    cover = F.when(F.col("answerable") & F.col("has_reference"), 0.5 * F.col("coverage")).otherwise(0.0)
    total = support + gold + cover - F.when(F.col("answerable"), 0.0).otherwise(1.0) - 0.1 * F.greatest(F.lit(0), F.col("n_claims") - 6)
    reward = F.when(~F.col("parsed"), F.when(F.col("object"), -0.5).otherwise(-1.0)).when(F.col("n_claims") == 0, F.when(F.col("answerable"), -1.0).otherwise(1.0)).otherwise(total)
    return rows.withColumn("reward", reward)


def decompose_reward(rows: DataFrame, max_queries: int = 3) -> DataFrame:
    """rows: queries (null if unreadable), gold, pages (arrays). Adds reward."""
    recall = F.size(F.array_intersect("gold", "pages")) / F.size("gold")
    return rows.withColumn("reward", F.when(F.col("queries").isNull(), -1.0).otherwise(recall - 0.1 * F.greatest(F.lit(0), F.size("queries") - max_queries)))


def preference_pairs(samples: DataFrame, margin: float = 0.5) -> DataFrame:
    """(prompt, completion, reward): the best and the worst of each prompt's distinct samples, if the margin is met; ties by text."""
    scored = samples.dropDuplicates(["prompt", "completion"]).groupBy("prompt").agg(F.max(F.struct("reward", "completion")).alias("hi"), F.min(F.struct("reward", "completion")).alias("lo"), F.count("*").alias("n"))
    gap = F.col("hi.reward") - F.col("lo.reward")
    return scored.where((F.col("n") >= 2) & (gap >= margin)).select("prompt", F.col("hi.completion").alias("chosen"), F.col("lo.completion").alias("rejected"), gap.alias("margin"))


#: Slices of a hash order, counted before rows are ranked within them.
SLICES = 4096


def anti_refusal_pairs(answers: DataFrame, refusals: DataFrame, seed: int = 0) -> DataFrame:
    """answers: prompt, question, chosen; refusals: question. As many pairs that prefer the answer as there are refusals.

    Only answers whose completion parses to a claim count. Those that share a question with a refusal come first, for
    each question the last prompt's; the rest fill up in the order of their hashes, ranked within slices of it.
    """
    n = F.size(parse_claims(F.col("chosen"), F.lit(99)))
    usable = answers.where(n > 0).select("prompt", "question", "chosen")
    asked = refusals.select("question").distinct().withColumn("shared", F.lit(True))
    last = usable.groupBy("question").agg(F.max("prompt").alias("last"))
    marked = usable.join(last, "question").join(asked, "question", "left").withColumn("first", F.coalesce((F.col("prompt") == F.col("last")) & F.col("shared"), F.lit(False)))
    key = F.sha1(F.concat_ws("|", F.lit(seed), F.col("prompt").cast("string")))
    marked = marked.withColumn("key", key).withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    rest = marked.where("not first")
    within = rest.withColumn("within", F.row_number().over(W.partitionBy("slice").orderBy("key", "prompt")))
    sizes = rest.groupBy("slice").agg(F.count("*").alias("c"))
    before = sizes.select("slice", F.coalesce(F.sum("c").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    wanted = refusals.agg(F.count("*").alias("wanted"))
    picked = marked.where("first").agg(F.count("*").alias("picked"))
    room = F.broadcast(wanted.crossJoin(picked))  # one row
    fill = within.join(F.broadcast(before), "slice").crossJoin(room).where(F.col("before") + F.col("within") <= F.col("wanted") - F.col("picked"))
    out = marked.where("first").select("prompt", "chosen").unionByName(fill.select("prompt", "chosen"))
    return out.select("prompt", "chosen", F.lit(REFUSAL_TEXT).alias("rejected"), F.lit("anti_refusal").alias("kind"))


def render(answers: DataFrame) -> DataFrame:
    """answers: qid, claims (array of text, citations, supported), refs (array of rank, source, page, page_end, section). Adds rendered."""
    kept = F.filter("claims", lambda c: ~c["supported"].eqNullSafe(F.lit(False)))
    body = F.array_join(F.transform(kept, lambda c: F.concat(c["text"], F.array_join(F.transform(c["citations"], lambda i: F.concat(F.lit(" ["), i.cast("string"), F.lit("]"))), ""))), " ")
    used = F.array_distinct(F.flatten(F.transform(kept, lambda c: c["citations"])))
    shown = F.filter(F.array_sort("refs"), lambda r: F.array_contains(used, r["rank"]))
    line = lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["source"], F.lit(", p. "), r["page"].cast("string"), F.when(r["page_end"] > r["page"], F.concat(F.lit("–"), r["page_end"].cast("string"))).otherwise(""), F.when(F.coalesce(r["section"], F.lit("")) != "", F.concat(F.lit(" — "), r["section"])).otherwise(""))
    return answers.withColumn("rendered", F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.nullif(F.array_join(F.transform(shown, line), "\n"), F.lit(""))))


def expand(chunks: DataFrame, max_chars: int = 4000, steps: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """chunks: unit_id, source, section, ord, page, text. unit_id, big, page, page_end: each chunk grown over its neighbours.

    only: unit_id; those chunks alone, so texts of runs that hold none of them are never read into the frames.

    Growth takes the chunk before, then the one after, once a step, while they lie in the same run of the section and
    the texts stay within max_chars; steps limits it, None grows over the whole section. A chunk's frame holds no more
    than what the budget can reach.
    """
    by_source = W.partitionBy("source").orderBy("ord")
    df = chunks.withColumn("size", F.length("text")).withColumn("turns", F.coalesce((~F.col("section").eqNullSafe(F.lag("section").over(by_source))).cast("int"), F.lit(0)))
    df = df.withColumn("run", F.sum("turns").over(by_source))
    if only is not None:
        runs = df.select("unit_id", "source", "run").join(only.select("unit_id").distinct(), "unit_id", "left_semi").select("source", "run").distinct()
        df = df.join(runs, ["source", "run"], "left_semi")
    run = W.partitionBy("source", "run")
    df = df.withColumn("reach", F.sum("size").over(run.orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)))
    frame = run.orderBy("reach").rangeBetween(-max_chars, max_chars) if steps is None else run.orderBy("ord").rowsBetween(-steps, steps)
    near = F.collect_list(F.struct("ord", "size", "page", "text")).over(frame)
    df = df.withColumn("near", F.array_sort(near))
    if only is not None:
        df = df.join(only.select("unit_id").distinct(), "unit_id", "left_semi")
    df = df.withColumn("before", F.reverse(F.filter("near", lambda c: c["ord"] < F.col("ord")))).withColumn("after", F.filter("near", lambda c: c["ord"] > F.col("ord")))
    rounds = F.greatest(F.size("before"), F.size("after"))
    if steps is not None:
        rounds = F.least(rounds, F.lit(steps))

    def grow(state: Column, i: Column) -> Column:
        back = (state["back"] == i) & F.coalesce(state["used"] + F.get("before", i)["size"] <= max_chars, F.lit(False))
        used = state["used"] + F.when(back, F.get("before", i)["size"]).otherwise(0)
        on = (state["on"] == i) & F.coalesce(used + F.get("after", i)["size"] <= max_chars, F.lit(False))
        return F.struct((used + F.when(on, F.get("after", i)["size"]).otherwise(0)).alias("used"), (state["back"] + back.cast("int")).alias("back"), (state["on"] + on.cast("int")).alias("on"))

    start = F.struct(F.col("size").alias("used"), F.lit(0).alias("back"), F.lit(0).alias("on"))
    df = df.withColumn("grown", F.aggregate(F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1)).otherwise(F.array().cast("array<int>")), start, grow))
    taken = F.concat(F.reverse(F.slice("before", F.lit(1), F.col("grown.back"))), F.array(F.struct("ord", "size", "page", "text")), F.slice("after", F.lit(1), F.col("grown.on")))
    df = df.withColumn("taken", taken)
    pages = F.transform("taken", lambda c: c["page"])
    return df.select("unit_id", F.array_join(F.transform("taken", lambda c: c["text"]), "\n").alias("big"), F.array_min(pages).alias("page"), F.array_max(pages).alias("page_end"))


def merge_spans(hits: DataFrame) -> DataFrame:
    """hits: qid, unit_id, rank, source, section, at (the chunk's page), text, big, page, page_end. Those not covered by an earlier kept span, ranked anew.

    A span covers a chunk of its source and section whose page it holds and whose text it contains. A question has few
    hits, so they are folded as one array.
    """
    held = F.array_sort(F.collect_list(F.struct("rank", "unit_id", "source", "section", "at", "text", "big", "page", "page_end")))
    by = hits.groupBy("qid").agg(held.alias("hits"))
    covers = lambda s, h: s["source"].eqNullSafe(h["source"]) & s["section"].eqNullSafe(h["section"]) & (h["at"] >= s["page"]) & (h["at"] <= s["page_end"]) & F.contains(s["big"], h["text"])
    kept = F.aggregate("hits", F.slice("hits", 1, 0), lambda acc, h: F.when(F.exists(acc, lambda s: covers(s, h)), acc).otherwise(F.concat(acc, F.array(h))))
    return by.select("qid", F.posexplode(kept).alias("pos", "h")).select("qid", (F.col("pos") + 1).alias("rank"), "h.unit_id", "h.big", "h.page", "h.page_end")


def format_passages(passages: Column) -> Column:
    """passages: array of rank, source, page, section, text. The numbered passages of a prompt."""
    section = lambda p: F.when(F.coalesce(p["section"], F.lit("")) != "", F.concat(F.lit(", section: "), p["section"])).otherwise("")
    one = lambda p: F.concat(F.lit("["), p["rank"].cast("string"), F.lit("] ("), p["source"], F.lit(", page "), p["page"].cast("string"), section(p), F.lit(")\n"), p["text"])
    return F.array_join(F.transform(passages, one), "\n\n")


def feedback(claims: Column, most: int = 5) -> Column:
    """claims: array of text, supported. The first unsupported ones as bullets."""
    wrong = F.filter(claims, lambda c: c["supported"].eqNullSafe(F.lit(False)))
    return F.array_join(F.transform(F.slice(wrong, 1, most), lambda c: F.concat(F.lit("- "), c["text"])), "\n")


def coverage(rows: DataFrame, scorer, threshold: float = 0.05) -> DataFrame:
    """rows: id, reference, claims (array of texts). The share of the reference's sentences that all claims together support; 0 without any."""
    parts = rows.select("id", F.array_join("claims", " ").alias("told"), F.explode_outer(T.reference_sentences(F.col("reference"))).alias("sentence"))
    good = F.when(F.col("sentence").isNotNull(), (scorer(F.col("sentence"), F.col("told")) >= threshold).cast("double"))
    return parts.groupBy("id").agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("coverage"))


def counterfactual_hits(hits: DataFrame, gold: DataFrame, top: int) -> DataFrame:
    """hits: qid, page, rank; gold: qid, page. The first `top` hits off the gold pages, ranked anew."""
    left = hits.join(gold.select("qid", "page").distinct(), ["qid", "page"], "left_anti")
    ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank", "page")))
    return ranked.where(F.col("rank") <= top)


def asked_in(prompt: Column) -> Column:
    """What follows the last "Question:" of a prompt."""
    return F.trim(F.substring_index(prompt, "Question:", -1))
