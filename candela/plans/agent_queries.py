"""Registered queries of the answering loop, context expansion and generation of evaluation data, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela import models, pipeline
from candela.config import load_config
from candela.operators import answers, evaluate, retrieval
from candela.plans.registry import FUSED, GOLD, QTERMS, RERANK, UNITS, _fused, _gold, _reranked, _tok, query
from candela.sources import tables


def _chunks(spark, d):
    """Documents as chunks: a language is a section, the order is that of doc_id, the page is doc_id."""
    docs = tables.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("unit_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("section"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


WINDOW2 = """c AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS section, coalesce(text, '') AS text FROM documents),
    n AS (SELECT doc_id, text, section, length(text) AS s,
        CASE WHEN lag(section) OVER o = section THEN lag(text) OVER o END AS b1, CASE WHEN lag(section) OVER o = section AND lag(section, 2) OVER o = section THEN lag(text, 2) OVER o END AS b2,
        CASE WHEN lead(section) OVER o = section THEN lead(text) OVER o END AS a1, CASE WHEN lead(section) OVER o = section AND lead(section, 2) OVER o = section THEN lead(text, 2) OVER o END AS a2
        FROM c WINDOW o AS (PARTITION BY source ORDER BY doc_id)),
    w1 AS (SELECT *, coalesce(s + length(b1) <= 4000, false) AS tb1 FROM n), w2 AS (SELECT *, s + CASE WHEN tb1 THEN length(b1) ELSE 0 END AS u1 FROM w1),
    w3 AS (SELECT *, coalesce(u1 + length(a1) <= 4000, false) AS ta1 FROM w2), w4 AS (SELECT *, u1 + CASE WHEN ta1 THEN length(a1) ELSE 0 END AS u2 FROM w3),
    w5 AS (SELECT *, tb1 AND coalesce(u2 + length(b2) <= 4000, false) AS tb2 FROM w4), w6 AS (SELECT *, u2 + CASE WHEN tb2 THEN length(b2) ELSE 0 END AS u3 FROM w5),
    w7 AS (SELECT *, ta1 AND coalesce(u3 + length(a2) <= 4000, false) AS ta2 FROM w6)"""


@query(f"WITH {WINDOW2} SELECT doc_id AS unit_id, sha256(concat_ws(chr(10), CASE WHEN tb2 THEN b2 END, CASE WHEN tb1 THEN b1 END, text, CASE WHEN ta1 THEN a1 END, CASE WHEN ta2 THEN a2 END)) AS sha FROM w7")
def expand_window(spark, d):
    return answers.expand(_chunks(spark, d), 4000, 2).select("unit_id", F.sha2("big", 256).alias("sha"))


SPANS = """ck AS (SELECT doc_id AS unit_id, coalesce(source, '') AS source, coalesce(lang, '') AS section, coalesce(text, '') AS text, length(coalesce(text, '')) AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS p FROM documents),
    rn AS (SELECT *, sum(turn) OVER (PARTITION BY source ORDER BY p) AS run FROM (SELECT *, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY source ORDER BY p) THEN 1 ELSE 0 END AS turn FROM ck)),
    gw AS (SELECT unit_id, source, run, p AS lo, p AS hi, s AS used, true AS moved FROM rn
        UNION ALL
        SELECT unit_id, source, run, lo - tb::INT, hi + ta::INT, used + CASE WHEN tb THEN bs ELSE 0 END + CASE WHEN ta THEN au ELSE 0 END, tb OR ta
        FROM (SELECT g.*, b.s AS bs, a.s AS au, coalesce(g.used + b.s <= 4000, false) AS tb, coalesce(g.used + CASE WHEN coalesce(g.used + b.s <= 4000, false) THEN b.s ELSE 0 END + a.s <= 4000, false) AS ta
              FROM gw g LEFT JOIN rn b ON b.source = g.source AND b.run = g.run AND b.p = g.lo - 1 LEFT JOIN rn a ON a.source = g.source AND a.run = g.run AND a.p = g.hi + 1 WHERE g.moved)),
    gs AS (SELECT g.unit_id, string_agg(c.text, chr(10) ORDER BY c.p) AS big, min(c.unit_id) AS page, max(c.unit_id) AS page_end FROM (SELECT unit_id, source, lo, hi FROM gw WHERE NOT moved) g JOIN rn c ON c.source = g.source AND c.p BETWEEN g.lo AND g.hi GROUP BY g.unit_id)"""


@query(f"WITH RECURSIVE {SPANS} SELECT unit_id, page, page_end, sha256(big) AS sha FROM gs")
def expand_section(spark, d):
    return answers.expand(_chunks(spark, d), 4000).select("unit_id", "page", "page_end", F.sha2("big", 256).alias("sha"))


@query(f"""WITH RECURSIVE {RERANK}, {SPANS}, ht AS (SELECT qid, rank, re.unit_id, ck.source, ck.section, ck.text, gs.big, gs.page, gs.page_end FROM re JOIN ck USING (unit_id) JOIN gs USING (unit_id)),
    ms AS (SELECT qid, 0::BIGINT AS i, []::STRUCT(u BIGINT, s VARCHAR, c VARCHAR, b VARCHAR, p BIGINT, e BIGINT)[] AS kept FROM (SELECT DISTINCT qid FROM ht)
        UNION ALL
        SELECT m.qid, h.rank, CASE WHEN len(list_filter(m.kept, lambda k: k.s = h.source AND k.c = h.section AND h.unit_id >= k.p AND h.unit_id <= k.e AND contains(k.b, h.text))) > 0 THEN m.kept
               ELSE list_append(m.kept, struct_pack(u := h.unit_id, s := h.source, c := h.section, b := h.big, p := h.page, e := h.page_end)) END
        FROM ms m JOIN ht h ON h.qid = m.qid AND h.rank = m.i + 1)
    SELECT qid, generate_subscripts(kept, 1) AS rank, unnest(kept).u AS unit_id, unnest(kept).p AS page, unnest(kept).e AS page_end FROM (SELECT * FROM ms QUALIFY i = max(i) OVER (PARTITION BY qid))""")
def merged_spans(spark, d):
    hits = _reranked(spark, d).select("qid", "unit_id", "rank").join(_chunks(spark, d).withColumnRenamed("page", "at").drop("ord"), "unit_id")
    return answers.merge_spans(hits.join(answers.expand(_chunks(spark, d), 4000, only=hits.select("unit_id")), "unit_id")).select("qid", "rank", "unit_id", "page", "page_end")


@query(f"""WITH {FUSED}, {GOLD}, h AS (SELECT qid, unit_id AS page, rank FROM fu WHERE rank <= 20), x AS (SELECT * FROM h ANTI JOIN g USING (qid, page)),
    y AS (SELECT qid, page, row_number() OVER (PARTITION BY qid ORDER BY rank, page) AS n FROM x)
    SELECT qid, page, n AS rank FROM y WHERE n <= 5""")
def counterfactual_evidence(spark, d):
    hits = _fused(spark, d).where("rank <= 20").select("qid", F.col("unit_id").alias("page"), "rank")
    return answers.counterfactual_hits(hits, _gold(spark, d), 5).select("qid", "page", "rank")


@query(f"""WITH {RERANK}, {GOLD}, t AS (SELECT qid, round(max(score), 6) AS score FROM re GROUP BY qid), k AS (SELECT CASE WHEN qid IN (SELECT qid FROM g) THEN 'positive' ELSE 'negative' END AS kind, score FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score) AS i, count(*) OVER (PARTITION BY kind) AS n FROM k)
    SELECT kind, min(score) AS least, max(CASE WHEN i = n // 2 + 1 THEN score END) AS median, max(score) AS largest FROM r GROUP BY kind""")
def score_spread(spark, d):
    top = _reranked(spark, d).groupBy("qid").agg(F.round(F.max("score"), 6).alias("score"))
    gold = _gold(spark, d).select("qid").distinct().withColumn("kind", F.lit("positive"))
    return evaluate.score_spread(top.join(gold, "qid", "left").withColumn("kind", F.coalesce("kind", F.lit("negative"))), "kind")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def counts_by_kind(spark, d):
    return tables.table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


JUDGED = """j AS (SELECT conv_id, conv_id % 7 AS variant, conv_id % 2 = 0 AS answerable, conv_id % 3 = 0 AS insufficient, CASE WHEN conv_id % 5 = 0 THEN 'ANSWER_DIRECTLY' ELSE 'SEARCH' END AS action,
    CASE conv_id % 4 WHEN 0 THEN ' Correct' WHEN 1 THEN 'partially_correct' WHEN 2 THEN 'INCORRECT ' ELSE 'unclear' END AS verdict FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _judged(spark, d):
    c = F.col("conv_id")
    verdict = F.when(c % 4 == 0, " Correct").when(c % 4 == 1, "partially_correct").when(c % 4 == 2, "INCORRECT ").otherwise("unclear")
    return tables.table(spark, d, "conversations").select("conv_id").distinct().select(
        "conv_id", (c % 7).alias("variant"), (c % 2 == 0).alias("answerable"), (c % 3 == 0).alias("insufficient"), F.when(c % 5 == 0, "ANSWER_DIRECTLY").otherwise("SEARCH").alias("action"), verdict.alias("verdict"),
    )


@query(f"""WITH {JUDGED} SELECT variant, round(avg(CASE WHEN answerable THEN insufficient::INT END), 6) AS false_refusal,
    round(avg(CASE WHEN NOT answerable THEN (insufficient OR action = 'ANSWER_DIRECTLY')::INT END), 6) AS unanswerable_refusal FROM j GROUP BY variant""")
def refusal_rates(spark, d):
    return evaluate.refusal_rates(_judged(spark, d), "variant").select("variant", *[F.round(c, 6).alias(c) for c in ("false_refusal", "unanswerable_refusal")])


@query(f"WITH {JUDGED} SELECT variant, count(*) AS n, round(avg(CASE lower(trim(verdict)) WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 WHEN 'incorrect' THEN 0.0 END), 6) AS correctness FROM j GROUP BY variant")
def judge_scores(spark, d):
    return _judged(spark, d).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg(evaluate.verdict_score(F.col("verdict"))), 6).alias("correctness"))


@query(f"""WITH a AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn) AS told FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    r AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn) AS ref FROM conversations WHERE role = 'user' GROUP BY conv_id),
    s AS (SELECT id, told, unnest(list_filter(string_split(regexp_replace(trim(ref), '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '\\S+')) >= 4)) AS x FROM a JOIN r USING (id)),
    m AS (SELECT id, avg(CASE WHEN len(list_intersect(list_distinct({_tok('x')}), list_distinct({_tok('told')}))) / greatest(len(list_distinct({_tok('x')})), 1) >= 0.05 THEN 1.0 ELSE 0.0 END) AS c FROM s GROUP BY id)
    SELECT id, round(coalesce(c, 0.0), 6) AS coverage FROM a JOIN r USING (id) LEFT JOIN m USING (id)""")
def reference_coverage(spark, d):
    turns = tables.table(spark, d, "conversations")
    said = lambda role: turns.where(F.col("role") == role).groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias(role))
    rows = said("assistant").join(said("user"), "id").select("id", F.array_join("user", " ").alias("reference"), F.col("assistant").alias("claims"))
    return answers.coverage(rows, retrieval.containment_scorer).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {RERANK}, pp AS (SELECT qid, rank, '[' || rank || '] (' || d.source || ', page ' || d.doc_id || CASE WHEN coalesce(d.lang, '') <> '' THEN ', section: ' || d.lang ELSE '' END || ')' || chr(10) || coalesce(d.text, '') AS x FROM re JOIN documents d ON d.doc_id = re.unit_id)
    SELECT qid, sha256(string_agg(x, chr(10) || chr(10) ORDER BY rank)) AS sha FROM pp GROUP BY qid""")
def prompt_passages(spark, d):
    hits = _reranked(spark, d).select("qid", "unit_id", "rank").join(_chunks(spark, d), "unit_id")
    by = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "page", "section", "text"))).alias("passages"))
    return by.select("qid", F.sha2(answers.format_passages(F.col("passages")), 256).alias("sha"))


@query(f"""WITH c AS (SELECT conv_id AS qid, turn, text, turn % 3 = 0 AS ok FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn) AS i FROM c WHERE NOT ok)
    SELECT qid, sha256(string_agg('- ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS sha FROM n WHERE i <= 5 GROUP BY qid""")
def claim_feedback(spark, d):
    claims = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 3 == 0).alias("supported")).alias("c"))
    by = claims.groupBy("qid").agg(F.array_sort(F.collect_list("c")).alias("claims"))
    return by.select("qid", answers.feedback(F.col("claims")).alias("told")).where("told <> ''").select("qid", F.sha2("told", 256).alias("sha"))


@query("SELECT conv_id, turn, sha256(trim(list_last(string_split(coalesce(text, ''), 'Question:')), ' ')) AS sha FROM conversations")
def question_of_prompt(spark, d):
    """Every turn as the question of a prompt whose passages hold the word themselves."""
    prompt = F.concat(F.lit("Passages: Question: of another kind.\n\nQuestion: "), F.coalesce("text", F.lit("")))
    return tables.table(spark, d, "conversations").select("conv_id", "turn", F.sha2(answers.asked_in(prompt), 256).alias("sha"))


@query("""SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 AND CASE WHEN conv_id % 3 = 0 THEN turn % 4 = 0 AND length(text) >= 20 ELSE length(text) >= 15 END""")
def usable_questions(spark, d):
    rows = tables.table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("usable"), F.when(F.col("conv_id") % 3 == 0, F.col("turn") % 4 == 0).alias("needs_both"), F.col("text").alias("question"))
    return evaluate.usable_questions(rows).select("conv_id", "turn")


@query(f"""WITH {UNITS}, {QTERMS}, t AS (SELECT unit_id, unnest(toks) AS term FROM u), w AS (SELECT unit_id, term, ln(1 + count(*)) AS w FROM t GROUP BY ALL)
    SELECT unit_id, term, round(w, 9) AS w FROM w""")
def sparse_weights(spark, d):
    return retrieval.term_weights(tables.units(spark, d)).withColumn("w", F.round("w", 9))


@query()
def dense_text_topk(spark, d):
    """Embedded questions against embedded documents; tested against brute force."""
    asked = tables.questions(spark, d).select("qid", models.embed("text").alias("vec"))
    vectors = tables.units(spark, d).select("unit_id", models.embed("text").alias("vec"))
    return retrieval.dense(asked, vectors, 20, same_ids=False).select("qid", "unit_id", F.round("score", 6).alias("score"), "rank")


@query()
def corrective_retrieval(spark, d):
    config = load_config(overrides=["agent.crag=true", "retrieval.mode=sparse"])
    return pipeline.retrieve(tables.questions(spark, d), tables.units(spark, d), config).select("qid", "unit_id", "rank")


@query()
def iterative_retrieval(spark, d):
    config = load_config(overrides=["agent.retrieval_strategy=iterative", "retrieval.mode=sparse"])
    return pipeline.retrieve(tables.questions(spark, d), tables.units(spark, d), config).select("qid", "unit_id", "rank")


@query()
def self_corrected_answers(spark, d):
    config = load_config(overrides=["agent.self_correct=true", "agent.self_correct_below=0.9", "agent.route=true", "agent.context=window", "agent.support_threshold=0.6"])
    return pipeline.answer(tables.questions(spark, d), _chunks(spark, d), config)
