"""Registered queries over the test tables, and the same results in DuckDB's SQL.

Questions are the rows of `benchmark`, units are the rows of `documents`; a document is its own page, in its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions import text as T
from candela.operators import answers, chunking, evaluate, layout, retrieval
from candela.session import shared_dir
from candela.sources import index, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STORED: dict[tuple[str, str], index.Index] = {}


def stored(spark, d) -> index.Index:
    """The index of the documents, built once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED or not _STORED[key].whole():
        _STORED[key] = index.build(tables.units(spark, d), f"{shared_dir(spark)}/index-{abs(hash(d))}")
    return _STORED[key]


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tok(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '\d+(?:\.\d+)+|[a-z0-9]+'), lambda t: t NOT IN ({_STOP}))"


def _sent(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?;])\s+([A-Z(\"''§0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')".replace('\\"', '"')


UNITS = f"u AS (SELECT doc_id AS unit_id, source, coalesce(text, '') AS text, {_tok('coalesce(text, chr(32))')} AS toks FROM documents)"
POSTS = "p AS (SELECT unit_id, term, len AS dl, count(*) AS tf FROM (SELECT unit_id, len(toks) AS len, unnest(toks) AS term FROM u) GROUP BY ALL)"
QTERMS = f"q AS (SELECT item_id AS qid, text AS question, {_tok('text')} AS toks FROM benchmark), qt AS (SELECT qid, unnest(list_distinct(toks)) AS term FROM q)"
BM25 = f"""{UNITS}, {POSTS}, {QTERMS},
    st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM u),
    w AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n),
    b0 AS (SELECT qid, unit_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN p USING (term) JOIN w USING (term), st GROUP BY ALL),
    bm AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id) AS rank FROM b0 QUALIFY rank <= 20)"""
SPARSE = """s0 AS (SELECT qid, unit_id, sum(ln(1 + tf)) AS score FROM qt JOIN p USING (term) GROUP BY ALL),
    sp AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id) AS rank FROM s0 QUALIFY rank <= 20)"""
FUSED = f"""{BM25}, {SPARSE},
    f0 AS (SELECT qid, unit_id, sum(weight / (60 + rank)) AS score FROM (SELECT qid, unit_id, rank, 2.0 AS weight FROM bm UNION ALL SELECT qid, unit_id, rank, 1.0 FROM sp) GROUP BY ALL),
    fu AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, unit_id) AS rank FROM f0)"""
GOLD = "g AS (SELECT b.item_id AS qid, d.doc_id AS page FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RERANK = f"""{FUSED},
    r0 AS (SELECT qid, unit_id, len(list_intersect(list_distinct(q.toks), list_distinct(u.toks))) / greatest(len(list_distinct(list_concat(q.toks, u.toks))), 1) AS score
           FROM fu JOIN q USING (qid) JOIN u USING (unit_id) WHERE rank <= 20),
    re AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id) AS rank FROM r0 QUALIFY rank <= 5)"""


# Scalars and indexes

@query(f"WITH {UNITS}, {POSTS} SELECT unit_id, term, dl, tf FROM p")
def tokenize_terms(spark, d):
    return retrieval.postings(tables.units(spark, d))


@query(f"WITH {UNITS}, {POSTS}, st AS (SELECT count(*) AS n FROM u) SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, st GROUP BY term, n")
def term_stats(spark, d):
    units = tables.units(spark, d)
    return retrieval.term_stats(retrieval.postings(units), retrieval.corpus_stats(units)).withColumn("idf", F.round("idf", 6))


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_sent('text')} AS s FROM documents)")
def sentence_split(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT doc_id, substr(sha1(source || '|' || doc_id || '|' || text), 1, 16) AS id FROM documents")
def chunk_ids(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("id"))


@query("""SELECT doc_id, CASE WHEN b < 500 THEN 'train' WHEN b < 650 THEN 'dev' ELSE 'test' END AS split FROM (
    SELECT doc_id, list_reduce(list_transform(range(5), lambda i: ('0x' || substr(sha1(source || '|' || doc_id), i * 8 + 1, 8))::BIGINT), lambda a, x: (a * 4294967296 + x) % 1000, 0) AS b FROM documents)""")
def assign_split(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", T.assign_split(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("split"))


@query("SELECT doc_id, length(text) >= 400 AND length(text) - length(replace(text, '|', '')) < 10 AS substantive FROM documents")
def substantive_filter(spark, d):
    text = F.col("text")
    return tables.table(spark, d, "documents").select("doc_id", ((F.length(text) >= 400) & (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) < 10)).alias("substantive"))


@query("""SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(not|no)\\b.{0,40}\\b(mention|mentioned|detailed|provided|contain|contained|found|covered|specified)\\b') AS refusal,
    regexp_matches(text, '(?i)^\\W*(nothing|none|n/?a|no(thing)? (is )?missing)\\b') AS nothing FROM conversations""")
def refusal_filter(spark, d):
    return tables.table(spark, d, "conversations").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"), T.says_nothing_missing(F.col("text")).alias("nothing"))


# Retrieval

@query(f"WITH {BM25} SELECT qid, unit_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, d):
    return stored(spark, d).bm25(tables.questions(spark, d)).withColumn("score", F.round("score", 6))


def _sparse(spark, d):
    return stored(spark, d).sparse_dot(retrieval.query_terms(tables.questions(spark, d)).withColumn("w", F.lit(1.0)))


@query(f"WITH {UNITS}, {POSTS}, {QTERMS}, {SPARSE} SELECT qid, unit_id, round(score, 6) AS score, rank FROM sp")
def sparse_dot_topk(spark, d):
    return _sparse(spark, d).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS unit_id, list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT qid, unit_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id) AS rank FROM s QUALIFY rank <= 20""")
def dense_topk(spark, d):
    v = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vec"))
    return retrieval.dense(v.where("unit_id % 100 = 0").withColumnRenamed("unit_id", "qid"), v).withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT vec_id // 8 AS g, vec_id % 8 AS tok, embedding FROM embeddings),
    m AS (SELECT q.g AS qid, v.g AS unit_id, q.tok, max(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))) AS m FROM t q JOIN t v ON q.g <> v.g WHERE q.g % 100 = 0 GROUP BY ALL),
    s AS (SELECT qid, unit_id, sum(m) AS score FROM m GROUP BY ALL)
    SELECT qid, unit_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id) AS rank FROM s QUALIFY rank <= 20""")
def maxsim_topk(spark, d):
    v = tables.table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("unit_id"), (F.col("vec_id") % 8).alias("tok"), F.col("embedding").alias("vec"))
    return retrieval.maxsim(v.where("unit_id % 100 = 0").withColumnRenamed("unit_id", "qid"), v.drop("tok")).withColumn("score", F.round("score", 6))


def _fused(spark, d):
    bm = stored(spark, d).bm25(tables.questions(spark, d)).withColumn("weight", F.lit(2.0))
    return retrieval.held(retrieval.reciprocal_ranks(bm.unionByName(_sparse(spark, d).withColumn("weight", F.lit(1.0)))))


@query(f"WITH {FUSED} SELECT qid, unit_id, round(score, 9) AS score, rank FROM fu")
def rrf_fusion(spark, d):
    return _fused(spark, d).withColumn("score", F.round("score", 9))


@query(f"""WITH {FUSED}, c AS (SELECT qid, source AS unit_id, min(struct_pack(r := rank, s := score)) AS best FROM fu JOIN u USING (unit_id) GROUP BY ALL)
    SELECT qid, unit_id, round(best.s, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY best.r, unit_id) AS rank FROM c""")
def parent_child_fusion(spark, d):
    parents = tables.units(spark, d).select("unit_id", F.col("source").alias("parent_id"))
    return retrieval.to_parents(_fused(spark, d), parents).withColumn("score", F.round("score", 9))


@query(f"WITH {FUSED} SELECT qid, unit_id, rank, u.source, length(u.text) AS n_chars FROM fu JOIN u USING (unit_id) WHERE rank <= 20")
def hybrid_candidates(spark, d):
    return _fused(spark, d).where("rank <= 20").join(tables.units(spark, d), "unit_id").select("qid", "unit_id", "rank", "source", F.length("text").alias("n_chars"))


def _reranked(spark, d):
    asked = tables.questions(spark, d).select("qid", T.tokens(F.col("text")).alias("question"))
    cands = _fused(spark, d).where("rank <= 20").join(stored(spark, d).table("tokens").select("unit_id", F.col("toks").alias("text")), "unit_id").join(asked, "qid")
    return retrieval.held(retrieval.rerank(cands, retrieval.token_scorer).select("qid", "unit_id", "score", "rank"))


@query(f"WITH {RERANK} SELECT qid, unit_id, round(score, 6) AS score, rank FROM re")
def rerank_topk(spark, d):
    return _reranked(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {RERANK} SELECT qid, round(max(score), 6) AS top FROM re GROUP BY qid HAVING max(score) < 0.5")
def relevance_gate(spark, d):
    return retrieval.weak_questions(_reranked(spark, d), 0.5).withColumn("top", F.round("top", 6))


@query(f"""WITH {RERANK}, x AS (SELECT qid, unit_id, rank FROM sp ANTI JOIN re USING (qid, unit_id)),
    n AS (SELECT qid, unit_id, CASE WHEN row_number() OVER (PARTITION BY qid ORDER BY rank, unit_id) = 1 THEN 1 ELSE 0 END AS pinned FROM x),
    o AS (SELECT qid, unit_id, 0 AS pinned FROM re UNION ALL SELECT qid, unit_id, pinned FROM n),
    z AS (SELECT o.*, len(list_intersect(list_distinct(q.toks), list_distinct(u.toks))) / greatest(len(list_distinct(list_concat(q.toks, u.toks))), 1) AS score FROM o JOIN q USING (qid) JOIN u USING (unit_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid, pinned ORDER BY round(score, 9) DESC, unit_id) AS r, sum(pinned) OVER (PARTITION BY qid) AS pins FROM z)
    SELECT qid, unit_id, pinned, row_number() OVER (PARTITION BY qid ORDER BY pinned, r) AS rank FROM k WHERE pinned > 0 OR r <= 5 - pins""")
def iterative_hop(spark, d):
    first = _reranked(spark, d)
    new = retrieval.pinned_best(retrieval.unseen(_sparse(spark, d), first).select("qid", "unit_id", "rank"), 1)
    pool = retrieval.held(first.select("qid", "unit_id", F.lit(0).alias("pinned")).unionByName(new.select("qid", "unit_id", "pinned")))
    texts = pool.join(tables.units(spark, d).select("unit_id", "text"), "unit_id").join(tables.questions(spark, d).withColumnRenamed("text", "question"), "qid")
    scored = texts.select("qid", "unit_id", "pinned", retrieval.overlap_scorer(F.col("question"), F.col("text")).alias("score"))
    return retrieval.follow_up(scored, 5).select("qid", "unit_id", "pinned", "rank")


# Layout and chunks

def _lines(spark, d):
    lines = tables.table(spark, d, "documents").select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("y", "text"))
    return lines.where("trim(text) <> ''")


LINES = "l AS (SELECT source, page, y, text FROM (SELECT source, doc_id AS page, generate_subscripts(s, 1) - 1 AS y, unnest(s) AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(text, ' ') <> '')"


@query(rf"""WITH {LINES}, e AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY y) AS a, row_number() OVER (PARTITION BY source, page ORDER BY y DESC) AS z FROM l),
    n AS (SELECT source, norm, count(*) AS n FROM (SELECT DISTINCT source, page, regexp_replace(text, '\d+', '#', 'g') AS norm FROM e WHERE a <= 2 OR z <= 2) GROUP BY ALL),
    p AS (SELECT source, count(DISTINCT page) AS pages FROM l GROUP BY source)
    SELECT source, norm, n, pages FROM n JOIN p USING (source) WHERE pages >= 3 AND n >= 2 AND n / pages >= 0.02""")
def running_text(spark, d):
    return layout.running_text(_lines(spark, d), min_share=0.02)


def _styled(spark, d):
    """Lines with a size by their length and a bold mark, so that headings of several levels occur."""
    n = F.length("text")
    size = F.when(n < 12, 16.0).when(n < 20, 14.0).otherwise(11.0)
    return _lines(spark, d).select("source", (F.col("page") * 100000 + F.col("y")).alias("ord"), "text", size.alias("size"), (n % 7 == 0).alias("bold"), F.lit(11.0).alias("body"))


LEVELS = rf"""{LINES}, st AS (SELECT source, page * 100000 + y AS ord, text, CASE WHEN length(text) < 12 THEN 16.0 WHEN length(text) < 20 THEN 14.0 ELSE 11.0 END AS size, length(text) % 7 = 0 AS bold FROM l),
    hd AS (SELECT *, length(text) <= 150 AND NOT (regexp_matches(text, '[.,;:]$') AND NOT regexp_matches(text, '^(\(?[0-9ivxIVX]+[.)]|[A-Z][.)]|§|Sec\.|Subpart|Part|Section|Chapter|Appendix)\s*\S')) AND (size >= 12 OR bold AND length(text) < 120) AS h FROM st),
    sz AS (SELECT source, size, dense_rank() OVER (PARTITION BY source ORDER BY size DESC) AS rk FROM (SELECT DISTINCT source, size FROM hd WHERE h AND size >= 12)),
    lv AS (SELECT hd.source, ord, text, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS kind,
                  CASE WHEN NOT h THEN 0 WHEN hd.size >= 12 THEN rk ELSE coalesce((SELECT max(rk) FROM sz z WHERE z.source = hd.source), 0) + 1 END AS level
           FROM hd LEFT JOIN sz ON sz.source = hd.source AND sz.size = hd.size AND h)"""


@query(f"WITH {LEVELS} SELECT source, ord, kind, CAST(level AS INT) AS level FROM lv")
def heading_levels(spark, d):
    return layout.heading_levels(_styled(spark, d)).select("source", "ord", "kind", "level")


@query(f"""WITH {LEVELS}, x AS (SELECT *, {", ".join(f"max(CASE WHEN level = {k} THEN ord END) OVER w AS o{k}, max(CASE WHEN level = {k} THEN struct_pack(o := ord, t := text) END) OVER w AS t{k}" for k in (1, 2, 3))}
    FROM lv WINDOW w AS (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT source, ord, concat_ws(' > ', t1.t, CASE WHEN o2 > coalesce(o1, -1) THEN t2.t END, CASE WHEN o3 > greatest(coalesce(o1, -1), coalesce(o2, -1)) THEN t3.t END) AS section FROM x""")
def heading_paths(spark, d):
    return layout.section_paths(layout.heading_levels(_styled(spark, d)), 3).select("source", "ord", "section")


def pieces_sql(source: str, size: int, overlap: int) -> str:
    """CTEs over a table `source` of key, text: pc holds key, piece_no (from 0), piece. Sentences are laid out as units and folded one by one."""
    stride = size - overlap
    return f"""
    pt AS (SELECT key, text FROM {source}),
    ps AS (SELECT key, generate_subscripts(s, 1) AS si, unnest(s) AS s FROM (SELECT key, list_filter({_sent('text')}, lambda x: regexp_matches(x, '\\S')) AS s FROM pt WHERE length(text) > {size})),
    pm AS (SELECT *, CASE WHEN length(s) > {size} THEN (length(s) - {size} + {stride - 1}) // {stride} ELSE 0 END AS m FROM ps),
    pk AS (SELECT key, si, m, s, unnest(generate_series(0, m)) AS k FROM pm),
    pu AS (SELECT key, substr(s, k * {stride} + 1, CASE WHEN k < m THEN {size} ELSE length(s) END) AS t, k < m AS alone, row_number() OVER (PARTITION BY key ORDER BY si, k) AS i, count(*) OVER (PARTITION BY key) AS n FROM pk),
    pr AS (SELECT key, 0::BIGINT AS i, 1::BIGINT AS n, []::VARCHAR[] AS open, []::VARCHAR[] AS told FROM (SELECT DISTINCT key FROM pu)
        UNION ALL
        SELECT key, i, n, CASE WHEN alone THEN [] WHEN shut THEN list_append(kept, t) ELSE list_append(open, t) END,
               list_concat(CASE WHEN shut THEN [array_to_string(open, ' ')] ELSE [] END, list_concat(CASE WHEN alone THEN [t] ELSE [] END, CASE WHEN i = n AND NOT alone THEN [array_to_string(CASE WHEN shut THEN list_append(kept, t) ELSE list_append(open, t) END, ' ')] ELSE [] END))
        FROM (SELECT u.key, u.i, u.n, u.t, u.alone, r.open, len(r.open) > 0 AND (u.alone OR length(array_to_string(r.open, ' ')) + 1 + length(u.t) > {size}) AS shut,
                     coalesce(list_last(list_filter(list_transform(generate_series(1, len(r.open)), lambda k: r.open[len(r.open) - k + 1:]), lambda x: length(array_to_string(x, ' ')) <= {overlap})), []) AS kept
              FROM pr r JOIN pu u ON u.key = r.key AND u.i = r.i + 1)),
    pe AS (SELECT key, i, unnest(told) AS piece, generate_subscripts(told, 1) AS j FROM pr WHERE len(told) > 0),
    pc AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY i, j) - 1 AS piece_no, piece FROM pe UNION ALL SELECT key, 0, text FROM pt WHERE length(text) <= {size})"""


@query(f"WITH RECURSIVE src AS (SELECT doc_id AS key, coalesce(text, '') AS text FROM documents), {pieces_sql('src', 1200, 200)} SELECT key AS unit_id, piece_no, piece FROM pc")
def split_text_pieces(spark, d):
    return chunking.text_pieces(tables.units(spark, d))


SECTIONS = ORACLES["heading_paths"].split("SELECT source, ord, concat_ws")[0]


@query(f"""{SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1)}, sx AS (SELECT source, ord, kind, text, ord // 100000 AS page, concat_ws(' > ', t1.t, CASE WHEN o2 > coalesce(o1, -1) THEN t2.t END, CASE WHEN o3 > greatest(coalesce(o1, -1), coalesce(o2, -1)) THEN t3.t END) AS section FROM x),
    bl AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY ord) AS i FROM sx),
    gr AS (SELECT source, page, 0::BIGINT AS i, 0::BIGINT AS gid, -1::BIGINT AS width, '' AS section FROM (SELECT DISTINCT source, page FROM bl)
        UNION ALL
        SELECT b.source, b.page, b.i, CASE WHEN b.kind = 'heading' OR g.width < 0 OR b.section <> g.section OR g.width + length(b.text) > 1200 THEN g.gid + 1 ELSE g.gid END,
               CASE WHEN b.kind = 'heading' THEN -1 WHEN g.width < 0 OR b.section <> g.section OR g.width + length(b.text) > 1200 THEN length(b.text) ELSE g.width + 1 + length(b.text) END, b.section
        FROM gr g JOIN bl b ON b.source = g.source AND b.page = g.page AND b.i = g.i + 1),
    src AS (SELECT {{'s': b.source, 'p': b.page, 'g': gid}} AS key, min(ord) AS ord, any_value(b.section) AS section, string_agg(text, chr(10) ORDER BY ord) AS text FROM gr JOIN bl b ON b.source = gr.source AND b.page = gr.page AND b.i = gr.i WHERE kind <> 'heading' GROUP BY 1),
    {pieces_sql('src', 1200, 200)},
    ch AS (SELECT DISTINCT substr(sha1(pc.key.s || '|' || pc.key.p || '|' || piece), 1, 16) AS id, ord, pc.key.s AS source, pc.key.p AS page, section, length(piece) AS n_chars, sha256(piece) AS sha FROM pc JOIN src ON src.key = pc.key)
    SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""")
def section_chunks(spark, d):
    paths = layout.section_paths(layout.heading_levels(_styled(spark, d)), 3)
    return chunking.chunk_blocks(paths.withColumn("page", F.expr("cast(ord div 100000 as int)"))).select("id", "ord", "source", "page", "section", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query(f"""WITH RECURSIVE src AS (SELECT {{'s': source, 'p': doc_id, 'id': substr(sha1(source || '|' || doc_id || '|' || text), 1, 16)}} AS key, text FROM documents), {pieces_sql('src', 300, 50)}
    SELECT DISTINCT substr(sha1(key.s || '|' || key.p || '|child|' || key.id || piece), 1, 16) AS id, key.id AS parent_id, length(piece) AS n_chars, sha256(piece) AS sha FROM pc""")
def child_chunks(spark, d):
    chunks = tables.table(spark, d, "documents").select(T.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("id"), "text", "source", F.col("doc_id").cast("int").alias("page"), F.lit("").alias("section"))
    return chunking.make_children(chunks).select("id", "parent_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query("""WITH w AS (SELECT doc_id AS unit_id, text, lag(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS b, lead(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS a FROM documents),
    x AS (SELECT *, coalesce(length(text) + length(b) <= 4000, false) AS l FROM w), y AS (SELECT *, coalesce(length(text) + CASE WHEN l THEN length(b) ELSE 0 END + length(a) <= 4000, false) AS r FROM x)
    SELECT unit_id, sha256(concat_ws(chr(10), CASE WHEN l THEN b END, text, CASE WHEN r THEN a END)) AS sha, l AS took_before, r AS took_after FROM y""")
def context_window(spark, d):
    chunks = tables.units(spark, d).join(tables.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("section")), "unit_id").withColumn("ord", F.col("unit_id"))
    return answers.context_window(chunks).select("unit_id", F.sha2("text", 256).alias("sha"), "took_before", "took_after")


@query("""WITH t AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    SELECT source, sha256(substr(string_agg(text, chr(10) ORDER BY n), 1, 3000)) AS sha FROM t WHERE n <= 4 GROUP BY source""")
def context_excerpt(spark, d):
    return answers.context_excerpt(tables.units(spark, d).withColumn("ord", F.col("unit_id"))).select("source", F.sha2("excerpt", 256).alias("sha"))


# Claims

@query(f"""WITH {RERANK}, s AS (SELECT qid, unit_id, question, text, q.toks AS qt, {_sent('text')} AS s FROM re JOIN q USING (qid) JOIN u USING (unit_id)),
    e AS (SELECT qid, unit_id, qt, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM s),
    z AS (SELECT *, list_distinct(qt) AS a, list_distinct({_tok('sentence')}) AS b FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid, unit_id ORDER BY round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 9) DESC, pos) AS r FROM z QUALIFY r <= 4),
    o AS (SELECT *, lag(pos) OVER (PARTITION BY qid, unit_id ORDER BY pos) AS l FROM k),
    c AS (SELECT qid, unit_id, string_agg(CASE WHEN pos <> l + 1 THEN '… ' ELSE '' END || sentence, ' ' ORDER BY pos) AS short FROM o GROUP BY ALL)
    SELECT qid, unit_id, sha256(CASE WHEN len(s) <= 4 THEN text ELSE short END) AS sha FROM s LEFT JOIN c USING (qid, unit_id)""")
def compress_sentences(spark, d):
    hits = _reranked(spark, d).join(tables.units(spark, d).select("unit_id", "text"), "unit_id").join(tables.questions(spark, d).withColumnRenamed("text", "question"), "qid")
    return answers.compress(hits, retrieval.overlap_scorer).select("qid", "unit_id", F.sha2("text", 256).alias("sha"))


def _claims(spark, d):
    """Sentences of assistant turns as claims that cite the turns before them, at most two."""
    turns = tables.table(spark, d, "conversations").where("role = 'assistant' and turn >= 1")
    cites = F.when(F.col("turn") >= 2, F.array(F.col("turn") - 1, F.col("turn") - 2)).otherwise(F.array(F.col("turn") - 1))
    return turns.select(F.col("conv_id").alias("qid"), "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"), cites.alias("citations"))


@query(f"""WITH c AS (SELECT conv_id AS qid, turn, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS text FROM (SELECT conv_id, turn, {_sent('text')} AS s FROM conversations WHERE role = 'assistant' AND turn >= 1)),
    p AS (SELECT c.qid, c.turn, c.pos, c.text, x.turn AS rank, x.text AS passage FROM c LEFT JOIN conversations x ON x.conv_id = c.qid AND x.turn BETWEEN greatest(c.turn - 2, 0) AND c.turn - 1),
    a AS (SELECT qid, turn, pos, text, passage FROM p UNION ALL SELECT qid, turn, pos, text, string_agg(passage, ' ' ORDER BY rank) FROM p WHERE passage IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
    t AS (SELECT *, list_distinct({_tok('text')}) AS w, list_distinct({_tok('passage')}) AS v FROM a),
    m AS (SELECT qid, turn, pos, max(CASE WHEN passage IS NOT NULL THEN len(list_intersect(w, v)) / greatest(len(w), 1) END) AS s FROM t GROUP BY ALL)
    SELECT qid, turn, pos, round(coalesce(greatest(s, 0.0), 0.0), 6) AS support_score, coalesce(greatest(s, 0.0), -1.0) >= 0.05 AS supported FROM m""")
def verify_claims(spark, d):
    claims = _claims(spark, d).withColumn("cid", F.struct("qid", "turn", "pos"))
    passages = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), "text")
    out = answers.verify(claims, passages, retrieval.containment_scorer)
    return out.select("cid.qid", "cid.turn", "cid.pos", F.round("support_score", 6).alias("support_score"), "supported")


CLAIM_ROWS = f"""c0 AS (SELECT conv_id, turn, {_sent('text')} AS s FROM conversations WHERE role = 'assistant' AND turn >= 1),
    cl AS (SELECT conv_id AS qid, turn, generate_subscripts(s, 1) AS pos, unnest(s) AS text, CASE WHEN turn >= 2 THEN [turn - 1, turn - 2] ELSE [turn - 1] END AS cites FROM c0),
    cw AS (SELECT *, list_distinct(list_transform({_tok('text')}, lambda t: regexp_replace(t, 's+$', ''))) AS words, row_number() OVER (PARTITION BY qid, turn ORDER BY pos) AS i FROM cl)"""


@query(f"""WITH RECURSIVE {CLAIM_ROWS},
    m AS (SELECT qid, turn, i, [struct_pack(w := words, t := text, c := cites)] AS kept FROM cw WHERE i = 1
          UNION ALL
          SELECT n.qid, n.turn, n.i, CASE WHEN n.at > 0 THEN list_transform(n.kept, lambda k, j: CASE WHEN j = n.at THEN struct_pack(w := k.w, t := k.t, c := list_sort(list_distinct(list_concat(k.c, n.cites)))) ELSE k END)
                 ELSE list_append(n.kept, struct_pack(w := n.words, t := n.text, c := n.cites)) END
          FROM (SELECT cw.qid, cw.turn, cw.i, cw.words, cw.text, cw.cites, m.kept,
                       coalesce(list_position(list_transform(m.kept, lambda k: len(list_intersect(k.w, cw.words)) / greatest(len(list_distinct(list_concat(k.w, cw.words))), 1) >= 0.8), true), 0) AS at
                FROM m JOIN cw ON cw.qid = m.qid AND cw.turn = m.turn AND cw.i = m.i + 1) n)
    SELECT qid, turn, i AS n_claims, len(kept) AS n_kept, sha256(array_to_string(list_transform(kept, lambda k: k.t || ' ' || array_to_string(list_transform(k.c, lambda x: x::VARCHAR), ',')), chr(10))) AS kept_sha
    FROM m QUALIFY i = max(i) OVER (PARTITION BY qid, turn)""")
def claim_dedupe(spark, d):
    claims = _claims(spark, d).groupBy("qid", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", F.transform("citations", lambda c: c.cast("int")).alias("citations")))), lambda c: F.struct(c["text"].alias("text"), c["citations"].alias("citations"))).alias("claims"))
    merged = claims.withColumn("kept", T.merged_claims(F.col("claims")))
    told = F.array_join(F.transform("kept", lambda k: F.concat_ws(" ", k["text"], F.array_join(F.transform(k["citations"], lambda x: x.cast("string")), ","))), "\n")
    return merged.select("qid", "turn", F.size("claims").alias("n_claims"), F.size("kept").alias("n_kept"), F.sha2(told, 256).alias("kept_sha"))


SHORT = ORACLES["compress_sentences"].rsplit("SELECT qid, unit_id, sha256", 1)[0]


@query(f"{SHORT} SELECT qid, round(sum(length(CASE WHEN len(s) <= 4 THEN text ELSE short END)) / greatest(1, sum(length(text))), 3) AS ratio FROM s LEFT JOIN c USING (qid, unit_id) GROUP BY qid")
def compression_ratio(spark, d):
    """What the compressor keeps of each question's passages."""
    hits = _reranked(spark, d).join(tables.units(spark, d).select("unit_id", "text"), "unit_id").join(tables.questions(spark, d).withColumnRenamed("text", "question"), "qid")
    return answers.compression_ratio(hits, answers.compress(hits, retrieval.overlap_scorer)).select("qid", F.round("ratio", 3).alias("ratio"))


# Evaluation

def _gold(spark, d):
    """Documents that contain a question's text whole."""
    return retrieval.containing(tables.questions(spark, d), tables.units(spark, d)).withColumnRenamed("unit_id", "page")


@query(f"WITH {GOLD} SELECT qid, page FROM g")
def gold_pages(spark, d):
    return _gold(spark, d)


METRICS = f"""{BM25}, {GOLD}, r AS (SELECT g.qid, g.page, min(rank) AS rank FROM g LEFT JOIN bm ON bm.qid = g.qid AND bm.unit_id = g.page GROUP BY ALL),
    m AS (SELECT b.item_id AS qid, count(r.page) AS n_gold, {", ".join(f"coalesce(max(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0) AS recall_{k}, CAST(count(CASE WHEN rank <= {k} THEN 1 END) = count(r.page) AS INT) AS all_{k}" for k in (1, 3, 5, 10))},
        coalesce(1.0 / min(rank), 0.0) AS mrr,
        CASE WHEN count(r.page) > 0 THEN coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) END), 0.0) / list_sum(list_transform(range(1, least(count(r.page), 10) + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0.0 END AS ndcg_10
        FROM benchmark b LEFT JOIN r ON r.qid = b.item_id GROUP BY b.item_id)"""


def _metrics(spark, d):
    q = tables.questions(spark, d)
    hits = stored(spark, d).bm25(q).select("qid", F.col("unit_id").alias("page"), "rank")
    return evaluate.retrieval_metrics(hits, _gold(spark, d), q)


@query(f"WITH {METRICS} SELECT qid, n_gold, recall_1, recall_3, recall_5, recall_10, all_1, all_3, all_5, all_10, round(mrr, 6) AS mrr, round(ndcg_10, 6) AS ndcg_10 FROM m")
def recall_mrr_ndcg(spark, d):
    return _metrics(spark, d).withColumns({"mrr": F.round("mrr", 6), "ndcg_10": F.round("ndcg_10", 6)})


@query(f"""WITH {METRICS} SELECT 'bm25' AS variant, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr,
    round(avg(CASE WHEN n_gold > 0 THEN recall_5 END), 6) AS answerable_recall_5, round(avg(CASE WHEN n_gold > 0 THEN mrr END), 6) AS answerable_mrr,
    round(avg(CASE WHEN n_gold > 1 THEN all_5 END), 6) AS multi_all_5 FROM m""")
def eval_summary(spark, d):
    rows = _metrics(spark, d).withColumn("variant", F.lit("bm25")).withColumn("multi_all", F.when(F.col("n_gold") > 1, F.col("all_5")))
    s = evaluate.summary(rows, "variant", ["recall_5", "mrr", "multi_all"], {"answerable": F.col("n_gold") > 0})
    return s.select("variant", "n", *[F.round(c, 6).alias(a) for c, a in (("recall_5", "recall_5"), ("mrr", "mrr"), ("answerable_recall_5", "answerable_recall_5"), ("answerable_mrr", "answerable_mrr"), ("multi_all", "multi_all_5"))])


@query(f"""WITH {RERANK}, {GOLD}, t AS (SELECT qid, round(max(score), 6) AS score FROM re GROUP BY qid), s AS (SELECT score, qid IN (SELECT qid FROM g) AS pos FROM t),
    c AS (SELECT DISTINCT score AS th FROM s UNION SELECT 0.0), j AS (SELECT th, (SELECT count(*) FROM s WHERE pos AND score >= th) / greatest((SELECT count(*) FROM s WHERE pos), 1) - (SELECT count(*) FROM s WHERE NOT pos AND score >= th) / greatest((SELECT count(*) FROM s WHERE NOT pos), 1) AS j FROM c)
    SELECT th AS threshold, round(j, 6) AS j FROM j ORDER BY round(j.j, 9) DESC, th LIMIT 1""")
def youden_threshold(spark, d):
    top = _reranked(spark, d).groupBy("qid").agg(F.round(F.max("score"), 6).alias("score"))
    marked = top.join(_gold(spark, d).select("qid").distinct().withColumn("positive", F.lit(True)), "qid", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    return evaluate.youden_threshold(marked.select("score", "positive")).withColumn("j", F.round("j", 6))


@query("SELECT doc_id AS id, source AS type FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def limit_per_type(spark, d):
    return evaluate.limit_per_type(tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("type")), 5)


@query("""WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS unit_id, list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id) <= 40)
    SELECT qid, unit_id, round(score, 6) AS score FROM k WHERE score BETWEEN 0.2 AND 0.45 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_id) = 1""")
def pair_mining(spark, d):
    v = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vec"))
    return evaluate.similar_pairs(v, 0.2, 0.45, v.where("unit_id % 100 = 0").withColumnRenamed("unit_id", "qid")).withColumn("score", F.round("score", 6))


@query()
def pair_matching(spark, d):
    """Both kinds over all units. The table has no places: its label stands for the source, runs of ten for sections, and the id for the page."""
    v = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vec"), F.col("label").alias("source"), F.floor(F.col("vec_id") / 10).alias("section"), F.col("vec_id").alias("page"))
    made = [evaluate.matched_pairs(v, kind, 0.2, 0.45).select(F.lit(kind).alias("kind"), "a", "b", F.round("score", 6).alias("score")) for kind in ("comparison", "bridge")]
    return made[0].union(made[1])


@query()
def bootstrap_ci(spark, d):
    return evaluate.bootstrap_ci(_metrics(spark, d).select((F.col("n_gold") > 0).cast("int").alias("answerable"), F.col("mrr").alias("value")), "answerable")


# Rewards and training pairs

def _reward_rows(spark, d):
    n = F.col("turn")
    return tables.table(spark, d, "conversations").select("conv_id", "turn", (n % 5 != 0).alias("parsed"), (n % 2 == 0).alias("object"), (n % 4).cast("int").alias("n_claims"), F.least(n % 3, n % 4).cast("int").alias("supported"), (F.col("conv_id") % 2 == 0).alias("answerable"), F.lit(True).alias("has_gold"), (n % 3 == 1).alias("cites_gold"), F.lit(True).alias("has_reference"), ((F.col("conv_id") % 5) / 4.0).alias("coverage"))


REWARD = """w AS (SELECT conv_id, turn, turn % 5 <> 0 AS parsed, turn % 2 = 0 AS obj, turn % 4 AS n, least(turn % 3, turn % 4) AS sup, conv_id % 2 = 0 AS ans, turn % 3 = 1 AS cg, (conv_id % 5) / 4.0 AS cov FROM conversations),
    rw AS (SELECT conv_id, turn, round(CASE WHEN NOT parsed THEN CASE WHEN obj THEN -0.5 ELSE -1.0 END WHEN n = 0 THEN CASE WHEN ans THEN -1.0 ELSE 1.0 END
        ELSE sup / n + CASE WHEN ans THEN 0.5 * cg::INT + 0.5 * cov ELSE 0 END - CASE WHEN ans THEN 0 ELSE 1 END - 0.1 * greatest(0, n - 6) END, 6) AS reward FROM w)"""


@query(f"WITH {REWARD} SELECT conv_id, turn, reward FROM rw")
def answer_reward(spark, d):
    return answers.answer_reward(_reward_rows(spark, d)).select("conv_id", "turn", F.round("reward", 6).alias("reward"))


@query(f"""WITH {REWARD}, s AS (SELECT DISTINCT conv_id AS prompt, text AS completion, reward FROM rw JOIN conversations USING (conv_id, turn)),
    p AS (SELECT prompt, max(struct_pack(r := reward, c := completion)) AS hi, min(struct_pack(r := reward, c := completion)) AS lo, count(*) AS n FROM s GROUP BY prompt)
    SELECT prompt, sha256(hi.c) AS chosen, sha256(lo.c) AS rejected, round(hi.r - lo.r, 6) AS margin FROM p WHERE n >= 2 AND hi.r - lo.r >= 0.5""")
def preference_pairs(spark, d):
    rewards = answers.answer_reward(_reward_rows(spark, d)).select("conv_id", "turn", F.round("reward", 6).alias("reward"))
    samples = rewards.join(tables.table(spark, d, "conversations"), ["conv_id", "turn"]).select(F.col("conv_id").alias("prompt"), F.col("text").alias("completion"), "reward")
    return answers.preference_pairs(samples).select("prompt", F.sha2("chosen", 256).alias("chosen"), F.sha2("rejected", 256).alias("rejected"), F.round("margin", 6).alias("margin"))


@query(f"""WITH {BM25}, {GOLD}, t AS (SELECT qid, list(unit_id) AS pages FROM bm WHERE rank <= 5 GROUP BY qid), gg AS (SELECT qid, list(DISTINCT page) AS gold FROM g GROUP BY qid)
    SELECT qid, round(CASE WHEN qid % 7 = 0 THEN -1.0 ELSE len(list_intersect(gold, pages)) / len(gold) - 0.1 * greatest(0, qid % 5 - 3) END, 6) AS reward FROM gg JOIN t USING (qid)""")
def decompose_reward(spark, d):
    hits = stored(spark, d).bm25(tables.questions(spark, d), k=5).groupBy("qid").agg(F.collect_list("unit_id").alias("pages"))
    gold = _gold(spark, d).groupBy("qid").agg(F.collect_set("page").alias("gold"))
    queries = F.when(F.col("qid") % 7 != 0, F.array_repeat(F.lit("sub question"), (F.col("qid") % 5).cast("int")))
    return answers.decompose_reward(gold.join(hits, "qid").withColumn("queries", queries)).select("qid", F.round("reward", 6).alias("reward"))


@query(f"""WITH a AS (SELECT conv_id AS prompt, min(text) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id), u AS (SELECT * FROM a WHERE prompt % 5 <> 0),
    r AS (SELECT question FROM a WHERE prompt % 3 = 0), l AS (SELECT question, max(prompt) AS last FROM u GROUP BY question),
    m AS (SELECT u.*, u.prompt = l.last AND u.question IN (SELECT question FROM r) AS first, sha1('0|' || u.prompt) AS key FROM u JOIN l USING (question)),
    k AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY key, prompt) AS n FROM m)
    SELECT prompt, '{{"claims": [{{"text": "found ' || prompt || '", "citations": [1]}}]}}' AS chosen, '{answers.REFUSAL_TEXT}' AS rejected, 'anti_refusal' AS kind FROM k
    WHERE first OR n <= (SELECT count(*) FROM r) - (SELECT count(*) FROM m WHERE first)""")
def anti_refusal_pairs(spark, d):
    """Completions stand for answers; those of every fifth conversation do not parse and are left out."""
    asked = tables.table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min("text").alias("question"))
    said = F.concat(F.lit('{"claims": [{"text": "found '), F.col("conv_id").cast("string"), F.lit('", "citations": [1]}]}'))
    chosen = F.when(F.col("conv_id") % 5 == 0, "I can't say").otherwise(said)
    return answers.anti_refusal_pairs(asked.select("question", F.col("conv_id").alias("prompt"), chosen.alias("chosen")), asked.where("conv_id % 3 = 0").select("question"))


# The whole answering pipeline, with deterministic stand-ins for the models

@query()
def answer_pipeline(spark, d):
    from candela import pipeline
    from candela.config import load_config

    return pipeline.answer(tables.questions(spark, d), tables.units(spark, d), load_config(overrides=["agent.compression=extractive"]))


@query()
def ablation_runs(spark, d):
    from candela import pipeline

    return pipeline.ablate({"default": [], "no_decompose": ["agent.decompose=false"], "gate": ["agent.min_relevance=0.5"]}, tables.questions(spark, d), tables.units(spark, d))
