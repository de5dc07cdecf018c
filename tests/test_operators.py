import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import answers, chunking, evaluate, layout, retrieval
from candela.sources import tables
from candela.streaming.append import append_stream


def test_bm25_by_the_formula(spark):
    texts = {"a": "pump seal seal leak", "b": "seal test", "c": "", "d": "pump pump pump valve valve", "e": "the of and"}
    units = spark.createDataFrame([*texts.items(), ("f", None)], "unit_id string, text string").fillna("")
    got = {(r["qid"], r["unit_id"]): r["score"] for r in retrieval.bm25(spark.createDataFrame([(1, "pump seal seal"), (2, "nothing")], "qid int, text string"), units).collect()}
    toks = {k: [w for w in v.split() if w not in ("the", "of", "and")] for k, v in texts.items()} | {"f": []}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {}
    for u, t in toks.items():
        s = 0.0
        for term in ("pump", "seal"):
            df = sum(term in x for x in toks.values())
            if term in t:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * t.count(term) * 2.5 / (t.count(term) + 1.5 * (0.25 + 0.75 * len(t) / mean))
        if s:
            want[1, u] = s
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_weighted_rank_fusion(spark):
    rng = random.Random(4)
    rankings = [(w, rng.sample("pqrstuv", 5)) for w in (2.0, 1.0, 1.0)]
    rows = [(1, u, i + 1, w) for w, ranked in rankings for i, u in enumerate(ranked)]
    got = {r["unit_id"]: r["score"] for r in retrieval.reciprocal_ranks(spark.createDataFrame(rows, "qid int, unit_id string, rank int, weight double"), 60).collect()}
    assert {u: round(s, 12) for u, s in got.items()} == {u: round(sum(w / (61 + r.index(u)) for w, r in rankings if u in r), 12) for u in got}


def test_equal_sizes_of_a_block_go_to_the_earlier_line(spark):
    rows = [("d", 0, 0, 14.04, False, "abc"), ("d", 0, 1, 11.0, False, "xyz"), ("d", 1, 0, 11.0, False, "xyz"), ("d", 1, 1, 14.0, False, "abc")]
    spans = spark.createDataFrame(rows, "source string, block int, line int, size double, bold boolean, text string")
    assert {r["block"]: r["size"] for r in layout.block_fonts(spans).collect()} == {0: 14.0, 1: 11.0}
    assert {r["size"] for r in layout.block_fonts(spans.drop("line")).collect()} == {11.0}


def test_sparse_dot(spark):
    rng = random.Random(5)
    asked = [(q, t, rng.random()) for q in range(4) for t in rng.sample(range(12), 4)]
    held = [(u, t, rng.random()) for u in "klmno" for t in rng.sample(range(12), 5)]
    got = {(r["qid"], r["unit_id"]): round(r["score"], 9) for r in retrieval.sparse_dot(spark.createDataFrame(asked, "qid int, term int, w double"), spark.createDataFrame(held, "unit_id string, term int, w double")).collect()}
    want: dict = {}
    for q, t, w in asked:
        for u, t2, v in held:
            if t == t2:
                want[q, u] = want.get((q, u), 0.0) + w * v
    assert got == {k: round(v, 9) for k, v in want.items()}


def test_section_paths_by_brute_force(spark):
    """A block's path holds each heading that no later one of its level or above has closed."""
    rng = random.Random(6)
    rows = [(f"s{s}", i, *rng.choice([("heading", f"h{i}", 1), ("heading", f"h{i}", 2), ("heading", f"h{i}", 3), ("paragraph", f"p{i}", 0), ("table", f"t{i}", 0)])) for s in range(3) for i in range(40)]
    df = spark.createDataFrame([(s, i, k, t, lv) for s, i, k, t, lv in rows], "source string, ord long, kind string, text string, level int")
    got = {(r["source"], r["ord"]): r["section"] for r in layout.section_paths(df, 3).collect()}
    assert got == {(r["source"], r["ord"]): r["section"] for r in layout.section_paths(df, 3, 7).collect()}
    for s, i, *_ in rows:
        heads = [(j, t, lv) for s2, j, k, t, lv in rows if s2 == s and j <= i and k == "heading"]
        want = [t for j, t, lv in heads if not any(j < j2 and lv2 <= lv for j2, _, lv2 in heads)]
        assert got[s, i] == " > ".join(want)


def test_chunks_keep_to_pages_and_sections(spark):
    rows = [("m", 0, "paragraph", "first on page one", 1, "X"), ("m", 1, "paragraph", "second on page one", 1, "X"), ("m", 2, "paragraph", "other section", 1, "Y"), ("m", 3, "heading", "skipped", 1, "Z"), ("m", 4, "paragraph", "page two", 2, "Y"), ("m", 5, "table", "| q |\n|---|\n| 7 |", 2, "Y")]
    blocks = spark.createDataFrame(rows, "source string, ord long, kind string, text string, page int, section string")
    got = [(c["text"], c["page"], c["section"]) for c in chunking.chunk_blocks(blocks).orderBy("ord").collect()]
    assert got == [("first on page one\nsecond on page one", 1, "X"), ("other section", 1, "Y"), ("page two", 2, "Y"), ("| q |\n|---|\n| 7 |", 2, "Y")]
    parents = spark.createDataFrame([("p", " ".join(f"Row {i} tells about part {i * i}." for i in range(60)), "m", 4, "S")], "id string, text string, source string, page int, section string")
    children = chunking.make_children(parents, 180, 30).collect()
    assert len(children) > 5 and {(c["parent_id"], c["section"], c["page"]) for c in children} == {("p", "S", 4)} and len({c["id"] for c in children}) == len(children)


def test_layout_of_spans(spark):
    spans = spark.createDataFrame([("d", 0, 16.02, True, "Title"), ("d", 1, 11.0, False, "body text that is longer"), ("d", 2, 11.0, True, "Bold line")], "source string, block int, size double, bold boolean, text string")
    assert layout.body_size(spans).first()["body"] == 11.0
    assert {r["block"]: (r["size"], r["bold"]) for r in layout.block_fonts(spans).collect()} == {0: (16.0, True), 1: (11.0, False), 2: (11.0, True)}
    lines = spark.createDataFrame([("d", 0, 0, "exam-"), ("d", 0, 1, "ple of  glue"), ("d", 0, 2, "More")], "source string, block int, line int, text string")
    assert layout.joined_lines(lines).first()["text"] == "example of glue More"
    blocks = spark.createDataFrame([("d", 1, 300.0, 0.0, 200.0, 0), ("d", 1, 10.0, 50.0, 200.0, 1), ("d", 1, 10.0, 5.0, 200.0, 2)], "source string, page int, x0 double, y0 double, mid double, ord int")
    assert [r["ord"] for r in layout.reading_order(blocks).orderBy("place").collect()] == [2, 1, 0]


def test_metrics_by_brute_force(spark):
    rng = random.Random(7)
    gold = {q: set(rng.sample(range(30), rng.randint(0, 4))) for q in range(12)}
    ranked = {q: [rng.randrange(30) for _ in range(12)] for q in range(12)}
    hits = spark.createDataFrame([(q, p, i + 1) for q, ps in ranked.items() for i, p in enumerate(ps)], "qid int, page int, rank int")
    rows = evaluate.retrieval_metrics(hits, spark.createDataFrame([(q, p) for q, ps in gold.items() for p in ps], "qid int, page int"), spark.createDataFrame([(q,) for q in gold], "qid int")).collect()
    for r in rows:
        want, got = gold[r["qid"]], ranked[r["qid"]]
        first = {p: got.index(p) + 1 for p in want if p in got}
        for k in (1, 3, 5, 10):
            assert r[f"recall_{k}"] == int(any(f <= k for f in first.values())) and r[f"all_{k}"] == int(all(first.get(p, 99) <= k for p in want))
        assert abs(r["mrr"] - (1 / min(first.values()) if first else 0)) < 1e-12
        best = sum(1 / math.log2(i + 2) for i in range(min(len(want), 10)))
        assert abs(r["ndcg_10"] - (sum(1 / math.log2(f + 1) for f in first.values() if f <= 10) / best if best else 0)) < 1e-12


def test_bootstrap_draws_by_place(spark):
    """The interval of seeded draws over values in their order."""
    rng = random.Random(8)
    values = {"x": [rng.random() for _ in range(15)], "y": [rng.random() for _ in range(90)], "z": [0.5]}
    df = spark.createDataFrame([(k, v, i) for k, vs in values.items() for i, v in enumerate(vs)], "k string, value double, at int").repartition(3)
    got = {r["k"]: r["half_width"] for r in evaluate.bootstrap_ci(df, "k", 300, 3, "at").collect()}
    for k, vs in values.items():
        draw = random.Random(3)
        means = sorted(sum(draw.choices(vs, k=len(vs))) / len(vs) for _ in range(300))
        assert got[k] == (None if len(vs) < 2 else round((means[292] - means[7]) / 2, 3))


def test_claims_and_rewards(spark):
    texts = ['so: {"claims": [{"text": " w x y z ", "citations": ["2", 1, 2]}, {"text": "It is not stated or mentioned", "citations": [1]}]} end', '{"claims": [{"text": "w", "citations": [3]}]}', '{"claims": [{"text": "w", "citations": []}]}', '{"claims": []}', "plain words", '{"claims": [{"text": "w", "citations": [1.9]}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("c", answers.parse_claims(F.col("t"), F.lit(2))).orderBy("i").collect()
    read = [None if r["c"] is None else [(c["text"], c["citations"]) for c in r["c"]] for r in df]
    assert read == [[("w x y z", [1, 2])], None, None, [], None, [("w", [1])]]
    base = dict(parsed=True, object=True, n_claims=4, supported=3, answerable=True, has_gold=True, cites_gold=True, has_reference=True, coverage=0.5)
    cases = [(base, 0.75 + 0.5 + 0.25), (base | {"cites_gold": False}, 1.0), (base | {"answerable": False}, -0.25), (base | {"n_claims": 9, "supported": 9}, 1.45), (base | {"n_claims": 0}, -1.0), (base | {"n_claims": 0, "answerable": False}, 1.0), (base | {"parsed": False}, -0.5), (base | {"parsed": False, "object": False}, -1.0)]
    schema = "parsed boolean, object boolean, n_claims int, supported int, answerable boolean, has_gold boolean, cites_gold boolean, has_reference boolean, coverage double"
    got = answers.answer_reward(spark.createDataFrame([tuple(c.values()) for c, _ in cases], schema).coalesce(1)).collect()
    assert [round(r["reward"], 9) for r in got] == [w for _, w in cases]


def test_compression_marks_gaps(spark):
    df = spark.createDataFrame([(1, "u", "alpha beta", "Alpha one. Nothing here. Nothing there. Beta alpha.")], "qid int, unit_id string, question string, text string")
    assert answers.compress(df, retrieval.overlap_scorer, 2).first()["text"] == "Alpha one. … Beta alpha."


def test_html_blocks(spark):
    html = "<html><h1>Top <b>x</b></h1><p>One<br><p>Two &amp;</p></html>"
    rows = tables.html_blocks(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("ord").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in rows] == [("heading", 1, "Top x"), ("paragraph", 0, "One"), ("paragraph", 0, "Two &amp;")]


def test_stream_appends_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "First text."), (2, "s", "Second text.")], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = lambda n: append_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination()
    stream(1)
    stream(2)  # replayed from the start: adds nothing
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("kind", ["comparison", "bridge"])
def test_matched_pairs(spark, kind):
    """In hash order each pair is its first unit's best that earlier pairs left, and who has no pair had no free partner at its turn."""
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(110, 6))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = [(i, v.tolist(), f"s{i % 3}", f"c{i % 4}", i // 9) for i, v in enumerate(vecs)]
    units = spark.createDataFrame(rows, "unit_id long, vec array<double>, source string, section string, page int")
    turn = {r["unit_id"]: i for i, r in enumerate(units.selectExpr("unit_id", "xxhash64(unit_id, 0) AS h").orderBy("h", "unit_id").collect())}
    pairs = [(r["a"], r["b"], r["score"]) for r in evaluate.matched_pairs(units, kind).collect()]
    used = [x for a, b, _ in pairs for x in (a, b)]
    assert len(pairs) > 8 and len(used) == len(set(used))
    taken = {x: turn[a] for a, b, _ in pairs for x in (a, b)}
    score = vecs @ vecs.T

    def partners(i):
        nearest = sorted(range(len(rows)), key=lambda j: -score[i, j])[:40]
        meets = lambda a, b: a[2] != b[2] if kind == "comparison" else a[2] == b[2] and a[3] != b[3] and abs(a[4] - b[4]) > 1
        return [j for j in nearest if j != i and 0.55 <= score[i, j] <= 0.9 and meets(rows[i], rows[j])]

    for a, b, s in pairs:
        free = [j for j in partners(a) if taken.get(j, 1e9) >= turn[a]]
        assert free[0] == b and abs(s - score[a, b]) < 1e-9
    for i in set(range(len(rows))) - set(used):
        assert all(taken.get(j, 1e9) < turn[i] for j in partners(i))
    first = {(a, b) for a, b, _ in sorted(pairs, key=lambda p: turn[p[0]])[:5]}
    assert {(r["a"], r["b"]) for r in evaluate.matched_pairs(units, kind, n=5).collect()} == first


def test_bootstrap_query_resamples_by_default(spark, monkeypatch):
    from candela.plans import registry

    asked = []
    monkeypatch.setattr(evaluate, "bootstrap_ci", lambda values, by, rounds=1000, seed=0, order="value": asked.append(rounds))
    monkeypatch.setattr(registry, "_metrics", lambda spark, d: spark.createDataFrame([(1, 0.5)], "n_gold int, mrr double"))
    registry.bootstrap_ci(spark, "")
    assert asked == [1000]


def test_settings_that_nothing_reads_are_refused():
    from candela.config import load_config

    for item in ("ingest.contextualize=true", "ingest.parser=layout", "eval.bootstrap=1000"):
        with pytest.raises(KeyError):
            load_config(overrides=[item])
