"""Calls of generators, stored indexes and sources."""

import json

import numpy as np
from pyspark.sql import functions as F

from candela import generation
from candela.functions import prompts
from candela.operators import datasets, retrieval
from candela.sources import index, tables


def test_answers_that_must_parse_are_asked_for_twice():
    calls = []

    def client(requests):
        calls.append([(r["max_tokens"], r["schema"]) for r in requests])
        return ['{"a": 1}' if r["max_tokens"] > 100 or r["messages"] == "good" else '{"a"' for r in requests]

    ask = lambda m, schema: {"messages": m, "schema": schema, "max_tokens": 60, "temperature": 0.0, "adapter": None}
    assert generation.complete(client, [ask("good", "{}"), ask("cut", "{}"), ask("free", None)]) == ['{"a": 1}', '{"a": 1}', '{"a"']
    assert calls == [[(60, "{}"), (60, "{}"), (60, None)], [(120, "{}")]]
    assert generation.complete(lambda rs: ["no"] * len(rs), [ask("x", "{}")]) == [None] and generation.complete(client, []) == []


def test_bodies_carry_schema_and_adapters():
    r = {"messages": '[{"role": "user", "content": "q"}]', "schema": prompts.ROUTE, "max_tokens": 9, "temperature": 0.5, "adapter": "answer"}
    body = generation.chat_body(r, ["answer", "decompose"])
    assert body["lora"] == [{"id": 0, "scale": 1.0}, {"id": 1, "scale": 0.0}] and body["response_format"]["json_schema"]["schema"]["required"] == ["action"]
    assert {x["scale"] for x in generation.chat_body(r | {"adapter": None}, ["answer"])["lora"]} == {0.0} and "lora" not in generation.chat_body(r, [])


def scripted(requests):
    """One answer for each kind of schema."""
    out = []
    for r in requests:
        fields = list(json.loads(r["schema"])["properties"]) if r["schema"] else []
        said = {"action": {"action": "ANSWER_DIRECTLY"}, "queries": {"queries": ["Two", "two ", "the q", "three"]}, "missing": {"missing": "the date", "query": " when "}, "query": {"query": " other words "}, "claims": {"claims": [{"text": "t", "citations": [1]}]}}
        out.append(json.dumps(said[fields[0]]) if fields else f" free {r['max_tokens']} ")
    return out


def test_agents_read_each_answer(spark):
    agents = generation.Agents(generation.Generator(lambda: scripted))
    df = spark.createDataFrame([("the q", ["a", "b"], ["S > x", "S > y", "x", None, ""])], "q string, t array<string>, s array<string>")
    row = df.select(agents.route(F.col("q")).alias("route"), agents.split_question(F.col("q"), 2).alias("parts"), agents.missing_tokens(F.col("q"), F.col("t")).alias("next"), agents.rewritten(F.col("q"), F.col("t"), F.col("s")).alias("again"), agents.answer_directly(F.col("q")).alias("direct"), agents.situate(F.col("q"), F.col("q")).alias("placed"), prompts.sections_seen(F.col("s")).alias("seen")).first()
    assert row.asDict() == {"route": "ANSWER_DIRECTLY", "parts": ["Two", "three"], "next": "when", "again": "other words", "direct": " free 512 ", "placed": "free 100", "seen": "x; y"}


def test_failing_generators_leave_defaults(spark):
    agents = generation.Agents(generation.Generator(lambda: lambda rs: ["{"] * len(rs)))
    judge = generation.Judge(generation.Generator(lambda: lambda rs: ["{"] * len(rs)))
    df = spark.createDataFrame([("q", ["a"])], "q string, t array<string>")
    row = df.select(agents.route(F.col("q")).alias("a"), agents.split_question(F.col("q")).alias("b"), agents.missing_tokens(F.col("q"), F.col("t")).alias("c"), agents.rewritten(F.col("q"), F.col("t")).alias("d"), judge.correctness(F.col("q"), F.col("q"), F.col("q")).alias("e"), judge.answered(F.col("q"), F.col("t")).alias("f")).first()
    assert tuple(row) == ("SEARCH", [], None, "q", None, None)


def test_unanswerable_questions_differ(spark):
    asked = []

    def client(requests):
        asked.append(json.loads(requests[0]["messages"])[0]["content"])
        return [json.dumps({"questions": [f"{'common head ' * 6}{len(asked)}", f"own {len(asked)}"]})]

    class Inline:
        def __call__(self, messages, schema, most, temperature):
            return generation.Generator(lambda: client)(messages, schema, most, temperature)

    batches = spark.createDataFrame([(0, ["common " * 12 + "a", "x"]), (1, ["common " * 12 + "b", " y ", "z"])], "batch int, questions array<string>")
    got = datasets.unanswerable_items(batches, 3).orderBy("id").collect()
    assert [(r["id"], r["question"]) for r in got] == [("u0000", ("common " * 12 + "a").strip()), ("u0001", "x"), ("u0002", "y")]
    told = datasets.asked_batches(spark, Inline(), ["s"], 4, most=3)
    assert 1 <= told.count() <= 3


def test_pair_items_take_half_of_each_kind(spark):
    side = "struct<source:string,page:int,section:string,text:string>"
    rows = [(kind, i, ("a", i, "", "t" * i), ("b", i, "S", "u")) for kind in ("bridge", "comparison") for i in range(8)]

    def writer(requests):
        return [json.dumps({"usable": True, "needs_both": "t" * 3 not in json.loads(r["messages"])[0]["content"], "question": "What do both of the passages tell?", "answer": "a"}) for r in requests]

    made = datasets.pair_items(spark.createDataFrame(rows, f"kind string, turn int, a {side}, b {side}"), generation.Generator(lambda: writer), 4).orderBy("id").collect()
    assert [(r["id"], r["type"], r["gold"][0]["page"]) for r in made] == [("m0000", "comparison", 0), ("m0001", "comparison", 1), ("m0002", "bridge", 0), ("m0003", "bridge", 1)]


def test_index_is_replaced_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "ix")
    assert index.load(spark, folder) is None
    units = spark.createDataFrame([("a", "pump seal", 1), ("b", None, 1), ("a", "valve", 2)], "unit_id string, text string, ord int")
    built = index.build(units, folder)
    assert {(r["unit_id"], r["text"]) for r in built.units.collect()} == {("a", "valve"), ("b", "")}  # the last one of an id stays
    index.write_derived(built, "weights", built.postings.select("unit_id", "term"))
    assert index.load(spark, folder).table("weights").count() == 1
    index.build(spark.createDataFrame([("c", "pump pump")], "unit_id string, text string"), folder)
    again = index.load(spark, folder)
    asked = spark.createDataFrame([(1, "pump valve")], "qid int, text string")
    assert [r["unit_id"] for r in again.bm25(asked).collect()] == ["c"] and again.folder != built.folder
    assert index.build(units.where("false"), str(tmp_path / "none")).bm25(asked).count() == 0


def test_cells_have_the_promised_recall(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "unit_id long, vec array<double>")
    held = index.build(vectors.select("unit_id", F.lit("").alias("text")), str(tmp_path), vectors=vectors, cells=20)
    asked = vectors.where("unit_id % 100 = 0").withColumnRenamed("unit_id", "qid")
    found = {}
    for name, probes in (("some", 5), ("all", None)):
        found[name] = {(r["qid"], r["unit_id"]) for r in held.dense(asked, 10, probes).collect()}
    assert len(found["some"] & found["all"]) / len(found["all"]) >= 0.9 and held.vectors.count() == 3000


def test_dense_cells_on_the_embeddings(spark):
    from candela.plans.data_queries import QUERIES
    from tests.conftest import SMALL

    exact = {(r["qid"], r["unit_id"]) for r in QUERIES["stored_dense_topk"](spark, SMALL).collect()}
    some = {(r["qid"], r["unit_id"]) for r in QUERIES["dense_cells_topk"](spark, SMALL).collect()}
    assert len(exact & some) / len(exact) >= 0.9


def test_late_interaction_query_by_brute_force(spark):
    from candela import models
    from candela.plans.data_queries import QUERIES, _fused
    from tests.conftest import SMALL

    texts = {r["unit_id"]: r["text"] for r in tables.units(spark, SMALL).collect()}
    asked = {r["qid"]: r["text"] for r in tables.questions(spark, SMALL).where("qid < 6").collect()}
    cands: dict = {}
    for r in _fused(spark, SMALL).where("rank <= 20 and qid < 6").collect():
        a, b = models.token_matrix(asked[r["qid"]], True), models.token_matrix(texts[r["unit_id"]], False)
        cands.setdefault(r["qid"], []).append((-round(float((a @ b.T).max(axis=1).sum()), 9), r["unit_id"]))
    got: dict = {}
    for r in QUERIES["late_interaction_topk"](spark, SMALL).where("qid < 6").orderBy("rank").collect():
        got.setdefault(r["qid"], []).append(r["unit_id"])
    assert got == {q: [u for _, u in sorted(c)[:5]] for q, c in cands.items()}


def test_sources(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, body in (("a.txt", "x\ny"), ("b.txt", "bad"), ("c.md", "z")):
        (tmp_path / "f" / name).write_text(body)

    def parse(path, content):
        if content == b"bad":
            raise ValueError("cannot read")
        return [{"ord": i, "text": t} for i, t in enumerate(content.decode().split("\n"))]

    rows = {(r["path"].rsplit("/", 1)[1], r["ord"], r["text"], r["error"]) for r in tables.parsed(tables.scan_folder(spark, str(tmp_path / "f"), "*.txt"), parse, "ord long, text string").collect()}
    assert rows == {("a.txt", 0, "x", None), ("a.txt", 1, "y", None), ("b.txt", None, None, "ValueError: cannot read")}
    items = tmp_path / "items.jsonl"
    items.write_text('{"id": "p", "question": "old"}\n\n{"id": "q", "question": "only", "gold": [{"source": "s", "page": 2}]}\n{"id": "p", "question": "new"}\n')
    assert {r["id"]: r["question"] for r in tables.items(spark, str(items)).collect()} == {"p": "new", "q": "only"}
    blocks = {"one": lambda files: files.select("path")}
    assert tables.blocks_of(spark, str(tmp_path / "f"), "one", blocks, "*.md").count() == 1
    try:
        tables.blocks_of(spark, str(tmp_path / "f"), "two", blocks)
        raise AssertionError("an unknown parser passed")
    except ValueError:
        pass


def test_scores_are_cached_and_summaries_written(spark, tmp_path):
    path, seen = str(tmp_path / "scores"), []

    def score(rows):
        seen.append(rows.count())
        return rows.withColumn("score", F.length("t"))

    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id int, t string")
    assert tables.update_scores(spark, path, rows, "id", score) and not tables.update_scores(spark, path, rows, "id", score)
    assert tables.update_scores(spark, path, rows.union(spark.createDataFrame([(3, "ccc")], rows.schema)), "id", score) and seen == [2, 1]
    assert {r["id"]: r["score"] for r in spark.read.parquet(path).collect()} == {1: 1, 2: 2, 3: 3}
    summary = spark.createDataFrame([("v2", None), ("v1", 0.5)], "variant string, mrr double")
    tables.save_summary(summary, str(tmp_path / "s"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s" / "table"), wholetext=True).collect()][0].strip().splitlines() == ["| variant | mrr |", "| --- | --- |", "| v1 | 0.5 |", "| v2 | - |"]
    tables.save_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
