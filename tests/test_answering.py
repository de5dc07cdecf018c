"""Context expansion, span merging and the answering loop against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela import models, pipeline
from candela.config import load_config
from candela.operators import answers, evaluate, retrieval


def allowed(chunks, at, most, steps):
    """The interval that the rule allows, by enumeration: intervals are states (before, after), and a state's next one is tried from it.

    A step takes the chunk before if it is of the run and fits, then the one after if it fits on top; growth ends with
    the step that takes neither.
    """
    section = chunks[at][2]
    before = next((k for k in range(at + 1) if all(c[2] == section for c in chunks[k : at + 1])), at)
    after = max(k for k in range(at, len(chunks)) if all(c[2] == section for c in chunks[at : k + 1]))
    width = lambda lo, hi: sum(len(c[3]) for c in chunks[lo : hi + 1])
    states = [(at, at)]
    while steps is None or len(states) <= steps:
        lo, hi = states[-1]
        lo2 = lo - 1 if lo > before and width(lo - 1, hi) <= most else lo
        hi2 = hi + 1 if hi < after and width(lo2, hi + 1) <= most else hi
        if (lo2, hi2) == (lo, hi):
            break
        states.append((lo2, hi2))
    lo, hi = states[-1]
    pages = [c[4] for c in chunks[lo : hi + 1]]
    return "\n".join(c[3] for c in chunks[lo : hi + 1]), min(pages), max(pages)


@pytest.mark.parametrize("steps", [None, 1, 3])
def test_expansion(spark, steps):
    rng = random.Random(3)
    rows = [(s * 100 + i, f"s{s}", rng.choice("AAB"), "x" * rng.choice([0, 1, 5, 9, 40]) + str(i), i // 3) for s in range(3) for i in range(40)]
    df = spark.createDataFrame([(u, s, sec, u, t, p) for u, s, sec, t, p in rows], "unit_id int, source string, section string, ord int, text string, page int")
    got = {r["unit_id"]: (r["big"], r["page"], r["page_end"]) for r in answers.expand(df, 45, steps).collect()}
    for s in range(3):
        mine = [r for r in rows if r[1] == f"s{s}"]
        for i, r in enumerate(mine):
            assert got[r[0]] == allowed(mine, i, 45, steps), r


def test_expansion_of_some_chunks_equals_that_of_all(spark):
    rng = random.Random(4)
    rows = [(s * 100 + i, f"s{s}", rng.choice("AAB"), s * 100 + i, "x" * rng.choice([1, 5, 9]), i // 3) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "unit_id int, source string, section string, ord int, text string, page int")
    some = spark.createDataFrame([(3,), (3,), (117,), (239,), (None,)], "unit_id int")
    whole = {tuple(r) for r in answers.expand(df, 45).where("unit_id in (3, 117, 239)").collect()}
    assert {tuple(r) for r in answers.expand(df, 45, only=some).collect()} == whole


def test_merged_spans_skip_what_an_earlier_span_holds(spark):
    rows = [
        (1, 1, "a", "s", "x", 1, "one", "one\ntwo", 1, 2), (1, 2, "b", "s", "x", 2, "two", "one\ntwo", 1, 2),
        (1, 3, "c", "s", "y", 2, "two", "two\nfour", 2, 3), (1, 4, "d", "t", "x", 2, "two", "two", 2, 2), (2, 1, "b", "s", "x", 2, "two", "two", 2, 2),
    ]
    hits = spark.createDataFrame(rows, "qid int, rank int, unit_id string, source string, section string, at int, text string, big string, page int, page_end int")
    assert sorted((r["qid"], r["rank"], r["unit_id"]) for r in answers.merge_spans(hits).collect()) == [(1, 1, "a"), (1, 2, "c"), (1, 3, "d"), (2, 1, "b")]


def test_prompts_and_feedback(spark):
    df = spark.sql("SELECT array(named_struct('rank', 1, 'source', 'f', 'page', 3, 'section', '', 'text', 'body'), named_struct('rank', 2, 'source', 'g', 'page', 4, 'section', 'Top', 'text', 'more')) AS p, array(named_struct('text', 'no', 'supported', false), named_struct('text', 'yes', 'supported', true), named_struct('text', 'open', 'supported', cast(null AS boolean))) AS c")
    row = df.select(answers.format_passages(F.col("p")).alias("p"), answers.feedback(F.col("c")).alias("c")).first()
    assert row["p"] == "[1] (f, page 3)\nbody\n\n[2] (g, page 4, section: Top)\nmore" and row["c"] == "- no"


UNITS = [(1, "Alpha beta gamma."), (2, "Delta epsilon zeta. Alpha is here."), (3, "Eta theta iota kappa."), (4, "Beta lambda mu."), (5, "")]


@pytest.fixture(scope="module")
def small(spark):
    units = spark.createDataFrame(UNITS, "unit_id int, text string")
    return spark.createDataFrame([(1, "alpha beta"), (2, "delta theta"), (3, "unknown words"), (4, "Hello!")], "qid int, text string"), units


def test_dense_equals_brute_force(spark, small):
    asked, units = (df.select(df.columns[0], models.embed("text").alias("vec")) for df in small)
    vec = {r["unit_id"]: r["vec"] for r in units.collect()}
    got = {(r["qid"], r["unit_id"]): r["score"] for r in retrieval.dense(asked, units, 5, same_ids=False).collect()}
    for r in asked.collect():
        for u, v in vec.items():
            assert abs(got[r["qid"], u] - sum(a * b for a, b in zip(r["vec"], v, strict=True))) < 1e-9


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.mark.parametrize("reranker", ["overlap", "null"])
def test_iteration_by_plain_loops(spark, reranker):
    """Each question alone, with searches of its own over the same small table."""
    rng = random.Random(9)
    texts = {i: " ".join(rng.choices(WORDS, k=rng.randint(1, 2))) for i in range(25)}
    asked = {q: " ".join(rng.sample(WORDS, 9)) for q in range(6)}
    units = spark.createDataFrame(list(texts.items()), "unit_id int, text string")
    config = load_config(overrides=["retrieval.mode=sparse", "retrieval.top_k=3", "retrieval.fetch_k=6", "retrieval.rerank_k=4", "agent.decompose=false", "agent.retrieval_strategy=iterative", "agent.max_hops=3", f"retrieval.reranker={reranker}"])

    def score(question, unit):
        a, b = set(question.split()), set(texts[unit].split())
        return len(a & b) / len(a | b)

    def search(questions):
        """The reranked top three of each, as the engine's own single search gives them."""
        df = spark.createDataFrame(list(questions.items()), "qid int, text string")
        once = load_config(overrides=["retrieval.mode=sparse", "retrieval.top_k=3", "retrieval.fetch_k=6", "retrieval.rerank_k=4", "agent.decompose=false", f"retrieval.reranker={reranker}"])
        out: dict = {}
        for r in sorted(pipeline.retrieve(df, units, once).collect(), key=lambda r: r["rank"]):
            out.setdefault(r["qid"], []).append(r["unit_id"])
        return out

    hits = {q: list(h) for q, h in search(asked).items()}
    pins: dict = {q: [] for q in asked}
    said: dict = {q: set() for q in asked}
    live = set(asked)
    for _ in range(3):
        wanted = {}
        for q in live:
            left = [w for w in asked[q].split() if not any(w in texts[u].split() for u in hits[q])]
            if left and " ".join(left) not in said[q]:
                wanted[q] = " ".join(left)
                said[q].add(wanted[q])
        found, live = search(wanted) if wanted else {}, set()
        for q, ranked in found.items():
            new = [u for u in ranked if u not in hits[q]]
            if not new:
                continue
            live.add(q)
            pins[q].append(new[0])
            pool = hits[q] + new
            if reranker != "null":
                pool = sorted(pool, key=lambda u: (-round(score(asked[q], u), 9), u))
            hits[q] = [u for u in pool if u not in pins[q]][: 3 - len(pins[q])] + pins[q]
    df = spark.createDataFrame(list(asked.items()), "qid int, text string")
    got: dict = {}
    for r in sorted(pipeline.retrieve(df, units, config).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["qid"], []).append(r["unit_id"])
    assert got == hits and any(pins.values())


def test_answer_routes_refuses_and_corrects(spark, small):
    asked, units = small
    config = load_config(overrides=["retrieval.mode=sparse", "agent.route=true", "agent.crag=true", "agent.self_correct=true", "agent.self_correct_below=1.1"])
    rows = {r["qid"]: r for r in pipeline.answer(asked, units, config).collect()}
    assert rows[4]["action"] == "ANSWER_DIRECTLY" and not rows[4]["refused"] and rows[4]["text"] == models.DIRECT_ANSWER
    assert rows[3]["refused"] and rows[3]["text"] == answers.REFUSAL_TEXT
    assert rows[1]["n_supported"] >= 1 and "[1]" in rows[1]["text"]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        load_config(overrides=["retrieval.mode=other"])


def test_youden_over_slices(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 4), rng.random() < 0.4) for _ in range(500)]
    got = evaluate.youden_threshold(spark.createDataFrame(rows, "score double, positive boolean")).first()
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    best = max(sorted({0.0, *(s for s, _ in rows)}), key=lambda t: (round(sum(s >= t for s in pos) / len(pos) - sum(s >= t for s in neg) / len(neg), 9), -t))
    assert got["threshold"] == best


def test_round_robin_takes_whole_rounds(spark):
    rows = [(s, i) for s, n in (("a", 3), ("b", 1), ("c", 2500)) for i in range(n)]
    items = spark.createDataFrame(rows, "source string, id int")
    assert evaluate.round_robin(items, 2).count() == 5  # 3 + 2: the third round begins at 5, beyond 4
    assert evaluate.round_robin(items, 1200).count() == 2400


def test_late_interaction_by_brute_force(spark):
    rows = [("pump seal", "the seal, of a pump."), ("pump seal", ""), ("", "valve"), ("a b c", "x " * 400)]
    got = spark.createDataFrame(rows, "q string, t string").coalesce(1).select(models.late_interaction_scorer("q", "t").alias("s")).collect()
    for r, (q, t) in zip(got, rows, strict=True):
        a, b = models.token_matrix(q, True), models.token_matrix(t, False)
        assert len(b) <= models.TEXT_TOKENS and abs(np.linalg.norm(b, axis=1) - 1).max() < 1e-9
        assert abs(r["s"] - sum(max(float(x @ y) for y in b) for x in a)) < 1e-9


def test_entailment_takes_the_passage_as_premise(spark):
    def load():
        return lambda pairs: [[float(len(premise)), float(len(hypothesis)), 0.0] for premise, hypothesis in pairs]

    scorer = models.entailment_scorer(load, 0)
    row = spark.createDataFrame([("ab", "abcd")], "claim string, passage string").select(scorer(F.col("claim"), F.col("passage")).alias("s")).first()
    assert abs(row["s"] - math.exp(4) / (math.exp(4) + math.exp(2) + 1)) < 1e-9


def test_verifier_follows_the_reranker():
    assert models.verifier_of("reranker", "overlap") is models.SCORERS["overlap"] and models.verifier_of("containment", None) is models.SCORERS["containment"]
    assert models.verifier_of("reranker", None) is None and models.verifier_of(None, "overlap") is None


def test_ablation_resumes(spark, small, tmp_path, monkeypatch):
    asked, units = small
    ran, answer = [], pipeline.answer
    monkeypatch.setattr(pipeline, "answer", lambda *a: ran.append(1) or answer(*a))
    variants = {"one": ["retrieval.mode=sparse"], "two": ["retrieval.mode=sparse", "agent.decompose=false"]}
    first = pipeline.ablate({"one": variants["one"]}, asked, units, str(tmp_path), True)
    both = pipeline.ablate(variants, asked, units, str(tmp_path), True)
    assert len(ran) == 2 and first.columns == both.columns and {r["variant"] for r in both.collect()} == {"one", "two"}


def test_steps_are_timed():
    t = pipeline.Timings()
    for name in ("a", "b", "a"):
        with t.step(name):
            pass
    assert list(t.seconds) == ["a", "b"] and all(s >= 0 for s in t.seconds.values())


def test_correction_by_plain_loops(spark):
    """Weak questions are searched again with a rewrite; both rankings are fused, and old hits reranked with the new."""
    rng = random.Random(11)
    texts = {i: " ".join(rng.choices(WORDS, k=rng.randint(2, 5))) for i in range(30)}
    asked = {q: " ".join(rng.sample(WORDS, 2 + q)) for q in range(6)}
    units = spark.createDataFrame(list(texts.items()), "unit_id int, text string")
    base = ["retrieval.mode=sparse", "retrieval.top_k=3", "retrieval.fetch_k=5", "retrieval.rerank_k=6", "agent.decompose=false"]

    def score(question, unit):
        a, b = set(question.split()), set(texts[unit].split())
        return len(a & b) / len(a | b)

    def rankings(questions):
        out: dict = {}
        for r in sorted(retrieval.bm25(spark.createDataFrame(list(questions.items()), "qid int, text string"), units, 5).collect(), key=lambda r: r["rank"]):
            out.setdefault(r["qid"], []).append(r["unit_id"])
        return out

    def best(question, pool):
        return sorted(pool, key=lambda u: (-round(score(question, u), 9), u))[:3]

    first = rankings(asked)
    hits = {q: best(asked[q], ranked) for q, ranked in first.items()}
    weak = {q for q, h in hits.items() if score(asked[q], h[0]) < 0.5}
    again = rankings({q: " ".join(dict.fromkeys([*asked[q].split(), *texts[hits[q][0]].split()[:8]])) for q in weak})
    for q in weak:
        fused: dict = {}
        for weight, ranked in ((2.0, first[q]), (1.0, again[q])):
            for i, u in enumerate(ranked):
                fused[u] = fused.get(u, 0.0) + weight / (61 + i)
        found = sorted(fused, key=lambda u: (-round(fused[u], 12), u))[:6]
        hits[q] = best(asked[q], {*found, *hits[q]})
    got: dict = {}
    df = spark.createDataFrame(list(asked.items()), "qid int, text string")
    for r in sorted(pipeline.retrieve(df, units, load_config(overrides=[*base, "agent.crag=true"])).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["qid"], []).append(r["unit_id"])
    assert got == hits and 0 < len(weak) < len(asked)
