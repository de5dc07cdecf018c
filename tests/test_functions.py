import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candela.config import flat, load_config
from candela.functions import text as T
from candela.functions.folds import split_pieces, split_table_rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["The", "and", "4.2.1", "Pump", "valve-7", "(x)", "3.", ".5", "EU", "it's", "Straße", "of"]), max_size=12))
def test_tokens_by_brute_force(spark, words):
    text = " ".join(words)
    found = [t for t in re.findall(T.TOKEN, text.lower(), re.ASCII) if t not in T.STOP_WORDS]
    assert one(spark, T.tokens(F.lit(text))) == found
    assert one(spark, T.plural_stripped(F.lit(text))) == list(dict.fromkeys(t.rstrip("s") for t in found))


def test_splits_by_brute_force(spark):
    keys = [f"doc {i}|{i % 9}" for i in range(400)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", T.assign_split(F.col("k")).alias("s"), T.split_bucket(F.col("k")).alias("b")).collect()
    for r in rows:
        bucket = int(hashlib.sha1(r["k"].encode()).hexdigest(), 16) % 1000
        assert r["b"] == bucket and r["s"] == next(name for name, below in T.SPLITS if bucket < below)
    assert {r["s"] for r in rows} == {"train", "dev", "test"}


def test_refusals_and_nothing_missing(spark):
    assert one(spark, T.is_refusal(F.lit("It is NOT, as far as we see, specified anywhere")))
    assert not one(spark, T.is_refusal(F.lit("Notified bodies found two leaks")))
    assert one(spark, T.says_nothing_missing(F.lit("  Nothing is missing")))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=25), st.integers(30, 150), st.floats(0, 0.9))
def test_pieces_hold_every_sentence_in_order(lengths, size, share):
    """Pieces are runs of whole sentences or strides of one that is too long; each begins within or right behind the one before."""
    overlap = int(size * share)
    sentences = [f"Q{i}" + "z" * n + "." for i, n in enumerate(lengths)]
    pieces = split_pieces(" ".join(sentences), size, overlap)
    if len(" ".join(sentences)) <= size:
        assert pieces == [" ".join(sentences)]
        return
    seen: set[int] = set()
    for p in pieces:
        held = [i for i, s in enumerate(sentences) if s in p]
        if held:
            assert held == list(range(held[0], held[-1] + 1)) and all(i in seen or len(sentences[i]) > size for i in range(held[0]))
            seen |= set(held)
        assert len(p) <= size + overlap + 1
    for i, s in enumerate(sentences):
        assert i in seen or len(s) > size and s[:size] in pieces


def test_pieces_of_an_endless_sentence():
    assert split_pieces("k" * 130, 60, 15) == ["k" * 60, "k" * 60, "k" * 40]
    for bad in (60, 61, -1):
        with pytest.raises(ValueError):
            split_pieces("k", 60, bad)
    assert split_pieces("", 60, 15) == [""]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(20, 120))
def test_table_pieces_repeat_the_header(widths, size):
    head = "| key |\n| --- |"
    rows = [f"| {'v' * w}{i} |" for i, w in enumerate(widths)]
    pieces = split_table_rows("\n".join([head, *rows]), size)
    assert all(p.startswith(head) for p in pieces)
    assert [r for p in pieces for r in p.splitlines()[2:]] == rows
    assert all(len(p) <= size or p.count("\n") == 2 for p in pieces)


def merged(claims):
    """By pairs: a claim joins the first earlier kept one that is alike."""
    words = [{t.rstrip("s") for t in re.findall(T.TOKEN, c[0].lower(), re.ASCII) if t not in T.STOP_WORDS} for c in claims]
    home: dict[int, int] = {}
    for i, w in enumerate(words):
        alike = [j for j in range(i) if home[j] == j and w | words[j] and len(w & words[j]) / len(w | words[j]) >= 0.8]
        home[i] = alike[0] if alike else i
    kept = [i for i in home if home[i] == i]
    return [(claims[i][0], sorted({x for j in home if home[j] == i for x in claims[j][1]}) if sum(h == i for h in home.values()) > 1 else claims[i][1]) for i in kept]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("dose doses limit 5.2 5.3 mg the daily per valve valves".split()), max_size=6).map(" ".join), st.lists(st.integers(1, 5), min_size=1, max_size=3, unique=True)), max_size=7))
def test_claims_merge_by_brute_force(spark, claims):
    df = spark.createDataFrame([(claims,)], "c array<struct<text:string,citations:array<int>>>")
    got = [(c["text"], c["citations"]) for c in df.select(T.merged_claims(F.col("c")).alias("m")).first()["m"]]
    assert got == merged(claims)


def test_claims_differ_by_their_numbers(spark):
    claims = [("dose of section 11.25", [2]), ("dose of section 11.26", [1]), ("The dose of sections 11.25", [4, 3])]
    df = spark.createDataFrame([(claims,), (None,)], "c array<struct<text:string,citations:array<int>>>")
    rows = [r["m"] for r in df.select(T.merged_claims(F.col("c")).alias("m")).collect()]
    assert [(c["text"], c["citations"]) for c in rows[0]] == [("dose of section 11.25", [2, 3, 4]), ("dose of section 11.26", [1])] and rows[1] is None


def test_config_is_strict():
    config = load_config(overrides=["retrieval.mode=dense", "agent.decompose=false", "retrieval.reranker=null"])
    assert (config.retrieval.mode, config.agent.decompose, config.retrieval.reranker) == ("dense", False, None)
    assert flat(config)["retrieval.k1"] == 1.5
    with pytest.raises(KeyError):
        load_config(overrides=["retrieval.nope=1"])
    with pytest.raises(ValueError):
        load_config(overrides=["ingest.chunk_overlap=1200"])
