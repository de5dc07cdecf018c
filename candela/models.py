"""Model calls as column functions, with deterministic stand-ins.

A scorer maps (question or claim, text) to a double column; a generator maps (question, passages) to a JSON completion
column. Real models take the same places as Arrow UDFs (`pandas_scorer`).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from candela.functions import text as T
from candela.operators.retrieval import containment_scorer, overlap_scorer

SCORERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap_scorer, "containment": containment_scorer}


def verifier_of(verifier: str | None, reranker: str | None) -> Callable[[Column, Column], Column] | None:
    """The scorer that checks claims: a named one, or the reranker's own; without a reranker there is then none."""
    name = reranker if verifier == "reranker" else verifier
    return None if name is None else SCORERS[name]


def pandas_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer around a model that is loaded once per worker and scores batches of pairs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(list(zip(a, b, strict=True))), dtype="float64")

    return run


def grouped_scores(candidates: DataFrame, load: Callable[[], Callable[[str, list[str]], list[float]]]) -> DataFrame:
    """candidates: qid, unit_id, question, text. qid, unit_id, score of a model that scores all texts of a question in one call."""
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("qid", "unit_id")}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group[["qid", "unit_id"]].assign(score=load()(group["question"].iloc[0], group["text"].tolist()))

    return candidates.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, unit_id {kinds['unit_id']}, score double")


def entailment_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[list[float]]]], entails: int) -> Callable[[Column, Column], Column]:
    """A scorer (claim, passage) around a model of (premise, hypothesis) logits: the passage is the premise; the softmax share of the class that entails."""

    def model() -> Callable[[list[tuple[str, str]]], list[float]]:
        logits = load()

        def score(pairs: list[tuple[str, str]]) -> list[float]:
            x = np.asarray(logits([(b, a) for a, b in pairs]), float)
            e = np.exp(x - x.max(axis=1, keepdims=True))
            return (e[:, entails] / e.sum(axis=1)).tolist()

        return score

    return pandas_scorer(model)


def extractive_answer(question: Column, passages: Column) -> Column:
    """A stand-in for a grounded generator: the first sentence of each passage that shares a token with the question, cited."""
    asked = F.array_distinct(T.tokens(question))
    claim = lambda p: F.get(F.filter(T.sentences(p["text"]), lambda s: F.arrays_overlap(T.tokens(s), asked)), F.lit(0))
    claims = F.filter(F.transform(passages, lambda p: F.struct(claim(p).alias("text"), F.array(p["rank"]).alias("citations"))), lambda c: c["text"].isNotNull())
    return F.to_json(F.struct(claims.alias("claims")))


def split_question(question: Column, most: int = 3) -> Column:
    """A stand-in for a decomposer: the question's sentences, when there are several."""
    parts = T.sentences(question, T.REFERENCE_SENTENCE)
    return F.when(F.size(parts) > 1, F.slice(F.array_distinct(parts), 1, most)).otherwise(F.array().cast("array<string>"))


def route(question: Column) -> Column:
    """A stand-in for a router: greetings and thanks are answered directly, all else is searched."""
    return F.when(question.rlike(r"(?i)^\W*(hi|hello|hey|thanks|thank you)\b\W*$"), "ANSWER_DIRECTLY").otherwise("SEARCH")


def missing_tokens(question: Column, texts: Column) -> Column:
    """A stand-in for naming what is missing: the question's tokens that no passage has; null where none is missing."""
    left = F.array_except(F.array_distinct(T.tokens(question)), F.flatten(F.transform(texts, T.tokens)))
    return F.nullif(F.array_join(left, " "), F.lit(""))


def rewritten(question: Column, texts: Column) -> Column:
    """A stand-in for a rewriter: the question's tokens, then the first eight of the best passage."""
    return F.array_join(F.array_distinct(F.concat(T.tokens(question), F.slice(T.tokens(F.get(texts, F.lit(0))), 1, 8))), " ")


def corrected_answer(question: Column, passages: Column) -> Column:
    """A stand-in for a second generation: from each passage the sentence that shares most tokens with the question, cited."""
    asked = F.array_distinct(T.tokens(question))
    scored = lambda p: F.transform(T.sentences(p["text"]), lambda s, i: F.struct(F.size(F.array_intersect(T.tokens(s), asked)).alias("n"), (-i).alias("i"), s.alias("s")))
    claims = F.transform(passages, lambda p: F.struct(F.array_max(scored(p)).alias("best"), F.array(p["rank"]).alias("citations")))
    told = F.transform(F.filter(claims, lambda c: c["best"]["n"] > 0), lambda c: F.struct(c["best"]["s"].alias("text"), c["citations"]))
    return F.to_json(F.struct(told.alias("claims")))


DIMENSIONS = 64


@F.pandas_udf(ArrayType(DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    """A stand-in for an embedder: signed token hashes summed into DIMENSIONS and scaled to length one, over the whole text."""
    token, stop = re.compile(T.TOKEN, re.ASCII), set(T.STOP_WORDS)

    def one(text: str | None) -> np.ndarray:
        hashes = np.array([zlib.crc32(t.encode()) for t in token.findall((text or "").lower()) if t not in stop], np.int64)
        v = np.bincount(hashes % DIMENSIONS, weights=1.0 - 2.0 * ((hashes >> 16) & 1), minlength=DIMENSIONS) if len(hashes) else np.zeros(DIMENSIONS)
        return v / (np.sqrt((v * v).sum()) or 1.0)

    return texts.map(one)


#: What the stand-in says where no search is needed.
DIRECT_ANSWER = "How can I help with the documents?"


#: Fixed for the stand-in of a token encoder: prefixes, the longest question and text in tokens, and words of texts that are skipped.
QUERY_PREFIX, TEXT_PREFIX, QUERY_TOKENS, TEXT_TOKENS, SKIPPED = "[q]", "[d]", 32, 300, frozenset(".,;:!?()[]\"'-")


def token_matrix(text: str | None, is_query: bool) -> np.ndarray:
    """A row of length one for each token behind the prefix, cut at the longest; a stand-in for a late-interaction encoder, by hashes."""
    prefix, most = (QUERY_PREFIX, QUERY_TOKENS) if is_query else (TEXT_PREFIX, TEXT_TOKENS)
    words = [prefix, *re.findall(r"\w+|[^\w\s]", (text or "").lower())][:most]
    if not is_query:
        words = [w for w in words if w not in SKIPPED]
    rows = np.array([np.random.default_rng(zlib.crc32(w.encode())).standard_normal(DIMENSIONS) for w in words])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@F.pandas_udf(DoubleType())
def late_interaction_scorer(question: pd.Series, text: pd.Series) -> pd.Series:
    """For each token of the question its best token of the text, summed."""
    asked = {q: token_matrix(q, True) for q in question.unique()}
    return pd.Series([float((asked[q] @ token_matrix(t, False).T).max(axis=1).sum()) for q, t in zip(question, text, strict=True)], dtype="float64")


SCORERS["late_interaction"] = late_interaction_scorer
