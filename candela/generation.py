"""Generators and judges: batches of chat requests from columns, answers that must parse, and the calls of the pipeline.

A client takes a list of requests (dicts of messages, schema, max_tokens, temperature, adapter) and gives as many texts;
it is made once per worker. An answer that must be JSON and is not is asked for once more with twice the tokens; then it
is null, which the pipeline reads as "no claims", "no queries" and so on. Nothing here decides how a client is reached.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions import prompts
from candela.functions import text as T
from candela.operators import answers

Client = Callable[[list[dict]], list[str]]


def adapter_scales(adapters: list[str], adapter: str | None) -> list[dict]:
    """Only the named adapter is on; none is the base model."""
    return [{"id": i, "scale": float(name == adapter)} for i, name in enumerate(adapters)]


def chat_body(request: dict, adapters: list[str], thinking: bool = False) -> dict:
    body = {"messages": json.loads(request["messages"]), "max_tokens": request["max_tokens"], "temperature": request["temperature"], "chat_template_kwargs": {"enable_thinking": thinking}}
    if adapters:
        body["lora"] = adapter_scales(adapters, request["adapter"])
    if request["schema"]:
        body["response_format"] = {"type": "json_schema", "json_schema": {"name": "output", "schema": json.loads(request["schema"])}}
    return body


@dataclass(frozen=True)
class HttpClient:
    """A chat endpoint: one POST a request."""

    url: str
    adapters: tuple[str, ...] = ()
    timeout: float = 600.0

    def __call__(self, requests: list[dict]) -> list[str]:
        out = []
        for r in requests:
            data = json.dumps(chat_body(r, list(self.adapters))).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/v1/chat/completions", data, {"Content-Type": "application/json"}), timeout=self.timeout) as reply:
                out.append(json.load(reply)["choices"][0]["message"]["content"] or "")
        return out


def _parses(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (json.JSONDecodeError, TypeError):
        return False


def complete(client: Client, requests: list[dict]) -> list[str | None]:
    """Texts; for requests with a schema a JSON object, or null after one more try."""
    texts: list[str | None] = list(client(requests)) if requests else []
    again = [i for i, r in enumerate(requests) if r["schema"] and not _parses(texts[i])]
    if again:
        for i, text in zip(again, client([{**requests[i], "max_tokens": 2 * requests[i]["max_tokens"]} for i in again]), strict=True):
            texts[i] = text if _parses(text) else None
    return texts


@dataclass(frozen=True)
class Generator:
    """Completions as a column. load makes the client, once per worker."""

    load: Callable[[], Client]

    def __call__(self, messages: Column, schema: str | None = None, max_tokens: int = 512, temperature: float = 0.1, adapter: str | None = None) -> Column:
        load = self.load

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = load()
            for batch in batches:
                rows = [{"messages": m, "schema": schema, "max_tokens": max_tokens, "temperature": temperature, "adapter": adapter} for m in batch]
                yield pd.Series(complete(client, rows), index=batch.index, dtype=object)

        return run.asNondeterministic()(messages)


@dataclass
class Agents:
    """The pipeline's calls by a generator; the same names and columns as the stand-ins of `models`."""

    generate: Generator
    max_tokens: int = 512
    temperature: float = 0.1
    evidence_first: bool = False
    adapters: dict[str, str] = field(default_factory=lambda: {"decompose": "decompose", "answer": "answer"})

    def route(self, question: Column) -> Column:
        return F.coalesce(F.get_json_object(self.generate(prompts.route(question), prompts.ROUTE, 20, 0.0), "$.action"), F.lit("SEARCH"))

    def split_question(self, question: Column, most: int = 3) -> Column:
        queries = answers.parse_queries(self.generate(prompts.decompose(question, most), prompts.QUERIES, 300, 0.0, self.adapters.get("decompose")))
        return F.coalesce(distinct_queries(question, queries, most), F.array().cast("array<string>"))

    def missing_tokens(self, question: Column, texts: Column) -> Column:
        said = F.from_json(self.generate(prompts.next_search(question, texts), prompts.NEXT, 150, 0.0), "missing string, query string")
        return let(said, lambda s: follow_up_query(question, s["missing"], s["query"]))

    def rewritten(self, question: Column, texts: Column, sections: Column | None = None) -> Column:
        seen = F.lit("") if sections is None else prompts.sections_seen(sections)
        return F.coalesce(F.trim(F.get_json_object(self.generate(prompts.rewrite(question, seen), prompts.QUERY, 120, 0.0), "$.query")), question)

    def extractive_answer(self, question: Column, passages: Column) -> Column:
        return self.grounded(question, passages)

    def corrected_answer(self, question: Column, passages: Column) -> Column:
        return self.grounded(question, passages)

    def grounded(self, question: Column, passages: Column, feedback: Column | None = None) -> Column:
        """passages: array of rank, text. A completion for parse_claims; null where none could be had."""
        shown = F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), p["rank"].cast("string"), F.lit("]\n"), p["text"])), "\n\n")
        return self.generate(prompts.grounded(question, shown, feedback, self.evidence_first), prompts.CLAIMS, self.max_tokens, self.temperature, self.adapters.get("answer"))

    def answer_directly(self, question: Column) -> Column:
        return self.generate(prompts.messages(("user", question)), None, self.max_tokens, 0.3)

    def freetext(self, question: Column, passages: Column) -> Column:
        return self.generate(prompts.freetext(question, passages), None, self.max_tokens, self.temperature)

    def situate(self, excerpt: Column, passage: Column) -> Column:
        return F.trim(self.generate(prompts.situate(excerpt, passage), None, 100, 0.0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it: a generator's answer is no plain expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_queries(question: Column, queries: Column, most: int) -> Column:
    """Queries but for the question itself and repeats, in any case and with any outer blanks; at most `most`."""
    plain = lambda q: F.lower(F.trim(q))

    def fold(kept: Column, q: Column) -> Column:
        known = (plain(q) == "") | (plain(q) == plain(question)) | F.exists(kept, lambda k: plain(k) == plain(q))
        return F.when(known | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(F.trim(q))))

    return F.aggregate(queries, F.array().cast("array<string>"), fold)


def follow_up_query(question: Column, missing: Column, query: Column) -> Column:
    """The next search; null where nothing is missing, no query is given, or it repeats the question."""
    asked = F.trim(query)
    repeats = F.lower(asked) == F.lower(F.trim(question))
    return F.when(~T.says_nothing_missing(F.trim(F.coalesce(missing, F.lit("")))) & (F.coalesce(asked, F.lit("")) != "") & ~repeats, asked)


@dataclass(frozen=True)
class Judge:
    """Grades by a generator; null where no grade could be had."""

    generate: Generator

    def correctness(self, question: Column, reference: Column, answer: Column) -> Column:
        from candela.operators.evaluate import verdict_score

        return verdict_score(F.get_json_object(self.generate(prompts.correctness(question, reference, answer), prompts.VERDICT, 300, 0.0), "$.verdict"))

    def faithfulness(self, claims: Column) -> Column:
        """claims: array of text, citations, passages. The share of claims that their passages support; uncited ones are not."""
        cited = F.filter(claims, lambda c: F.size(c["citations"]) > 0)
        out = self.generate(prompts.faithfulness(cited), prompts.SUPPORTED, 300, 0.0)
        votes = F.from_json(F.get_json_object(out, "$.supported"), "array<boolean>")
        share = let(votes, lambda v: F.when(F.size(v) == F.size(cited), F.size(F.filter(v, lambda x: x)) / F.size(claims)))
        return F.when(F.size(claims) > 0, F.when(F.size(cited) == 0, 0.0).otherwise(share))

    def answered(self, question: Column, texts: Column) -> Column:
        return F.get_json_object(self.generate(prompts.answered(question, texts), prompts.ANSWERED, 20, 0.0), "$.answered")


def unanswerable_only(items: DataFrame, hits: DataFrame, judge: Judge) -> DataFrame:
    """items: id, question, answerable, ...; hits: id, rank, text (the best ten). Answerable items, and others whose passages answer nothing."""
    found = hits.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts_"))
    open_items = items.where("not answerable").join(found, "id", "left").withColumn("texts_", F.coalesce("texts_", F.array().cast("array<string>")))
    kept = open_items.withColumn("said_", judge.answered(F.col("question"), F.col("texts_"))).where("said_ = 'no'")
    return items.where("answerable").unionByName(kept.select(*items.columns))
