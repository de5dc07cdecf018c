"""Prompts as columns: each gives the chat messages as a JSON string, and each kind of answer has a JSON schema."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _schema(**properties: dict) -> str:
    return json.dumps({"type": "object", "properties": properties, "required": list(properties)})


_TEXT = {"type": "string"}
_TEXTS = {"type": "array", "items": _TEXT}

#: The fields that answers are read by, and the words of routes and verdicts.
ROUTE = _schema(action={"type": "string", "enum": ["SEARCH", "ANSWER_DIRECTLY"]})
QUERIES = _schema(queries=_TEXTS)
QUERY = _schema(query=_TEXT)
NEXT = _schema(missing=_TEXT, query=_TEXT)
CLAIMS = _schema(claims={"type": "array", "items": {"type": "object", "properties": {"text": _TEXT, "citations": {"type": "array", "items": {"type": "integer"}}}, "required": ["text", "citations"]}})
QUESTION = _schema(usable={"type": "boolean"}, question=_TEXT, answer=_TEXT)
QUESTION_OF_TWO = _schema(usable={"type": "boolean"}, needs_both={"type": "boolean"}, question=_TEXT, answer=_TEXT)
QUESTIONS = _schema(questions=_TEXTS)
ANSWERED = _schema(answered={"type": "string", "enum": ["fully", "partially", "no"]})
VERDICT = _schema(verdict={"type": "string", "enum": ["correct", "partially_correct", "incorrect"]})
SUPPORTED = _schema(supported={"type": "array", "items": {"type": "boolean"}})


def messages(*turns: tuple[str, Column]) -> Column:
    """(role, content) turns as a JSON array of messages."""
    return F.to_json(F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content")) for role, content in turns]))


def _user(*parts: Column | str) -> Column:
    return messages(("user", F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])))


def route(question: Column) -> Column:
    return _user("Decide what the message below needs. SEARCH: it asks for something that documents could tell. ANSWER_DIRECTLY: it is a greeting, thanks or small talk.\n\nMessage: ", question)


def decompose(question: Column, most: int = 3) -> Column:
    return _user(f"Split the question into at most {most} search queries that stand alone and together cover it. A simple question needs none but itself.\n\nQuestion: ", question)


def rewrite(question: Column, sections: Column) -> Column:
    """sections: the last parts of the section paths of the best hits, see sections_seen()."""
    return _user("These sections were found and do not answer the question: ", F.when(F.coalesce(sections, F.lit("")) == "", "none of use").otherwise(sections), ".\nWrite one other search query, in the words such documents would use.\n\nQuestion: ", question)


def next_search(question: Column, texts: Column) -> Column:
    """texts: array of passage texts; the first 700 characters of each are shown."""
    shown = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(t, 1, 700))), "\n\n")
    return _user("Passages:\n", shown, "\n\nIn \"missing\" say what the question asks that no passage tells, or \"nothing\". In \"query\" give one search for it, or leave it empty.\n\nQuestion: ", question)


GROUNDED = "Answer only from the numbered passages, as claims that each cite the numbers of the passages that state them. Where no passage helps, give no claims."


def grounded(question: Column, passages: Column, feedback: Column | None = None, evidence_first: bool = False) -> Column:
    """passages: the formatted, numbered passages; feedback: bullets of claims that failed a check."""
    system = GROUNDED + (" First list the sentences that help, word for word, with their passage numbers, as \"evidence\"." if evidence_first else "")
    user = [F.lit("Passages:\n"), passages]
    if feedback is not None:
        user += [F.when(F.coalesce(feedback, F.lit("")) != "", F.concat(F.lit("\n\nThese claims of an earlier answer were not supported; leave them out or correct them:\n"), feedback)).otherwise("")]
    return messages(("system", F.lit(system)), ("user", F.concat(*user, F.lit("\n\nQuestion: "), question)))


def freetext(question: Column, passages: Column) -> Column:
    """passages: array of source, page, text; each stands under the tag that an answer is to copy."""
    tagged = F.array_join(F.transform(passages, lambda p: F.concat(F.lit("[Source: "), p["source"], F.lit(", Page: "), p["page"].cast("string"), F.lit("] "), p["text"])), "\n\n---\n\n")
    return messages(("system", F.lit("Answer only from the context. Behind each statement copy the tag of its passage. Say so where the context is not enough.")), ("user", F.concat(F.lit("Context:\n"), tagged, F.lit("\n\nQuestion: "), question)))


def situate(excerpt: Column, passage: Column) -> Column:
    return _user("Document:\n", excerpt, "\n\nPassage from it:\n", passage, "\n\nSay in one or two sentences where in the document the passage stands and what it is about. Give those sentences alone.")


def question_of(source: Column, section: Column, text: Column, style: Column) -> Column:
    return _user("Write a question of the kind \"", style, "\" that the passage alone answers, and its answer. usable is false where it states nothing worth asking.\n\nFrom ", source, ", section ", F.when(F.coalesce(section, F.lit("")) == "", "-").otherwise(section), ":\n", text)


def question_of_two(kind: Column, a: Column, b: Column) -> Column:
    """a, b: structs of source, section, text."""
    side = lambda p: F.concat(F.lit("From "), p["source"], F.lit(", section "), F.when(F.coalesce(p["section"], F.lit("")) == "", "-").otherwise(p["section"]), F.lit(":\n"), p["text"])
    return _user("Write a ", kind, " question that needs both passages, and its answer. needs_both is false where one would do.\n\nPassage A. ", side(a), "\n\nPassage B. ", side(b))


def unanswerable(sources: Column, avoid: Column) -> Column:
    return _user("Write five questions near the topics of these documents that they do not answer: ", sources, ".", F.when(F.coalesce(avoid, F.lit("")) != "", F.concat(F.lit(" Not again about: "), avoid)).otherwise(""))


def answered(question: Column, texts: Column) -> Column:
    return _user("Passages:\n", F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n\n"), "\n\nDo they answer the question fully, partially or not (no)?\n\nQuestion: ", question)


def correctness(question: Column, reference: Column, answer: Column) -> Column:
    return _user("Grade the answer against the reference: correct, partially_correct or incorrect. A refusal is incorrect.\n\nQuestion: ", question, "\nReference: ", reference, "\nAnswer: ", answer)


def faithfulness(claims: Column) -> Column:
    """claims: array of text, passages (array of texts), cited ones only."""
    listing = F.array_join(F.transform(claims, lambda c, i: F.concat(F.lit("Claim "), (i + 1).cast("string"), F.lit(": "), c["text"], F.lit("\nPassages:\n"), F.array_join(F.transform(c["passages"], lambda p: F.concat(F.lit("  - "), p)), "\n"))), "\n\n")
    return _user("For each claim: do its passages state or imply it?\n\n", listing)


def sections_seen(sections: Column, most: int = 400) -> Column:
    """sections: array of section paths of the best five hits. Their distinct last parts, sorted and joined."""
    last = F.transform(F.filter(F.slice(sections, 1, 5), lambda s: F.coalesce(s, F.lit("")) != ""), lambda s: F.element_at(F.split(s, " > "), -1))
    return F.substring(F.array_join(F.array_sort(F.array_distinct(last)), "; "), 1, most)
