"""Text functions as column expressions: tokens, sentences, identifiers, splits, tags and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and the stop words that retrieval results depend on.
TOKEN = r"\d+(?:\.\d+)+|[a-z0-9]+"
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were "
    "will with what which who how when where why do does can should shall may must"
).split()
# The patterns of sentence ends, refusals, citation tags, "nothing missing" answers and numbered headings.
SENTENCE = r"""(?<=[.!?;])\s+(?=[A-Z("'§0-9])"""
FREE_SENTENCE = r"(?<=[.!?])\s+"
REFERENCE_SENTENCE = r"(?<=[.!?;])\s+"
REFUSAL = r"(?i)\b(not|no)\b.{0,40}\b(mention|mentioned|detailed|provided|contain|contained|found|covered|specified)\b"
CITATION = r"(?i)\[Source:\s*([^,\]]+),\s*Page:?\s*(\d+)\]"
NOTHING = r"(?i)^\W*(nothing|none|n/?a|no(thing)? (is )?missing)\b"
NUMBERED = r"^(\(?[0-9ivxIVX]+[.)]|[A-Z][.)]|§|Sec\.|Subpart|Part|Section|Chapter|Appendix)\s*\S"
# The shares of the splits, in thousandths of the key space.
SPLITS = (("train", 500), ("dev", 650), ("test", 1000))


def tokens(text: Column) -> Column:
    """Lower-case tokens without stop words; dotted section numbers stay whole."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def sentences(text: Column, pattern: str = SENTENCE) -> Column:
    return F.filter(F.split(text, pattern), lambda s: F.trim(s) != "")


def reference_sentences(text: Column) -> Column:
    """Sentences of a reference answer that have four words or more."""
    return F.filter(F.split(F.trim(text), REFERENCE_SENTENCE), lambda s: F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))) >= 4)


def index_text(section: Column, context: Column, text: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (section, context, text)])


def page_range(page: Column, page_end: Column) -> Column:
    return F.sequence(page, F.greatest(page, page_end))


def chunk_id(source: Column, page: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, page.cast("string"), text)), 1, 16)


def child_id(source: Column, page: Column, parent: Column, text: Column) -> Column:
    return chunk_id(source, page, F.concat(F.lit("child|"), parent, text))


def split_bucket(key: Column) -> Column:
    """The SHA-1 of key as an integer modulo 1000, digit group by digit group."""
    group = lambda i: F.conv(F.substr(F.sha1(key), i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.lit(0).cast("long"), lambda acc, i: (acc * F.lit(4294967296) + group(i)) % 1000)


def assign_split(key: Column) -> Column:
    bucket, out = split_bucket(key), F.lit(SPLITS[-1][0])
    for name, below in reversed(SPLITS[:-1]):
        out = F.when(bucket < below, name).otherwise(out)
    return out


def plural_stripped(text: Column) -> Column:
    """The set of tokens with their trailing s removed."""
    return F.array_distinct(F.transform(tokens(text), lambda t: F.regexp_replace(t, "s+$", "")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def is_refusal(text: Column) -> Column:
    return text.rlike(REFUSAL)


def says_nothing_missing(text: Column) -> Column:
    return text.rlike(NOTHING)


def citation_tags(text: Column) -> Column:
    """array<struct<source, page>> of the tags in text, in order."""
    sources = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.zip_with(sources, pages, lambda s, p: F.struct(F.trim(s).alias("source"), p.cast("int").alias("page")))


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, CITATION, ""))


def json_object(completion: Column) -> Column:
    """The text from the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(completion, r"(?s)\{.*\}", 0), F.lit(""))


def model_slug(name: str) -> str:
    import re

    return re.sub(r"[^a-zA-Z0-9_-]", "_", name)[-60:].strip("_-")


def is_heading(text: Column, size: Column, bold: Column, body_size: Column) -> Column:
    ends_open = text.rlike(r"[.,;:]$") & ~text.rlike(NUMBERED)
    return (F.length(text) <= 150) & ~ends_open & ((size >= body_size + 1) | (bold & (F.length(text) < 120)))


CLAIMS = "array<struct<words:array<string>,text:string,citations:array<int>>>"


def merged_claims(claims: Column, threshold: float = 0.8) -> Column:
    """claims: array of text, citations (ints). In order; one whose words are alike those of an earlier kept claim only adds its citations to the first such.

    Words are the tokens without trailing s; claims without tokens are alike none. Null stays null.
    """
    read = F.transform(claims, lambda c: F.struct(plural_stripped(c["text"]).alias("words"), c["text"].alias("text"), c["citations"].alias("citations")))

    def fold(kept: Column, c: Column) -> Column:
        alike = F.transform(kept, lambda k: jaccard(k["words"], c["words"]) >= threshold)
        at = F.array_position(alike, True)
        both = lambda k: F.array_sort(F.array_union(k["citations"], c["citations"]))
        grown = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["words"].alias("words"), k["text"].alias("text"), both(k).alias("citations"))).otherwise(k))
        return F.when(at > 0, grown).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate(read, F.array().cast(CLAIMS), fold)
    return F.transform(kept, lambda k: F.struct(k["text"].alias("text"), k["citations"].alias("citations")))
