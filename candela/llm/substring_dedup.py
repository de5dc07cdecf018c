"""Substring dedup with a compressed FM-index per shard.

A window is `window` consecutive words of one document. A word goes if a window covers it whose words also stand in a
document with a smaller doc_id. Shards are cut by content, so that every occurrence of a window meets in one shard and
work grows with the text, not with documents times shards:

1. Each window has an anchor, the smallest hash of the 12-word grams in it. Consecutive windows with one anchor form a
   segment. Anchors seen in a single document are dropped; they cannot repeat.
2. Equal segments are collapsed to one with its smallest doc_id, before the shuffle. Anchors that still have very many
   different segments are cut into single windows and dealt by these, so none outgrows a shard.
3. A shard builds an FM-index over the recurring windows that first owners hold and streams its segments through
   backward search over the index's wavelet tree. Matches of at least a window with a smaller owner are reported as
   intervals, those of segments that several documents share too. Hashes only choose candidates; the search compares
   words, and nothing is removed without it.
4. Intervals are gathered per document and its words are dropped.

Cases: null text has no words. Rows without doc_id take no part and lose nothing. Rows that share a doc_id are not
smaller than each other; each is judged on its own text. An empty table gives an empty result; extra columns are
ignored. Texts of any length are taken whole. Document ids are whole numbers of at most 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import bounded, discard, durable, hot_join, shards_for, text_or_empty, written
from candela.llm.fm_index import FMIndex, matched_windows

WINDOW, GRAM = 50, 12
#: Segments a shard should hold, windows a segment may have, and different segments of one anchor that count as hot.
SHARD_SEGMENTS, SEGMENT_WINDOWS, HOT_SEGMENTS = 8_000, 64, 4_000
#: Rows up to which this operator broadcasts; low, so that plans are the same for small and large tables.
SMALL = 10_000
BLOCK_BYTES = 1 << 20
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes, at its first word."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    size = 1 << (n + 1).bit_length()
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words * _powers(FACTOR, size)[:n], dtype=np.uint64)]
    return _mixed((sums[k:] - sums[:-k]) * _powers(INVERSE, size)[: n - k + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = width - span
    return (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def segments(lengths: np.ndarray, words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor over documents of these lengths: document, first word in it, windows, anchor."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    anchors = _sliding_min(gram_hashes(words, gram), window - gram + 1)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    whole = np.arange(len(anchors)) + window <= ends[doc[: len(anchors)]] if len(anchors) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    a, d = anchors[at], doc[at]
    first = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]
    run = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
    run = np.flatnonzero(place % SEGMENT_WINDOWS == 0)  # long runs of one anchor are cut
    return d[run], at[run] - begins[d[run]], np.diff(np.r_[run, len(at)]), a[run]


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Blocks of consecutive rows as word lists, with the first row's number; blocks are bounded in bytes."""
    block, held, begin = [], 0, 0
    for i, value in enumerate(batch.column(column).cast(pa.binary())):
        text = value.as_py()
        if block and held + len(text) > BLOCK_BYTES:
            yield begin, block
            block, held, begin = [], 0, i
        block.append(text.split())
        held += len(text)
    if block:
        yield begin, block


def _flat(block: list[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
    return np.array([len(w) for w in block], np.int64), [w for ws in block for w in ws]


def _digests(source: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, text_hash, n_words, all_sha256 and the anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, block in _texts(batch, "text"):
                lengths, words = _flat(block)
                doc, _, _, anchor = segments(lengths, _hashed(words), window, gram)
                offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(block)))]
                rows = batch.slice(begin, len(block))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(anchor.view(np.int64)))
                shas = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in block])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(lengths), shas, lists], names=["doc_id", "text_hash", "n_words", "all_sha256", "anchors"])

    return source.mapInArrow(run, f"{_keys(source)}, n_words long, all_sha256 string, anchors array<long>")


def _keys(source: DataFrame) -> str:
    return f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash long"


def _segment_rows(source: DataFrame, window: int, gram: int) -> DataFrame:
    """The segments of each row whose anchor is in its column `shared`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, block in _texts(batch, "text"):
                lengths, words = _flat(block)
                doc, start, windows, anchor = segments(lengths, _hashed(words), window, gram)
                rows = batch.slice(begin, len(block))
                lists = rows.column("shared")
                wanted = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(len(block)), np.diff(lists.offsets.to_numpy()))
                # Membership of (document, anchor): both sides as pairs, found by sorted search within the document.
                order = np.lexsort((wanted, owner))
                pairs = np.empty(len(order), dtype=[("d", "<i8"), ("a", "<u8")])
                pairs["d"], pairs["a"] = owner[order], wanted[order]
                mine = np.empty(len(doc), dtype=pairs.dtype)
                mine["d"], mine["a"] = doc, anchor
                keep = np.flatnonzero(_contains(pairs, mine))
                doc, start, windows, anchor = (x[keep] for x in (doc, start, windows, anchor))
                texts = [b" ".join(block[d][s : s + m + window - 1]) for d, s, m in zip(doc.tolist(), start.tolist(), windows.tolist(), strict=True)]
                taken = rows.take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([taken.column("doc_id"), taken.column("text_hash"), pa.array(anchor.view(np.int64)), pa.array(start), pa.array(windows), pa.array(texts, pa.binary())], names=["doc_id", "text_hash", "anchor", "start", "windows", "segment"])

    return source.mapInArrow(run, f"{_keys(source)}, anchor long, start long, windows long, segment binary")


def _contains(pairs: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Whether each of mine is in pairs: one unique numbering of both."""
    both = np.concatenate([pairs, mine])
    ids = np.unique(both["a"], return_inverse=True)[1].astype(np.int64)
    key = both["d"] * (len(both) + 1) + ids
    return np.isin(key[len(pairs) :], key[: len(pairs)])


def _single_windows(rows: DataFrame, window: int) -> DataFrame:
    """Segments cut into their windows, each with its own anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                row, texts = [], []
                for i, s in enumerate(part.column("segment")):
                    words = s.as_py().split()
                    texts += [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
                    row += [i] * (len(words) - window + 1)
                taken = part.take(pa.array(row, pa.int64()))
                first = np.r_[True, np.diff(row) != 0] if row else np.zeros(0, bool)
                begins = np.flatnonzero(first)
                place = np.arange(len(row)) - np.repeat(begins, np.diff(np.r_[begins, len(row)])) if row else np.zeros(0, np.int64)
                anchor = _hashed(texts).view(np.int64)
                yield pa.RecordBatch.from_arrays([taken.column("doc_id"), taken.column("text_hash"), pa.array(anchor), pa.array(taken.column("start").to_numpy() + place), pa.array(np.ones(len(row), np.int64)), pa.array(texts, pa.binary())], names=["doc_id", "text_hash", "anchor", "start", "windows", "segment"])

    return rows.mapInArrow(run, rows.schema)


Intervals = list[list[tuple[int, int]]]


def shard_intervals(segs: list[bytes], lows: np.ndarray, highs: np.ndarray, window: int = WINDOW) -> tuple[Intervals, Intervals]:
    """For each distinct segment, the intervals of its words that stand in windows of a smaller document, by backward search.

    A segment's documents run from low to high. The first intervals are repeated from below low and hold for all of its
    documents; the second are first seen in low and hold for the others.
    """
    split = [s.split() for s in segs]
    lengths = np.array([len(w) for w in split], np.int64)
    numbers: dict[bytes, int] = {}
    text = np.array([numbers.setdefault(w, len(numbers) + 2) for ws in split for w in ws], np.int64)
    begins = np.cumsum(lengths) - lengths
    seg_of = np.repeat(np.arange(len(segs)), lengths)
    earlier: Intervals = [[] for _ in segs]
    copied: Intervals = [[] for _ in segs]
    hashes = gram_hashes(_mixed(text.astype(np.uint64)), window)
    at = np.flatnonzero(np.arange(len(hashes)) + window <= (begins + lengths)[seg_of[: len(hashes)]]) if len(hashes) else np.zeros(0, np.int64)
    if not len(at):
        return earlier, copied
    group = np.unique(hashes[at], return_inverse=True)[1]
    low, high = lows[seg_of[at]], highs[seg_of[at]]
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, low)
    wanted = np.zeros(len(least), bool)
    wanted[group[high > least[group]]] = True  # windows that may recur; only these are indexed
    if not wanted.any():
        return earlier, copied
    holds = (low == least[group]) & wanted[group]  # their first owners

    def runs(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = at[which]
        cut = np.flatnonzero(np.r_[True, (np.diff(w) != 1) | (np.diff(seg_of[w]) != 0)]) if len(w) else np.zeros(0, np.int64)
        last = np.r_[cut[1:], len(w)] - 1 if len(w) else cut
        return w[cut], w[last] + window, seg_of[w[cut]]

    a, b, s = runs(np.flatnonzero(holds))
    pieces = [text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    used = np.unique(np.concatenate(pieces))
    dense = np.zeros(len(numbers) + 2, np.int64)
    dense[used] = np.arange(2, len(used) + 2)
    index = FMIndex([dense[p] for p in pieces], lows[s], len(used) + 2)
    text = dense[text]

    def search(which: np.ndarray, below: int, out: Intervals) -> None:
        a, b, s = runs(np.flatnonzero(which))
        hit = np.flatnonzero(matched_windows(index, text, a, b, lows[s] + below, window))
        if not len(hit):
            return
        cut = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(seg_of[hit]) != 0)])
        last = np.r_[cut[1:], len(hit)] - 1
        for i, j in zip(hit[cut].tolist(), hit[last].tolist(), strict=True):
            k = int(seg_of[i])
            out[k].append((i - int(begins[k]), j - int(begins[k]) + window))

    search(low > least[group], 0, earlier)
    search((low == least[group]) & (high > low), 1, copied)
    return earlier, copied


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) for each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    keys = ["doc_id", "text_hash"]
    digests = durable(_digests(source, window, gram))
    anchors = digests.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = durable(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"))
    lists = hot_join(anchors, shared, ["anchor"], shared.count(), F.col("doc_id"), limit=SMALL).groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    rows = _segment_rows(source.join(lists, "doc_id"), window, gram)
    ids = [F.xxhash64("segment").alias("id"), F.xxhash64(F.lit(1), "segment").alias("id2")]
    rows, path = written(rows.select("*", *ids))
    # Anchors with very many different segments are dealt window by window.
    hot = durable(rows.select("anchor", "id", "id2").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_segments).select("anchor"))
    if n_hot := hot.count():
        cut = _single_windows(rows.join(bounded(hot, n_hot), "anchor", "left_semi").select("doc_id", "text_hash", "anchor", "start", "windows", "segment"), window)
        rows = rows.join(bounded(hot, n_hot), "anchor", "left_anti").unionByName(durable(cut.select("*", *ids)))
    distinct = rows.groupBy("anchor", "id", "id2", "segment").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shards = shards_for(rows.select("id", "id2").distinct().count(), shard_segments)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        earlier, copied = shard_intervals([bytes(s) for s in group["segment"]], group["low"].to_numpy(np.int64), group["high"].to_numpy(np.int64), window)
        keep = np.array([bool(e or c) for e, c in zip(earlier, copied, strict=True)], bool)
        out = group.loc[keep, ["id", "id2", "low"]].copy()
        for name, found, at in (("begins", earlier, 0), ("ends", earlier, 1), ("copy_begins", copied, 0), ("copy_ends", copied, 1)):  # object columns also where there are no rows
            out[name] = pd.Series([[x[at] for x in f] for f, k in zip(found, keep, strict=True) if k], index=out.index, dtype=object)
        return out

    verdicts = durable(
        distinct.withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(7)), F.lit(shards)))
        .groupBy("shard").applyInPandas(search, "id long, id2 long, low long, begins array<long>, ends array<long>, copy_begins array<long>, copy_ends array<long>")
    )
    marks = hot_join(rows.select(*keys, "start", "id", "id2"), verdicts, ["id", "id2"], verdicts.count(), F.struct("doc_id", "start"), limit=SMALL)
    earlier, copied = (F.zip_with(b, e, lambda b, e: F.struct((F.col("start") + b).alias("b"), (F.col("start") + e).alias("e"))) for b, e in (("begins", "ends"), ("copy_begins", "copy_ends")))
    gone = durable(
        marks.select(*keys, F.explode(F.when(F.col("doc_id") > F.col("low"), F.concat(earlier, copied)).otherwise(earlier)).alias("x"))
        .groupBy(*keys).agg(F.collect_set("x").alias("gone"))
    )
    discard(docs.sparkSession, path)
    changed = durable(_without(source.join(gone, keys)))
    return digests.join(changed, keys, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha256", "all_sha256").alias("kept_sha256"),
    )


def kept_words(words: list[bytes], begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, begins, 1)
    np.add.at(depth, ends, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _without(source: DataFrame) -> DataFrame:
    """One row per changed (doc_id, text_hash): n_removed and the digest of what is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            removed, shas = [], []
            for text, gone in zip(batch["text"], batch["gone"], strict=True):
                words = text.encode().split()
                left = kept_words(words, np.array([g["b"] for g in gone]), np.array([g["e"] for g in gone]))
                removed.append(len(words) - len(left))
                shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield batch[["doc_id", "text_hash"]].assign(n_removed=removed, left_sha256=shas)

    return source.mapInPandas(run, f"{_keys(source)}, n_removed long, left_sha256 string").dropDuplicates(["doc_id", "text_hash"])
