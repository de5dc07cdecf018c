"""Exact dedup through counting quotient filters.

Every partition condenses its 64-bit text fingerprints into a counting quotient filter: the leading bits are the
quotient (a run per quotient), the rest is the remainder, kept sorted in its run with a count. Quotient and remainder
together are the whole fingerprint, so filters merge without loss by merging sorted remainders. Filters are cut by
leading bits into shards, merged shard by shard, and only fingerprints counted more than once go on to byte
verification, where rows are grouped by their whole text.

Cases: null text counts as empty. Rows without doc_id count in their group but stay behind any row with one. Of
repeated rows (same doc_id, same text) one stays. An empty table gives an empty result. Extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import WS, bounded, durable, fresh, hot_join, shards_for, text_or_empty

#: Fingerprints a merged shard should hold; the number of shards follows the rows.
SHARD_ROWS = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WS, " ")


class CountingQuotientFilter:
    """Sorted distinct fingerprints of one shard as runs of remainders, with counts.

    runs[q] is the number of remainders of quotient q; remainders are stored in the fewest whole bytes; counts of one
    are implicit, larger ones are kept as (position, count).
    """

    def __init__(self, bits: int, quotient_bits: int, values: np.ndarray, counts: np.ndarray):
        self.bits, self.quotient_bits, self.values, self.counts = bits, quotient_bits, values, counts

    @classmethod
    def build(cls, bits: int, values: np.ndarray) -> CountingQuotientFilter:
        """values: unsigned integers below 2**bits, in any order, repeats included."""
        distinct, counts = np.unique(values, return_counts=True)
        return cls(bits, cls.quotients(bits, len(distinct)), distinct, counts.astype(np.uint64))

    @staticmethod
    def quotients(bits: int, n: int) -> int:
        return min(bits, max(1, int(n).bit_length()), 24)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        values = np.concatenate([self.values, other.values])
        counts = np.concatenate([self.counts, other.counts])
        order = np.argsort(values, kind="stable")  # a merge of two sorted runs
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
        merged = np.add.reduceat(counts, first) if len(first) else counts
        return CountingQuotientFilter(self.bits, self.quotients(self.bits, len(first)), values[first], merged)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        many = self.counts > 1
        return self.values[many], self.counts[many]

    def to_bytes(self) -> bytes:
        remainder_bits = self.bits - self.quotient_bits
        width = -(-remainder_bits // 8)
        runs = np.bincount((self.values >> np.uint64(remainder_bits)).astype(np.int64), minlength=1 << self.quotient_bits)
        remainders = (self.values & np.uint64((1 << remainder_bits) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.bits, self.quotient_bits, len(self.values), len(many)], "<u8")
        return b"".join([head.tobytes(), runs.astype("<u4").tobytes(), remainders.tobytes(), many.astype("<u8").tobytes(), self.counts[many].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, n, n_many = (int(x) for x in np.frombuffer(data, "<u8", 4))
        remainder_bits = bits - quotient_bits
        width, at = -(-remainder_bits // 8), 32
        runs = np.frombuffer(data, "<u4", 1 << quotient_bits, at)
        at += 4 << quotient_bits
        padded = np.zeros((n, 8), np.uint8)
        padded[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        many = np.frombuffer(data, "<u8", n_many, at).astype(np.int64)
        counts = np.ones(n, np.uint64)
        counts[many] = np.frombuffer(data, "<u8", n_many, at + 8 * n_many)
        quotient = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), runs)
        return cls(bits, quotient_bits, (quotient << np.uint64(remainder_bits)) | padded.reshape(-1).view("<u8"), counts)


def repeated_fingerprints(fingerprints: DataFrame, rows: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp long, copies long) of the values of the single column fp that occur more than once."""
    shard_bits = (shards_for(rows, shard_rows) - 1).bit_length()
    bits = 64 - shard_bits

    def filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b["fp"].to_numpy().view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        shard = values >> np.uint64(bits) if shard_bits else np.zeros(len(values), np.uint64)
        cuts = [*np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(values)] if len(values) else [0]
        mask = np.uint64((1 << bits) - 1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield pd.DataFrame({"shard": [int(shard[a])], "cqf": [CountingQuotientFilter.build(bits, values[a:b] & mask).to_bytes()]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        queue = [CountingQuotientFilter.from_bytes(x) for x in group["cqf"]]
        while len(queue) > 1:  # pairwise, so that every fingerprint is moved a logarithm of times
            queue = [queue[i].merge(queue[i + 1]) if i + 1 < len(queue) else queue[i] for i in range(0, len(queue), 2)]
        values, counts = queue[0].repeated()
        whole = values | (np.uint64(int(key[0])) << np.uint64(bits)) if shard_bits else values
        return pd.DataFrame({"fp": whole.view(np.int64), "copies": counts.astype(np.int64)})

    return fingerprints.mapInPandas(filters, "shard long, cqf binary").groupBy("shard").applyInPandas(merge, "fp long, copies long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id among rows whose text is equal after each run of ASCII white space became one space.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(text_or_empty(text_col)).alias("norm"))
    digests = durable(source.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")))
    repeated = durable(repeated_fingerprints(digests.select("fp"), digests.count()))
    suspects = bounded(repeated.select("fp"), repeated.count())
    # Byte verification: grouping by the text itself. Copies within a partition collapse before the shuffle.
    verified = durable(
        source.withColumn("fp", F.xxhash64("norm")).join(suspects, "fp").groupBy("fp", "norm").agg(F.count("*").alias("n"))
        .where("n > 1").select("fp", F.sha2("norm", 256).alias("text_sha256"))
    )
    groups = durable(
        hot_join(digests, verified, ["fp", "text_sha256"], verified.count(), F.col("row"))
        .groupBy("fp", "text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.count("*").alias("size"))
        .select("fp", "text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "size")
    )
    return hot_join(digests, groups, ["fp", "text_sha256"], groups.count(), F.col("row"), "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Texts are not shuffled: the dropped keys (doc_id, digest) are anti-joined, by broadcast up to a counted bound.
    """
    key, sha = fresh(docs, "k_doc"), fresh(docs, "k_sha")
    groups = exact_groups(docs, id_col, text_col).where("group_size > 1")
    keys = durable(groups.groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias("stays"), F.count("*").alias("n")))
    gone = keys.where("not stays or n > 1").select(key, sha)
    again = keys.where("stays and n > 1").select(key, sha)  # repeated rows: same doc_id and text
    tagged = docs.withColumn(sha, F.sha2(normalised(text_or_empty(text_col)), 256))
    same = lambda side: tagged[id_col].eqNullSafe(side[key]) & (tagged[sha] == side[sha])
    out = tagged.join(bounded(gone, gone.count()), same(gone), "left_anti").drop(sha)
    if (n := again.count()) == 0:
        return out
    row = fresh(docs, "k_row")
    once = tagged.join(bounded(again, n), same(again), "left_semi").groupBy(id_col, sha).agg(F.first(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return out.unionByName(once)
