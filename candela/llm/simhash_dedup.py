"""SimHash near-dedup by segment popcounts.

A fingerprint is cut into 2-bit segments and mapped to their bit counts. The Manhattan distance of two such vectors is
at most the fingerprints' Hamming distance. Counts are stored in unary (0: 00, 1: 01, 2: 11), so that the Manhattan
distance is the popcount of an exclusive or. The grid join deals the segments to B bands: two vectors within a
distance of d differ in at most d bands, so they share the grid cell of some B - d bands. Within a cell, pairs pass
the Manhattan bound and then the exact Hamming test; what leaves a cell is a spanning star for each group found, never
all pairs. A cell of over HOT_CELL fingerprints is cut into parts, and any two parts meet in a task of their own. Equal fingerprints are collapsed before, and groups are joined into components after.

B follows the number of distinct fingerprints: more bands make more but finer cells. The links are the same for every
B.

Cases: null text counts as empty; texts without words have the fingerprint zero and link like any other. Rows without
doc_id are fingerprinted and linked but never name a component, unless no row of it has a doc_id (component_id null).
Rows that share a doc_id are judged together when documents are dropped. Empty tables give empty results; extra
columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import bounded, durable, fresh, hot_join, text_or_empty
from candela.llm.components import components
from candela.llm.similar_texts import similar_links

LOW = 0x5555555555555555
#: log2 of one over the chance that two random 2-bit segments have equal counts.
SEGMENT_BITS = 1.415
#: Fingerprints of a grid cell beyond which it is dealt to several tasks, one for each two of its parts.
HOT_CELL = 4096
#: Shingles hashed at a time; bounds a worker's memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half the XXH64 of the shingles, repeats included."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(first)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp long for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def unary_counts(fp: Column) -> Column:
    """The popcounts of the 2-bit segments, each in unary."""
    shifted = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW).cast("long")
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def _unary(x: np.ndarray) -> np.ndarray:
    u, one, low = x.view(np.uint64), np.uint64(1), np.uint64(LOW)
    return ((u | (u >> one)) & low) | (((u & (u >> one)) & low) << one)


def band_masks(bands: int, distance: int) -> list[int]:
    """The signed masks of each choice of bands - distance bands."""
    segments = [int(x) for x in np.linspace(0, 32, bands + 1).round()]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(segments, segments[1:], strict=False)]
    whole = [sum(masks[i] for i in chosen) for chosen in combinations(range(bands), bands - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def bands_for(n: int, distance: int, row_cost: float = 1.0, pair_cost: float = 0.01) -> int:
    """The number of bands with the least expected cost of cell rows and compared pairs for n random fingerprints."""

    def cost(bands: int) -> float:
        keys = comb(bands, distance)
        return keys * (row_cost + pair_cost * n / 2 ** (SEGMENT_BITS * 32 * (bands - distance) / bands))

    return min(range(distance + 1, distance + 7), key=cost)


def _connect(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the trees of i[k] and j[k]; every node of root then points at the smallest of its tree."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def cell_links(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that span the groups within each cell. cells is sorted, fps are distinct in a cell."""
    n = len(cells)
    root = np.arange(n)
    u, x = _unary(fps), fps.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the end of the cell
    cell_of = np.repeat(np.arange(len(starts)), sizes)
    active = np.flatnonzero(left > 1)
    step = 1
    while len(active):
        other = active + step
        apart = root[active] != root[other]
        i, j = active[apart], other[apart]
        near = np.bitwise_count(u[i] ^ u[j]) <= distance
        i, j = i[near], j[near]
        near = np.bitwise_count(x[i] ^ x[j]) <= distance
        if near.any():
            root = _connect(root, i[near], j[near])
            whole = np.maximum.reduceat(root, starts) == np.minimum.reduceat(root, starts)
            active = active[~whole[cell_of[active]]]
        step += 1
        active = active[left[active] > step]
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def fingerprint_links(nodes: DataFrame, n: int, distance: int = 4, bands: int | None = None, hot_cell: int = HOT_CELL) -> DataFrame:
    """nodes: fp, distinct. Links a, b whose components are those of all pairs within the distance."""
    masks = band_masks(bands or bands_for(n, distance), distance)
    u = unary_counts(F.col("fp"))
    keys = nodes.select("fp", u.alias("u")).select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("u").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)])).alias("cell"))
    hot = durable(keys.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > hot_cell))
    if n_hot := hot.count():
        # Any two parts of a hot cell meet in a task of their own, so each pair meets and no task holds more than two.
        parts = F.ceil(F.col("size") / hot_cell).cast("int")
        mine = F.pmod(F.xxhash64(F.lit(5), "fp"), parts).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.xxhash64("cell", F.least(mine, o), F.greatest(mine, o)))
        dealt = hot_join(keys, hot, ["cell"], n_hot, F.col("fp"), "left")
        keys = dealt.select("fp", F.explode(F.when(F.col("size").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in cell_links(c, f, distance)], names=["a", "b"])

        for batch in batches:
            c, f = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            if not len(c):
                continue
            held.append((c, f))
            cut = int(np.searchsorted(c, c[-1]))  # the last cell may go on in the next batch
            if cut or held[0][0][0] != c[-1]:
                c, f = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(c, c[-1]))
                yield flush(c[:cut], f[:cut])
                held = [(c[cut:], f[cut:])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return keys.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, bands: int | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row; component_id is the smallest doc_id reachable over links."""
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = components(fingerprint_links(nodes.select("fp"), nodes.count(), distance, bands))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    # Only groups of several fingerprints are looked up; a single one is named by its own smallest document.
    joined = durable(labelled.where("fp <> label").select("label").distinct())
    n = joined.count()
    grouped = hot_join(labelled, joined, ["label"], n, F.col("fp")).groupBy("label").agg(F.min("low").alias("least"))
    named = durable(hot_join(labelled, grouped, ["label"], n, F.col("fp"), "left").select("fp", F.when(F.col("fp").eqNullSafe(F.col("label")) & F.col("least").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id")))
    return hot_join(prints, named, ["fp"], named.count(), F.col("doc_id")).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4) -> DataFrame:
    """Links a, b of doc_ids that span the groups of near fingerprints: a fingerprint's rows link to its smallest doc_id."""
    prints = durable(fingerprints(docs, id_col, text_col, shingle).where("doc_id is not null"))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    n = nodes.count()
    equal = hot_join(prints, nodes, ["fp"], n, F.col("doc_id")).where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    links = fingerprint_links(nodes.select("fp"), n, distance).distinct()
    left = hot_join(links, nodes.select(F.col("fp").alias("a"), F.col("low").alias("low_a")), ["a"], n, F.col("b"))
    both = hot_join(left, nodes.select(F.col("fp").alias("b"), F.col("low").alias("low_b")), ["b"], n, F.col("a"))
    return equal.union(both.where("low_a <> low_b").select(F.greatest("low_a", "low_b"), F.least("low_a", "low_b")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id, with all their columns.

    Candidates are the links of the fingerprints and, as these reach only very close copies, those of similar_texts.
    Texts are linked if the shingle sets of a candidate have the similarity, verified exactly. A doc_id that rows of
    different texts share always stays, and so do rows without doc_id. Texts without words are alike.
    """
    key = fresh(docs, "k_doc")
    similar, shared = similar_links(docs, similarity, id_col, text_col, shingle, more=near_candidates(docs, id_col, text_col, shingle, distance))
    moved = components(similar).select(F.col("node").alias("doc_id"))
    gone = durable(moved.join(shared, "doc_id", "left_anti").select(F.col("doc_id").alias(key)))
    return docs.join(bounded(gone, gone.count()), docs[id_col] == F.col(key), "left_anti")
