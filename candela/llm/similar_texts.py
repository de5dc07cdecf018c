"""Links between texts with a Jaccard similarity of word shingles of at least a threshold.

It reaches the near copies beyond the few differing bits of a fingerprint: MinHash bands retrieve, exact shingle sets
verify. At a similarity of 0.8 a pair shares one of the BANDS bands with a probability of 0.998.

The rows of a band's cell are spanned by a maximum forest of agreeing sketches: at most one link a row, never all
pairs, and between any two rows the surest path. Cells of over HOT rows are dealt to parts; the leaders of the parts
(rows whose sketch agrees with no earlier leader's in a share MARGIN above the similarity) then meet likewise, any two
parts of HOT of them in a task. Each link is verified on the whole texts, so no pair below the similarity is
linked.

That is the first round. Cells whose rows are then not of one component meet again, in parts of HOT rows: rows outside
the cell's main component are sent with their texts to all its parts, and every pair of different components whose
sketches agree is compared on all shingles where it meets, by hashes, so that only the links found leave the cell; they
are verified like the first. In a large group that lies just below the similarity these comparisons grow with the square
of the group.

Cases: null, empty and blank texts have no shingles and no links; texts of fewer words than a shingle are one shingle.
Rows without doc_id are left out. Rows that share a doc_id link if any of their texts do. Empty tables give no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import durable, hot_join, text_or_empty
from candela.llm.components import components
from candela.llm.substring_dedup import gram_hashes

BANDS, BAND_ROWS = 21, 6
#: Minima of a sketch, of which a byte each is kept.
MINIMA = 128
#: Rows of a cell beyond which it is dealt to several tasks.
HOT = 512
#: Links of a leader that are verified in one task; more are dealt to as many tasks as they need.
LINKS = 256
#: How far the share of agreeing sketch bytes may lie off the similarity: 2.8 standard deviations at 0.8.
MARGIN = 0.1
CHUNK = 2048

_RNG = np.random.default_rng(23)
_A = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingles_of(text: bytes, shingle: int) -> set[bytes]:
    """The distinct runs of words, A-Z lower-cased; the whole text where it has fewer words."""
    words = text.lower().split()
    k = min(shingle, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def sketch(text: bytes, shingle: int) -> tuple[bytes, list[int]]:
    """A byte of each minimum, and the cell of each band; no cells without words."""
    words = text.lower().split()
    if not words:
        return b"", []
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    hashes = gram_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), min(shingle, len(words)))
    minima = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        minima = np.minimum(minima, np.array([(part * a + b).min() for a, b in zip(_A, _B, strict=True)], np.uint64))
    raw = minima.tobytes()
    width = 8 * BAND_ROWS
    cells = [int.from_bytes(xxhash.xxh64_digest(raw[k * width : (k + 1) * width], k), "big", signed=True) for k in range(BANDS)]
    return minima.astype(np.uint8).tobytes(), cells


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, sketch binary, cells array<long> for each row with a doc_id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_py(), shingle) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in made], pa.binary()), pa.array([c for _, c in made], pa.list_(pa.int64()))], names=["doc_id", "sketch", "cells"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, sketch binary, cells array<long>").where(F.size("cells") > 0)


class Leaders:
    """The leaders of one cell while its rows pass."""

    def __init__(self, join: int, link: int):
        self.join, self.link = join, link
        self.ids: list = []
        self.rows: list[np.ndarray] = []

    def take(self, ids: list, rows: np.ndarray) -> list[tuple]:
        """Links (row, leader) of the next rows, each to the leader most like it."""
        agree, nearest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        active = np.arange(len(ids))

        def meet(leader: int, active: np.ndarray) -> np.ndarray:
            same = np.count_nonzero(rows[active] == self.rows[leader], axis=1)
            better = same > agree[active]
            agree[active[better]], nearest[active[better]] = same[better], leader
            return active[agree[active] < self.join]

        for leader in range(len(self.ids)):
            if not len(active):
                break
            active = meet(leader, active)
        while len(active):
            self.ids.append(ids[active[0]])
            self.rows.append(rows[active[0]])
            active = meet(len(self.ids) - 1, active[1:])
        return [(ids[i], self.ids[nearest[i]]) for i in np.flatnonzero(agree >= self.link).tolist()]


def forest(ids: list, rows: np.ndarray, link: int) -> list[tuple]:
    """A maximum spanning forest of the rows over agreements of at least link, as pairs (later, earlier)."""
    outside, out = np.arange(1, len(ids)), []
    best, at, last = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), 0
    while len(outside):
        same = np.count_nonzero(rows[outside] == rows[last], axis=1)
        better = same > best[outside]
        best[outside[better]], at[outside[better]] = same[better], last
        k = int(np.argmax(best[outside]))
        last = int(outside[k])
        if best[last] >= link:
            out.append((ids[max(last, at[last])], ids[min(last, at[last])]))
        outside = np.delete(outside, k)
    return out


def _cell_links(keyed: DataFrame, similarity: float) -> DataFrame:
    """keyed: cell, part, doc_id, sketch. Returns a, b: links; where b is null, a is a leader of a part, with cell and sketch."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    join, link = min(MINIMA, int((similarity + MARGIN) * MINIMA)), int((similarity - MARGIN) * MINIMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def ended() -> list[tuple]:
            if len(ids) < 2 and key[1] < 0:
                return []
            sketched = np.concatenate(rows)
            out = [(a, b, None, None) for a, b in forest(ids, sketched, link) if a != b]
            if key[1] >= 0:
                first = Leaders(join, link)
                first.take(ids, sketched)
                out += [(i, None, key[0], r.tobytes()) for i, r in zip(first.ids, first.rows, strict=True)]
            return out

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            id_type = batch.column(2).type
            cells, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (parts[1:] != parts[:-1])])
            out: list[tuple] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                at = (int(cells[s]), int(parts[s]))
                if at != key:
                    if key is not None:
                        out += ended()
                    key, ids, rows = at, [], []
                    if e - s == 1 and e < n and at[1] < 0:
                        key = None  # alone in its cell
                        continue
                taken = batch.column(2).slice(s, e - s).to_pylist()
                sketched = np.frombuffer(b"".join(batch.column(3).slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, MINIMA)
                ids += taken
                rows.append(sketched)
            if out:
                yield _batch(out, id_type)
        if key is not None and (out := ended()):
            yield _batch(out, id_type)

    return keyed.repartition("cell", "part").sortWithinPartitions("cell", "part", "doc_id").select("cell", "part", "doc_id", "sketch").mapInArrow(run, f"a {kind}, b {kind}, cell long, sketch binary")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    a, b, c, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type), pa.array(c, pa.int64()), pa.array(s, pa.binary())], names=["a", "b", "cell", "sketch"])


def candidates(made: DataFrame, similarity: float) -> DataFrame:
    """made: sketches(). Distinct links a, b whose sketches are alike, to verify."""
    rows = made.select(F.explode("cells").alias("cell"), "doc_id", "sketch")
    hot = durable(rows.groupBy("cell").count().where(F.col("count") > HOT))
    n_hot = hot.count()
    if not n_hot:
        return _cell_links(rows.withColumn("part", F.lit(-1)), similarity).select("a", "b").distinct()
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("count") / HOT)).cast("int"), F.lit(-1))
    first = durable(_cell_links(hot_join(rows, hot, ["cell"], n_hot, F.col("doc_id"), "left").select("cell", part.alias("part"), "doc_id", "sketch"), similarity))
    leaders = durable(first.where("b is null").select("cell", F.col("a").alias("doc_id"), "sketch"))
    sizes = durable(leaders.groupBy("cell").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("cell", F.least(mine, o), F.greatest(mine, o)))
    dealt = hot_join(leaders, sizes, ["cell"], n_hot, F.col("doc_id")).select(F.explode(meets).alias("cell"), F.lit(-1).alias("part"), "doc_id", "sketch")
    return first.where("b is not null").select("a", "b").union(_cell_links(dealt, similarity).select("a", "b")).distinct()


def verified(links: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The links a, b whose texts' shingle sets have at least the similarity. A leader's text goes once to each part of its links."""
    kind = links.schema["a"].dataType.simpleString()
    sizes = durable(links.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > LINKS))
    dealt = hot_join(links, sizes, ["b"], sizes.count(), F.col("a"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.coalesce("n", F.lit(1)) / LINKS)).cast("int").alias("salt"))
    roles = dealt.select(F.col("a").alias("doc"), "b", "salt", F.lit(1).alias("side")).union(dealt.select(F.col("b").alias("doc"), "b", "salt", F.lit(0).alias("side")).distinct())
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    placed = texts.join(roles, "doc").repartition("b", "salt").sortWithinPartitions("b", "salt", "side").select("b", "salt", "side", "doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                at, side = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                if at != key:
                    key, sets = at, []
                mine = shingles_of(batch.column(4)[i].as_py().encode(), shingle)
                if side == 0:
                    sets.append(mine)
                elif any((both := len(mine & s)) >= similarity * (len(mine) + len(s) - both) for s in sets):
                    a.append(batch.column(3)[i].as_py())
                    b.append(at[0])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(3).type), pa.array(b, batch.column(0).type)], names=["a", "b"])

    return placed.mapInArrow(run, f"a {kind}, b {kind}")


def _open_rows(made: DataFrame, found: DataFrame) -> DataFrame:
    """cell, doc_id, sketch, label, size, main and others of the rows of cells whose rows are not all of one component.

    label names a row's component over the links found so far; size counts the cell's rows; main is its largest label,
    and others counts the rows that are not of it.
    """
    labels = components(found)
    n = labels.count()
    named = hot_join(made, labels.withColumnRenamed("node", "doc_id"), ["doc_id"], n, F.col("doc_id"), "left")
    rows = named.select(F.explode("cells").alias("cell"), "doc_id", "sketch", F.coalesce("label", "doc_id").alias("label"))
    cells = durable(rows.groupBy("cell").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell", "size"))
    n_cells = cells.count()
    left = durable(hot_join(rows, cells, ["cell"], n_cells, F.col("doc_id")))
    largest = left.groupBy("cell", "label").count().groupBy("cell").agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("others"))
    return hot_join(left, largest, ["cell"], n_cells, F.col("doc_id"))


def _grams(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    words = text.lower().split()
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.unique(gram_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), min(shingle, len(words)))) if words else np.zeros(0, np.uint64)


def _open_links(rows: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """rows: _open_rows(). Links a, b that join what is alike of different labels, compared on the hashes of all shingles.

    A cell's parts are met by every row that is not of its main label, HOT of these at a time, so that each pair of
    different labels meets in some task and no task holds more than two times HOT rows. Pairs are compared where they meet
    and never become rows; each link joins two labels of its task.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    link = int((similarity - MARGIN) * MINIMA)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = F.ceil(F.col("size") / HOT).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    groups = F.ceil(F.col("others") / HOT).cast("int")
    group = F.pmod(F.xxhash64(F.lit(9), "doc_id"), groups).cast("int")
    resident = rows.select("cell", F.explode(F.transform(F.sequence(F.lit(0), groups - 1), lambda g: mine * groups + g)).alias("part"), F.lit(0).alias("visits"), "doc_id", "sketch", "label")
    visitors = rows.where("label <> main").select("cell", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda p: p * groups + group)).alias("part"), F.lit(1).alias("visits"), "doc_id", "sketch", "label")
    dealt = texts.join(resident.union(visitors), "doc_id").select("cell", "part", "visits", "doc_id", "sketch", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, labels, sketched, texts, grams, root = None, [], [], [], [], {}, {}

        def top(label: object) -> object:
            while (up := root.get(label, label)) != label:
                label = up
            return label

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = [], []
            raw = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, MINIMA)
            for i, (c, p, visits, doc, label, text) in enumerate(zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)], strict=True)):
                if (c, p) != key:
                    key, ids, labels, sketched, texts, grams, root = (c, p), [], [], [], [], {}, {}
                if not visits:
                    ids.append(doc)
                    labels.append(label)
                    sketched.append(raw[i])
                    texts.append(text)
                    continue
                if not len(sketched):
                    continue
                if isinstance(sketched, list):
                    sketched = np.stack(sketched)
                same, own = np.count_nonzero(sketched == raw[i], axis=1), None
                near = np.flatnonzero(same >= link)
                for k in near[np.argsort(-same[near], kind="stable")].tolist():
                    x, y = top(label), top(labels[k])
                    if x == y:
                        continue
                    own = _grams(text.encode(), shingle) if own is None else own
                    if k not in grams:
                        grams[k] = _grams(texts[k].encode(), shingle)
                    both = len(np.intersect1d(own, grams[k], assume_unique=True))
                    if both >= similarity * (len(own) + len(grams[k]) - both):
                        root[x] = y
                        a.append(max(doc, ids[k]))
                        b.append(min(doc, ids[k]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(3).type), pa.array(b, batch.column(3).type)], names=["a", "b"])

    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "visits", "doc_id").mapInArrow(run, f"a {kind}, b {kind}")


def similar_links(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links a, b that span the groups of similar texts, and the doc_ids that rows with different sketches share.

    more: further links a, b to verify.
    """
    made = durable(sketches(docs, id_col, text_col, shingle))
    shared = made.groupBy("doc_id").agg((F.min("sketch") != F.max("sketch")).alias("differ")).where("differ").select("doc_id")
    links = candidates(made, similarity)
    links = durable(links if more is None else links.union(more).distinct())
    found = durable(verified(links, docs, similarity, id_col, text_col, shingle))
    new = durable(_open_links(_open_rows(made, found), docs, similarity, id_col, text_col, shingle).distinct())
    return found.union(durable(verified(new, docs, similarity, id_col, text_col, shingle))), shared
