"""Best-fit packing through the configuration linear program.

Documents become token pieces of at most the capacity. Only the histogram of piece lengths (at most `capacity` rows)
goes to the driver. There the configuration program (fewest sequences so that all pieces are covered, one variable per
multiset of lengths that fits) is solved approximately by multiplicative weights: lengths that are covered least weigh
most, and the knapsack dynamic program prices the best configurations under these weights. The fractional solution is
rounded down; what is left is solved again in steps of whole sequences. Best fit on the histogram takes the last few
percent, where pieces no longer combine. Each configuration then owns a range of sequence ids, and a piece finds its
place from its rank among the pieces of its length, so no piece is ever gathered. Ranks are counted within salted slices
of a length, as one length may hold a third of all pieces.

Cases: null text counts as empty (one piece that holds the end id only). Rows without doc_id and repeated rows are
packed like any other row. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candela.llm.common import durable, text_or_empty

CAPACITY = 2048
END_ID = 0
#: Rounds of multiplicative weights, and how much a share of coverage changes a price: the second where the first's plan
#: lies more than GAP above the bound.
RATES, GAP = ((4, 0.05), (32, 1.0)), 1e-3
TOLERANCE = 1e-3  # how far a column's step may lie below the best price
WORTH, LESS = 0.999, 0.98  # the share of the best price that a column needs, and how it falls where none has it
BATCH = 32  # columns of whole sequences between two pricings
TAIL = 0.08  # share of the volume within which best fit may take over
SALTS, ROWS_PER_SALT = 64, 50_000
CACHE_WORDS = 700_000  # words whose ids a worker remembers, in each of two generations
MARK = "\x01"
#: Lower-case Latin letters, and a run of ASCII signs (no apostrophe) behind them: each is one word to the tokenizer's model.
LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
PLAIN = re.compile(rb"(" + LETTERS + rb")([!-&(-/:-@\[-`{-~]*)").fullmatch
#: How a byte-level model spells bytes that don't print.
SPELT = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts; under a tokenizer that folds case and whose tokens never span white space, found word by word.

    The ids of seen words are remembered in two generations of at most `limit` words each; a worker keeps them from
    task to task. Unseen words are encoded together, parted by a mark that is a token of its own.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.tokenizer, self.limit = _tokenizer(path), limit
        self.model = self.tokenizer.model
        self.known, self.old, self.signs = {}, {}, {}
        self.mark = self._encode(MARK)
        probe = "Ab cd, EF\n\u00c9t\u00e9 ab na\u00efve.*** stra\u00dfe"
        words = probe.encode().lower().split()
        #: Whether ids can be found word by word; under any other tokenizer texts are encoded whole.
        self.by_word = len(self.mark) == 4 and self._encode(probe) == b"".join(self._encode(w.decode()) for w in words)
        self.by_model = self.by_word and all(self._modelled(m) == self._encode(w.decode()) for w in words if (m := PLAIN(w)))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _modelled(self, m: re.Match) -> bytes:
        """The ids of a plain word, without the steps before the model: it changes neither case nor letters and is cut between letters and signs."""
        letters, signs = m.groups()
        ids = array("I", [t.id for t in self.model.tokenize(letters.decode() if letters.isascii() else letters.decode("latin-1").translate(SPELT))]).tobytes()
        if not signs:
            return ids
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs.clear()
            self.signs[signs] = array("I", [t.id for t in self.model.tokenize(signs.decode())]).tobytes()
        return ids + self.signs[signs]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = words.difference(known)
        again = new.intersection(old)
        known.update((w, old[w]) for w in again)
        unseen = []
        for w in new.difference(again):
            if self.by_model and (m := PLAIN(w)):
                known[w] = self._modelled(m)
            else:
                unseen.append(w)
        mark, mark_bytes = int.from_bytes(self.mark, "little"), MARK.encode()
        odd = [w for w in unseen if mark_bytes in w]
        plain = [w for w in unseen if mark_bytes not in w] if odd else unseen
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = self._encode(f" {MARK} ".join([w.decode() for w in some]) + f" {MARK}")
            begin = 0
            for w, end in zip(some, (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == mark)).tolist(), strict=True):
                known[w] = ids[begin:end]
                begin = end + 4
        known.update((w, self._encode(w.decode())) for w in odd)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # A special token's string is cut out before words are: such texts are encoded whole.
        words = [t.lower().split() if self.by_word and b"<|" not in t else None for t in texts]
        self._learn(set().union(*[w for w in words if w]))
        ids = self.known.__getitem__
        return [b"".join(map(ids, w)) if w is not None else array("I", self.tokenizer.encode(t.decode(), add_special_tokens=False).ids).tobytes() for t, w in zip(texts, words, strict=True)]


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _blocks(texts: list[bytes], rows: int = 256, size: int = 4 << 20) -> Iterator[list[bytes]]:
    """Consecutive texts, by a number of rows and of bytes at most (a longer text alone)."""
    block, held = [], 0
    for t in texts:
        if block and (len(block) >= rows or held + len(t) > size):
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut into pieces of the capacity."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _word_ids(path), END_ID.to_bytes(4, "little")
        for batch in batches:
            out, row = [], 0
            for block in _blocks([t.as_py() for t in batch.column(1).cast(pa.binary())]):
                for ids in ids_of(block):
                    ids += end
                    n = len(ids) // 4
                    out += [(row, p, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)])) for p, a in enumerate(range(0, n, capacity))]
                    row += 1
            rows, *rest = map(list, zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(rest, types, strict=True)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Pricing:
    """Knapsack dynamic program over the capacity: the most valuable configuration of lengths under given prices.

    sizes are ascending. best[c] is the largest value that c tokens hold, with any number of copies.
    """

    def __init__(self, sizes: np.ndarray, prices: np.ndarray, capacity: int):
        self.sizes, self.prices, self.capacity = sizes, prices, capacity
        self.upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
        self.best = best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            if k := self.upto[c]:
                best[c] = max(best[c], (best[c - sizes[:k]] + prices[:k]).max())

    def column(self, first: int, free: np.ndarray) -> dict[int, int]:
        """A configuration (place in sizes: copies) with the length at `first`: the table is walked down from there.

        free[k] copies of a length may be used, one of `first` at least. Of the steps within TOLERANCE of the best the
        longest length is taken, so short ones are left for what is hard to fill; copies run out in `free`.
        """
        out = {first: 1}
        free[first] -= 1
        room = self.capacity - int(self.sizes[first])
        while room > 0 and (k := self.upto[room]):
            value = self.best[room - self.sizes[:k]] + self.prices[:k]
            value[free[:k] < 1] = -1.0
            near = value[::-1] >= self.best[room] * (1 - TOLERANCE)
            j = k - 1 - int(near.argmax())
            if not near[k - 1 - j]:
                j = int(value.argmax())
                if value[j] < 0:
                    break
            out[j] = out.get(j, 0) + 1
            free[j] -= 1
            room -= int(self.sizes[j])
        return out


def fractional(hist: dict[int, int], capacity: int, rounds: int = RATES[0][0], eta: float = RATES[0][1]) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with fractional counts that cover the histogram, by multiplicative weights; and a lower bound.

    Each round prices the lengths anew: a length's size times exp(-eta * share covered), so what lags costs most. Then
    the lengths that lag behind the round's share get columns worth about the best price, or wait. Prices are dual values once divided by the
    best column's, so each round also bounds the program from below.
    """
    sizes = np.array(sorted(hist))
    need = np.array([hist[s] for s in sizes.tolist()], float)
    covered, found = np.zeros(len(sizes)), {}
    bound = float((sizes * need).sum() / capacity)
    for t in range(1, rounds + 1):
        prices = sizes * np.exp(-eta * (covered / need - (t - 1) / rounds))
        pricing = Pricing(sizes, prices, capacity)
        bound = max(bound, float((need * prices).sum() / pricing.best[capacity]))
        lag = need * (t / rounds) - covered
        for i in range(len(sizes) - 1, -1, -1):
            while lag[i] > 1e-9:
                column = pricing.column(i, np.where(lag > 1e-9, np.maximum(1, lag), 0))
                places, copies = np.array(list(column)), np.array(list(column.values()))
                if prices[places] @ copies < WORTH * pricing.best[capacity]:
                    break  # it lags on and costs more in the next round
                amount = float((lag[places] / copies).min())
                lag[places] -= amount * copies
                covered[places] += amount * copies
                key = tuple(sorted((int(sizes[j]), a) for j, a in column.items()))
                found[key] = found.get(key, 0.0) + amount
    return [(dict(k), x) for k, x in found.items()], bound


def dive(hist: dict[int, int], capacity: int, eta: float = RATES[0][1], batch: int = BATCH) -> Iterator[list[tuple[dict[int, int], int]]]:
    """The same program in steps of whole sequences, for what the fractional counts leave; a batch of columns per pricing."""
    sizes = np.array(sorted(hist))
    need = np.array([hist[s] for s in sizes.tolist()])
    left = need.copy()
    while left.any():
        at = np.flatnonzero(left)
        free, share = left[at], 1 - left[at] / need[at]
        pricing = Pricing(sizes[at], sizes[at] * np.exp(-eta * (share - share.mean())), capacity)
        out: list[tuple[dict[int, int], int]] = []
        worth = WORTH * pricing.best[capacity]
        while not out:
            for i in range(len(at) - 1, -1, -1):
                while free[i] and len(out) < batch:
                    column = pricing.column(i, trial := free.copy())
                    if sum(pricing.prices[j] * a for j, a in column.items()) < worth:
                        break
                    free = trial
                    more = min(int(free[j]) // a for j, a in column.items())
                    for j, a in column.items():
                        free[j] -= more * a
                    out.append(({int(sizes[at[j]]): a for j, a in column.items()}, 1 + more))
            worth *= LESS
        left[at] = free
        yield out


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on the histogram: bins with the same content move together."""
    open_bins: dict[int, dict[tuple, int]] = {}
    for s in sorted(hist, reverse=True):
        left = hist[s]
        while left:
            room = min((r for r in open_bins if r >= s), default=None)
            if room is None:
                most = capacity // s
                fill = [(most, left // most)] if left >= most else []
                if rest := left - sum(a * n for a, n in fill):
                    fill.append((rest, 1))
                for a, n in fill:
                    bins = open_bins.setdefault(capacity - a * s, {})
                    bins[((s, a),)] = bins.get(((s, a),), 0) + n
                left = 0
                continue
            bins = open_bins[room]
            content, n = next(iter(bins.items()))
            a = min(room // s, left)
            take = min(n, left // a)
            bins[content] -= take
            if not bins[content]:
                del bins[content]
            if not bins:
                del open_bins[room]
            target = open_bins.setdefault(room - a * s, {})
            new = (*content, (s, a))
            target[new] = target.get(new, 0) + take
            left -= a * take
    return [(dict(c), n) for bins in open_bins.values() for c, n in bins.items()]


def _taken(left: dict[int, int], configs: list[tuple[dict[int, int], int]]) -> dict[int, int]:
    """What is left of the histogram without these sequences."""
    left = dict(left)
    for config, n in configs:
        for s, a in config.items():
            left[s] -= n * a
    return {s: n for s, n in left.items() if n}


def _sequences(configs: list[tuple[dict[int, int], int]]) -> int:
    return sum(n for _, n in configs)


def program(hist: dict[int, int], capacity: int = CAPACITY, rounds: int = RATES[0][0], eta: float = RATES[0][1]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int], float]:
    """Sequences that the configuration program places, the lengths it leaves (at most TAIL of the volume), and its lower bound.

    Fractional counts are rounded down, the rest is solved again in whole steps. Where the last pieces no longer combine
    well, they are left to best fit: of the cuts within the tail, the one with the fewest sequences in all is taken.
    """
    out: list[tuple[dict[int, int], int]] = []
    if not hist:
        return out, {}, 0.0
    columns, bound = fractional(hist, capacity, rounds, eta)
    out = [(config, int(x)) for config, x in columns if x >= 1]
    left = _taken(hist, out)
    tail = TAIL * sum(s * n for s, n in hist.items())
    best: tuple | None = None
    for step in chain(dive(left, capacity, eta), [[]]):
        if sum(s * n for s, n in left.items()) <= tail:
            total = _sequences(out) + _sequences(best_fit(left, capacity))
            if best is None or total < best[0]:
                best = (total, len(out), left)
        out = out + step
        left = _taken(left, step)
    return out[: best[1]], best[2], bound


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length: pieces) and how many sequences have each; together they hold the histogram exactly."""
    rest = dict(hist)
    full = rest.pop(capacity, 0)
    best = best_fit(rest, capacity)  # stands only where no run of the program needs as few
    for rounds, eta in RATES:
        placed, left, bound = program(rest, capacity, rounds, eta)
        whole = placed + best_fit(left, capacity)
        if _sequences(whole) <= _sequences(best):
            best = whole
        if _sequences(best) <= (1 + GAP) * bound + 1:
            break
    return [({capacity: 1}, full)] * (full > 0) + best


def slots(configs: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where each configuration's slots begin among the ranks, its first sequence, copies and offset."""
    out: dict[int, list] = {}
    sequence = 0
    for config, n in configs:
        at = 0
        for s, a in config.items():
            out.setdefault(s, []).append((n * a, sequence, a, at))
            at += s * a
        sequence += n
    place = {}
    for s, rows in out.items():
        counts, base, copies, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        place[s] = (np.r_[0, np.cumsum(counts)[:-1]], base, copies, offset)
    return place


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    cut = durable(pieces(docs, id_col, text_col, capacity, tokenizer))
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = slots(plan(hist, capacity))
    salts = max(SALTS, -(-max(hist.values(), default=0) // ROWS_PER_SALT))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                s = int(length[rows[0]])
                first, base, copies, at = place[s]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                within = rank[rows] - first[k]
                sequence[rows] = base[k] + within // copies[k]
                offset[rows] = at[k] + s * (within % copies[k])
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(run, f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
