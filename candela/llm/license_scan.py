"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template of T five-word shingles is searched in windows of W shingles, the least power of two (from 4) with W >= 2T,
that overlap by half. A place that holds the template lies within one window, so a match (containment of at least 0.8)
has a Jaccard similarity of at least c / (W + T - c) with it, c = ceil(0.8 T). With one row a band, the number of bands
is set so that the least similar template is still retrieved with a probability of 1 - MISS. Retrieved windows, widened
by half a window on both sides, are verified by exact containment of shingles of words.

Templates are a bounded parameter; texts are scanned whole in blocks, without a shuffle.

Cases: null and short texts match nothing. Of several places in a document, each template's best is reported, the first
of equals. Repeated rows are each reported. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import durable, text_or_empty
from candela.llm.license_texts import NOTICES, TEXTS
from candela.llm.substring_dedup import gram_hashes

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4
BLOCK_BYTES = 1 << 20

#: What is searched for: notices, then whole texts.
TEMPLATES = NOTICES + TEXTS

_EDGE = re.compile(rb"^[^\w\x80-\xff]+|[^\w\x80-\xff]+$")


def normal_words(text: bytes) -> list[bytes]:
    """Lower-case words without punctuation at their ends; words of punctuation only stay as they are."""
    return [_EDGE.sub(b"", w) or w for w in text.lower().split()]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], shingle: int = SHINGLE, containment: float = CONTAINMENT, miss: float = MISS, seed: int = 5):
        self.shingle, self.containment = shingle, containment
        self.templates, self.by_width = [], {}
        least = 1.0
        for license_id, text in templates:
            words = normal_words(text.encode())
            shingles = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
            if not shingles:
                raise ValueError(f"a template needs at least {shingle} words: {text!r}")
            t = len(words) - shingle + 1
            width = max(4, 1 << (2 * t - 1).bit_length())
            need = math.ceil(containment * len(shingles) - 1e-9)
            least = min(least, need / (width + len(shingles) - need))
            self.by_width.setdefault(width, []).append(len(self.templates))
            self.templates.append((license_id, text, shingles, self._hashes(words)))
        self.bands = max(1, math.ceil(math.log(miss) / math.log(1 - least))) if least < 1 else 1
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64)
        self.signatures = [[int(((h * a + b) >> np.uint64(32)).min()) for a, b in zip(self.a, self.b, strict=True)] for *_, h in self.templates]

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
        return gram_hashes(ids, self.shingle)

    def retrieved(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first shingle, width) of the windows that share a band with a template."""
        n, out = len(hashes), []
        flags = {w: [None] * len(ts) for w, ts in self.by_width.items()}
        for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            h = ((hashes * a + b) >> np.uint64(32)).astype(np.uint32)
            block, minima = 1, h
            for width in sorted(self.by_width):
                while block < width // 2:
                    if len(minima) % 2:
                        minima = np.r_[minima, np.uint32(0xFFFFFFFF)]
                    minima, block = np.minimum(minima[::2], minima[1::2]), block * 2
                windows = np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima
                for j, t in enumerate(self.by_width[width]):
                    same = windows == np.uint32(self.signatures[t][k])
                    flags[width][j] = same if flags[width][j] is None else flags[width][j] | same
        for width, found in flags.items():
            for t, flag in zip(self.by_width[width], found, strict=True):
                out += [(t, i * (width // 2), width) for i in np.flatnonzero(flag).tolist()] if n else []
        return out

    def verify(self, words: list[bytes], template: int, first: int, width: int) -> tuple[float, int]:
        """The containment of the template around a window, and its first shingle there."""
        a, b = max(0, first - width // 2), min(len(words) - self.shingle + 1, first + width + width // 2)
        shingles = self.templates[template][2]
        places: dict[tuple, int] = {}
        for i in range(a, b):
            s = tuple(words[i : i + self.shingle])
            if s in shingles:
                places.setdefault(s, i)
        return len(places) / len(shingles), min(places.values(), default=-1)

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of each match. Texts are hashed together, apart by a foreign word."""
        words = [normal_words(t) for t in texts]
        flat = [w for ws in words for w in (*ws, *(b"\x00" * k for k in range(1, self.shingle + 1)))]
        begins = np.cumsum([0, *(len(w) + self.shingle for w in words)])
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for t, first, width in self.retrieved(self._hashes(flat)):
            # A window may reach over several short texts.
            a, b = first - width // 2, first + width + width // 2
            for d in range(max(0, int(np.searchsorted(begins, a, side="right")) - 1), min(len(texts), int(np.searchsorted(begins, b, side="left")))):
                share, place = self.verify(words[d], t, first - int(begins[d]), width)
                if share >= self.containment and (-share, place) < (lambda x: (-x[0], x[1]))(best.get((d, t), (-1.0, 0))):
                    best[d, t] = (share, place)
        return [(d, t, share, place) for (d, t), (share, place) in sorted(best.items())]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template (its number), containment and first_word for each template found in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            found, begin = [], 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and (end == begin or held + len(texts[end]) <= BLOCK_BYTES):
                    held += len(texts[end])
                    end += 1
                found += [(begin + d, t, c, p) for d, t, c, p in scanner.scan(texts[begin:end])]
                begin = end
            rows, numbers, shares, places = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([scanner.templates[t][0] for t in numbers], pa.string()), pa.array(numbers, pa.int32()), pa.array(shares, pa.float64()), pa.array(places, pa.int64())],
                names=["doc_id", "license", "template", "containment", "first_word"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return durable(source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, license string, template int, containment double, first_word long"))
