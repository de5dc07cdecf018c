"""Text spans of PDF files, and blocks with headings made of them.

The reader takes files as they are commonly written: plain or Flate streams, objects in the file or in object streams,
simple fonts in Latin text. Encrypted files and fonts with encodings of their own are refused or read byte by byte; a
file that cannot be read gives its error as a row, see `tables.parsed`.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.operators import layout
from candela.sources import tables

SPAN = "page int, block int, line int, x0 double, y0 double, mid double, size double, bold boolean, text string"
#: Of a font size: how far baselines of one line differ, and how far apart lines of one block are at most.
SAME_LINE, SAME_BLOCK = 0.4, 1.6

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
    else:
        raw = _ESCAPE.sub(lambda m: _PLAIN.get(m[1], b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1])
    return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _content(body: bytes) -> bytes:
    m = _STREAM.match(body.lstrip())
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            text = _content(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [int(x) for x in text[:first].split()]
            places = sorted(zip(heads[1::2], heads[::2], strict=True))
            for (at, number), end in zip(places, [*[p for p, _ in places[1:]], len(text) - first], strict=True):
                out.setdefault(number, text[first + at : first + end])
    return out


def _refs(body: bytes, name: bytes) -> list[int]:
    m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, bytes]) -> list[int]:
    """The numbers of page objects in the order of the page tree."""
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    if root is None:
        raise ValueError("no catalog: not a PDF, or one that is encrypted")
    out, open_nodes, seen = [], _refs(objects[root], b"Pages"), set()
    while open_nodes:
        n = open_nodes.pop(0)
        if n in seen or n not in objects:
            continue
        seen.add(n)
        kids = _refs(objects[n], b"Kids")
        if kids:
            open_nodes = kids + open_nodes
        elif re.search(rb"/Type\s*/Page\b(?!s)", objects[n]):
            out.append(n)
    return out


def _fonts(objects: dict[int, bytes], page: bytes) -> dict[bytes, bool]:
    """Which names of a page's fonts are bold ones."""
    resources = b"".join([page, *(objects.get(n, b"") for n in _refs(page, b"Resources")), *(objects.get(n, b"") for n in _refs(page, b"Parent"))])
    listed = resources + b"".join(objects.get(n, b"") for n in _refs(resources, b"Font"))
    return {m[1]: b"bold" in objects.get(int(m[2]), b"").lower() for m in re.finditer(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", listed)}


def _shown(content: bytes, bold: dict[bytes, bool]) -> list[tuple[float, float, float, bool, str]]:
    """(x, y, size, bold, text) of each text a content stream shows; y grows upwards."""
    out: list[tuple[float, float, float, bool, str]] = []
    args: list[bytes] = []
    x = y = lx = ly = leading = 0.0
    size, scale, heavy = 11.0, 1.0, False

    def show(text: str) -> None:
        nonlocal x
        if text:
            out.append((x, y, size * scale, heavy, text))
            x += len(text) * size * scale / 2  # widths are not read: half the size a letter

    def down(dx: float, dy: float) -> None:
        nonlocal x, y, lx, ly
        lx, ly = lx + dx * scale, ly + dy * scale
        x, y = lx, ly

    for m in _TOKEN.finditer(content):
        t = m[0]
        if not re.match(rb"[A-Za-z'\"*]", t):
            args.append(t)
            continue
        numbers = [float(a) for a in args if re.fullmatch(rb"[-+]?\d*\.?\d+", a)]
        if t == b"BT":
            x = y = lx = ly = 0.0
            scale = 1.0
        elif t == b"Tf" and numbers:
            size = numbers[-1]
            heavy = bold.get(next((a[1:] for a in args if a[:1] == b"/"), b""), False)
        elif t == b"TL" and numbers:
            leading = numbers[-1]
        elif t in (b"Td", b"TD") and len(numbers) >= 2:
            leading = -numbers[1] if t == b"TD" else leading
            down(*numbers[-2:])
        elif t == b"Tm" and len(numbers) >= 6:
            scale = abs(numbers[3]) or 1.0
            x, y = lx, ly = numbers[4], numbers[5]
        elif t == b"T*":
            down(0.0, -leading)
        elif t in (b"Tj", b"'", b'"') and args:
            if t != b"Tj":
                down(0.0, -leading)
            show(_string(args[-1]))
        elif t == b"TJ":
            text = ""
            for a in args:
                if a[:1] in b"(<":
                    text += _string(a)
                elif re.fullmatch(rb"[-+]?\d*\.?\d+", a) and float(a) < -200:  # a wide gap stands for a blank
                    text += " "
            show(text)
        args = []
    return out


def spans(path: str, content: bytes) -> list[dict]:
    """The spans of a file, each with its page (from 1), block and line."""
    objects, out = _objects(content), []
    for number, at in enumerate(_pages(objects), 1):
        page = objects[at]
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", page + b"".join(objects.get(n, b"") for n in _refs(page, b"Parent")))
        x0, _, x1, top = [float(v) for v in box[1].split()] if box else (0.0, 0.0, 612.0, 792.0)
        bold = _fonts(objects, page)
        shown = [s for n in _refs(page, b"Contents") for s in _shown(_content(objects.get(n, b"")), bold)]
        block = line = 0
        last: tuple | None = None
        for x, y, size, heavy, text in shown:
            if last is not None and abs(last[1] - y) > SAME_LINE * max(size, last[2]):
                near = 0 < last[1] - y <= SAME_BLOCK * max(size, last[2]) and abs(size - last[2]) < 0.5 and heavy == last[3]
                block, line = (block, line + 1) if near else (block + 1, 0)
            last = (x, y, size, heavy)
            out.append({"page": number, "block": block, "line": line, "x0": x, "y0": top - y, "mid": (x0 + x1) / 2, "size": round(size, 2), "bold": heavy, "text": text})
    return out


def pdf_blocks(files: DataFrame, min_chars: int = 20) -> DataFrame:
    """files: path, content. source, ord, kind, level, page, text, error: the blocks of each file in reading order.

    Running heads and feet go, and paragraphs of under min_chars characters; headings stay. A file that cannot be read
    is one row with its error.
    """
    read = tables.parsed(files, spans, SPAN).withColumn("source", F.element_at(F.split("path", "/"), -1))
    failed = read.where("error is not null").select("source", "error")
    named = read.where("error is null").withColumn("doc", F.col("source")).withColumn("block", F.struct("page", "block"))
    place = named.groupBy("source", "block").agg(F.first("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.first("mid").alias("mid"))
    lines = named.groupBy("source", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), "").alias("text"))
    blocks = layout.joined_lines(lines).where("text <> ''").join(place, ["source", "block"]).join(layout.block_fonts(named), ["source", "block"]).join(layout.body_size(named), "source")
    placed = layout.reading_order(blocks.withColumn("ord", F.col("block.block"))).drop("ord")
    kept = layout.without_running_text(placed.withColumn("y", F.col("y0")), layout.running_text(placed.withColumn("y", F.col("y0"))))
    ordered = kept.withColumn("ord", (F.row_number().over(W.partitionBy("source", "page").orderBy("place")) + F.col("page").cast("long") * 100_000).cast("long"))
    levels = layout.heading_levels(ordered).join(ordered.select("source", "ord", "page"), ["source", "ord"])
    good = levels.where((F.col("kind") == "heading") | (F.length("text") >= min_chars))
    none = F.lit(None)
    return good.select("source", "ord", "kind", "level", "page", "text", none.cast("string").alias("error")).unionByName(failed.select("source", none.cast("long").alias("ord"), none.cast("string").alias("kind"), none.cast("int").alias("level"), none.cast("int").alias("page"), none.cast("string").alias("text"), "error"))
