"""Sources of blocks and units, and sinks of index tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("style", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()), T.StructField("answerable", T.BooleanType()),
    T.StructField("gold", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType())]))),
    T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("split", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "source", F.coalesce("text", F.lit("")).alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """The files of a folder as path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """path, the columns of schema, and error: the rows that parse(path, content) gives for each file.

    A file that fails gives one row that holds its error alone, so none stops the rest. Rows keep the parser's order
    in a column `ord` where the schema has one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, "error": None, **r} for r in parse(path, bytes(content))]
                except Exception as e:  # noqa: BLE001 - any fault of a parser is that file's
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    return files.mapInPandas(run, f"path string, {schema}, error string")


def items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items, one JSON object a line; blank lines are skipped; of items that share an id the last one stays, later files being last."""
    read = spark.read.schema(ITEM).json(path).where("id is not null").select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at_"))
    last = F.row_number().over(W.partitionBy("id").orderBy(F.col("at_").desc()))
    return read.withColumn("n_", last).where("n_ = 1").drop("n_", "at_")


def item_blocks(found: DataFrame, min_chars: int = 20) -> DataFrame:
    """found: source, ord, label, level, page, text of a document's body items as another parser names them. Blocks: source, ord, kind, level, page, text.

    Tables keep their markdown, section headers go a level down, the title is the first level, and page headers and
    footers go, as do empty items and short paragraphs. Items without a page are left out.
    """
    label, text = F.lower("label"), F.trim("text")
    kind = F.when(label == "table", "table").when(label.isin("title", "section_header"), "heading").otherwise("paragraph")
    level = F.when(label == "title", 1).when(label == "section_header", F.col("level") + 1).otherwise(0)
    rows = found.where(F.col("page").isNotNull() & ~label.isin("page_header", "page_footer"))
    rows = rows.select("source", "ord", kind.alias("kind"), level.cast("int").alias("level"), "page", text.alias("text"))
    return rows.where(F.when(F.col("kind") == "paragraph", F.length("text") >= min_chars).when(F.col("kind") == "table", F.col("text") != "").otherwise(True))


def blocks_of(spark: SparkSession, folder: str, parser: str, parsers: dict[str, Callable[[DataFrame], DataFrame]], pattern: str = "*.pdf") -> DataFrame:
    """The blocks of a folder's files by the named parser."""
    if parser not in parsers:
        raise ValueError(f"unknown parser {parser}; there are {sorted(parsers)}")
    return parsers[parser](scan_folder(spark, folder, pattern))


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ord, kind, level, text of each h1 to h6 and p element, tags stripped."""
    element = r"(?s)<(h[1-6]|p)\b[^>]*>(.*?)(?=</\1>|<p\b|<h[1-6]\b|$)"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(element), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(element), F.lit(2)).alias("body"))
    blocks = pages.select("page_id", F.posexplode(both).alias("ord", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("b.body"), "<[^>]*>", " "), r"\s+", " "))
    return blocks.select("page_id", "ord", F.when(F.col("b.tag") == "p", "paragraph").otherwise("heading").alias("kind"), F.when(F.col("b.tag") == "p", 0).otherwise(F.substring("b.tag", 2, 1).cast("int")).alias("level"), text.alias("text"))


def save_lines(rows: DataFrame, path: str) -> None:
    """Items, answers or training pairs, one JSON object a line."""
    rows.write.mode("overwrite").json(path)


def save_summary(summary: DataFrame, folder: str, by: str = "variant") -> None:
    """One row a variant, as JSON lines and as a markdown table."""
    rows = [r.asDict() for r in summary.orderBy(by).collect()]  # as many as variants
    lines = ["| " + " | ".join(summary.columns) + " |", "|" + " --- |" * len(summary.columns)]
    lines += ["| " + " | ".join("-" if r[c] is None else str(r[c]) for c in summary.columns) + " |" for r in rows]
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    summary.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/table")


def merge_cached(rows: DataFrame, cached: DataFrame, key: str, score) -> DataFrame:
    """Rows with a cached score keep it; score(rows) is called on the rest only."""
    return rows.join(cached, key).unionByName(score(rows.join(cached.select(key), key, "left_anti")))


def update_scores(spark: SparkSession, path: str, rows: DataFrame, key: str, score) -> bool:
    """Scores of the rows that the table at path lacks are appended; nothing is written where none is missing."""
    try:
        known = spark.read.parquet(path).select(key)
        missing = rows.join(known, key, "left_anti")
    except AnalysisException:  # the first time
        missing = rows
    if missing.isEmpty():
        return False
    score(missing).write.mode("append").parquet(path)
    return True
