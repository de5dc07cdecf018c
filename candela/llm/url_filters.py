"""URL filters by explicit rules and a learned tree of path templates, in DataFrame functions only.

Rules name a host and a path; the longest that fits decides. For the rest, paths are generalised to templates host by
host: segments that look like values (numbers, hex keys, file numbers) become wildcards, and so do rare children of
nodes with a large and thin fan-out. Sibling branches of the same shape whose labelled shares do not differ
significantly are merged, and a template whose smoothed share of good labels is too low is rejected. Labels are the
pages that rules decide, plus any labels given. Shares are smoothed from the host down the branches, so a template
without labels of its own is judged by those of its siblings, parents and host: where rules block nearly all pages of a
host that they decide, its other pages go too.

All counts are grouped sums over (host, path); a hot host is pre-aggregated and its nodes are never gathered.

Cases: a null url, or one without "://", has an empty host and path and no rule; it is judged like any template.
Templates of hosts without labels keep the prior, which allows. Repeated pages are each judged; of several labels of a
page, bad counts. Segments beyond `depth` are one tail of a template. Empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import durable, hot_join


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


DEPTH = 4  # segments that tell templates apart; deeper ones are one tail
FAN_OUT, CHILD_ROWS = 20, 4.0  # a node with at least so many children of fewer rows on average is a variable
SMOOTHING, PRIOR, LEAST_PURITY = 10.0, 0.75, 0.5
Z = 1.96
#: Rows of hosts and paths that are broadcast; low, as they are long strings.
FEW_PATHS = 4_000
VALUE = r"^(?:[0-9][0-9._-]*(?:\.[a-z]{1,5})?|[0-9a-f]{8,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    df = pages.select(F.col(id_col).alias("page_id"), rest.alias("u_rest"))
    df = df.withColumn("u_host", F.regexp_extract("u_rest", r"^[^/?#]*", 0))
    return df.select("page_id", F.translate("u_host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.regexp_extract(F.substr("u_rest", F.length("u_host") + 1), r"^[^?#]*", 0).alias("path"))


def rule_columns(rules: list[UrlRule]) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict; a tie goes to the rule that blocks."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):  # later ones override
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """paths: host, path, rows, labelled, bad (distinct host and path). Adds template."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    df = paths.withColumn("u_seg", F.transform(F.slice(segments, 1, depth), lambda s: F.when(s.rlike(VALUE), "*").otherwise(s)))
    df = df.withColumn("u_tail", F.when(F.size(segments) > depth, "/**").otherwise(F.when(F.col("path").endswith("/") & (F.size(segments) > 0), "/").otherwise(""))).withColumn("template", F.lit(""))
    for level in range(depth):
        at = df.withColumn("u_now", F.get("u_seg", F.lit(level)))
        child = at.where("u_now is not null and u_now <> '*'").groupBy("host", "template", "u_now").agg(F.sum("rows").alias("c_rows"))
        child = durable(child)
        parent = child.groupBy("host", "template").agg(F.count("*").alias("fan"), F.sum("c_rows").alias("p_rows")).where((F.col("fan") >= FAN_OUT) & (F.col("p_rows") < CHILD_ROWS * F.col("fan")))
        parent = durable(parent)
        thin = durable(hot_join(child, parent, ["host", "template"], parent.count(), F.col("u_now")).where(F.col("c_rows") < CHILD_ROWS).select("host", "template", "u_now", F.lit(True).alias("thin")))
        joined = hot_join(at, thin, ["host", "template", "u_now"], thin.count(), F.col("path"), "left", limit=FEW_PATHS)
        step = F.when(F.col("u_now").isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("thin"), "*").otherwise(F.col("u_now"))))
        df = joined.withColumn("template", F.concat("template", step)).drop("u_now", "thin")
    return df.withColumn("template", F.concat("template", "u_tail")).drop("u_seg", "u_tail")


def backed_off(nodes: DataFrame) -> DataFrame:
    """nodes: host, template, labelled, bad. Adds above: the smoothed purity of the host, then of each parent branch below it."""
    parts = F.filter(F.split("template", "/"), lambda s: s != "")
    levels = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)))
    branch = F.when(F.col("level") == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.col("level")), "/")))
    chain = nodes.select("*", F.explode(levels).alias("level")).withColumn("branch", branch)
    branches = durable(chain.groupBy("host", "branch").agg(F.sum("labelled").alias("b_lab"), F.sum("bad").alias("b_bad")))
    chain = hot_join(chain, branches, ["host", "branch"], branches.count(), F.col("template"))
    steps = F.array_sort(F.collect_list(F.struct("level", "b_lab", "b_bad")))  # one for each level of a template
    above = F.aggregate(steps, F.lit(PRIOR), lambda p, x: (x["b_lab"] - x["b_bad"] + SMOOTHING * p) / (x["b_lab"] + SMOOTHING))
    return chain.groupBy("host", "template", "labelled", "bad").agg(above.alias("above"))


def judged(nodes: DataFrame) -> DataFrame:
    """nodes: host, template, labelled, bad. Adds purity, after merging similar siblings.

    Siblings share a host and a shape (the template without its first segment). A sibling with labels is merged with
    the others if their shares of bad labels pass a two-proportion test; one without labels has nothing that tells it
    apart and is merged too. Counts are smoothed towards the siblings, theirs towards the parents and the host, and the
    host's towards the prior, so labels reach branches that have none.
    """
    shape = F.regexp_replace("template", r"^/[^/]*", "/~")
    df = backed_off(nodes).withColumn("shape", shape)
    pool = durable(df.groupBy("host", "shape").agg(F.sum("labelled").alias("a_lab"), F.sum("bad").alias("a_bad")))
    df = hot_join(df, pool, ["host", "shape"], pool.count(), F.col("template"))
    rest_lab, rest_bad = F.col("a_lab") - F.col("labelled"), F.col("a_bad") - F.col("bad")
    share = F.col("a_bad") / F.col("a_lab")
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest_lab))
    gap = F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest_lab)
    similar = F.when((F.col("labelled") > 0) & (rest_lab > 0), gap <= Z * error).otherwise(F.col("labelled") == 0)
    pooled = (F.col("a_lab") - F.col("a_bad") + SMOOTHING * F.col("above")) / (F.col("a_lab") + SMOOTHING)
    df = df.withColumn("pooled", pooled)
    own = (F.col("labelled") - F.col("bad") + SMOOTHING * F.col("pooled")) / (F.col("labelled") + SMOOTHING)
    return df.select("host", "template", "labelled", "bad", F.when(similar, F.col("pooled")).otherwise(own).alias("purity"))


def filter_urls(pages: DataFrame, rules: list[UrlRule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict for each page. labels: page_id, bad (0 or 1)."""
    name, verdict = rule_columns(rules)
    base = parsed(pages, id_col, url_col).withColumn("rule", name).withColumn("ruled", verdict)
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    marked = base.select("page_id", "host", "path", label.alias("bad"))
    if labels is not None:
        given = labels.groupBy("page_id").agg(F.max("bad").alias("said"))
        marked = marked.join(given, "page_id", "left").withColumn("bad", F.coalesce("bad", "said"))
    paths = marked.groupBy("host", "path").agg(F.count("*").alias("rows"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = durable(templates(durable(paths), depth))
    nodes = durable(paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    rejected = durable(judged(nodes).where(F.col("purity") < LEAST_PURITY).select("host", "template"))
    gone = durable(hot_join(paths, rejected, ["host", "template"], rejected.count(), F.col("path"), limit=FEW_PATHS).select("host", "path", F.lit("block").alias("learned")))
    out = hot_join(base, gone, ["host", "path"], gone.count(), F.col("page_id"), "left", limit=FEW_PATHS)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned", F.lit("allow")).alias("verdict"))
