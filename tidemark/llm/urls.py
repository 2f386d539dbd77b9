"""URL filtering by a tree of path templates.

Urls are first reduced to distinct (host, classed path) with counts of urls, labels and bad labels, so that a
host with a third of all urls is a few rows by type of path. Level by level from the root, children of a node that are
too rare to be fixed parts of the site become the wildcard `*`. Then, from the leaves up, branches of a node
are merged whose subtrees have the same shape and whose bad rates do not differ, by a test of two samples at a time, until no
two are alike; few labels merge only where they agree. What is left
are templates; one is rejected if its bad rate, smoothed towards its host's and the whole table's, is over the
threshold. Every step is an aggregate and an equi-join; nothing is gathered by host.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, materialize

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Children under this share of their parent, or this count, are variable; deviations that count as different, and labels
#: under which they don't count; weight of the prior; bad rate over which a template is rejected; segments of a path that are
#: told apart on a host without labels, where every template has the same purity.
RARE_SHARE, RARE_COUNT, Z, LEAST_LABELS, PRIOR, THRESHOLD, DEPTH = 0.02, 8, 2.0, 5, 5.0, 0.5, 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and where there is no ://."""
    found = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), _UPPER, _LOWER), found(2)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a parent domain) and a prefix of path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _classed(segment: Column) -> Column:
    """A segment by its type, where the type alone says that it is variable."""
    for pattern, name in (
        (r"^\d{4}-\d{2}(-\d{2})?$", "{date}"),
        (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{uuid}"),
        (r"(?i)^(?=[a-f]*\d)[0-9a-f]{12,}$", "{hex}"),
        (r"^\d+", "{num}"),
    ):
        segment = F.regexp_replace(segment, pattern, name)
    return segment


def _segments(path: Column) -> Column:
    """The classed segments."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _classed)


def _depth(nodes: DataFrame) -> int:
    """The levels at which anything can branch: the longest path of a host that has another one as long or longer."""
    sizes = nodes.groupBy("host", F.size("t").alias("size")).agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("host").agg(F.max("size").alias("most"))
    return sizes.join(most, "host").where("k > 1 or size < most").agg(F.max("size")).first()[0] or 0


def _at(level: int) -> Column:
    return F.get("t", F.lit(level))


def _set(level: int, to: Column) -> Column:
    return F.transform("t", lambda x, i: F.when(i == level, to).otherwise(x))


def alike(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two branches with (labels, bad labels) may share a template. Without labels on both sides nothing tells them apart; a
    side without labels lends none to the other. With few labels on a side they must be all bad or all good on both; else
    the difference of the rates must lie within Z deviations of their pooled rate."""
    (la, ba), (lb, bb) = a, b
    if not la or not lb:
        return la == lb
    if min(la, lb) < LEAST_LABELS:
        return ba + bb in (0, la + lb)
    p = (ba + bb) / (la + lb)
    return abs(ba / la - bb / lb) <= Z * (p * (1 - p) * (1 / la + 1 / lb)) ** 0.5


def unite(branches: list[tuple[str, int, int]]) -> list[list[str]]:
    """Branches (segment, labels, bad labels) in groups: of neighbours by rate, the two closest that are alike are pooled, until none are."""
    groups = [([s], labels, bad) for s, labels, bad in sorted(branches, key=lambda x: (x[1] > 0, x[2] / x[1] if x[1] else 0.0, x[0]))]
    while True:
        gaps = [(abs(x[2] / max(x[1], 1) - y[2] / max(y[1], 1)), i) for i, (x, y) in enumerate(zip(groups, groups[1:])) if alike(x[1:], y[1:])]
        if not gaps:
            return [sorted(g[0]) for g in groups]
        i = min(gaps)[1]
        x, y = groups[i : i + 2]
        groups[i : i + 2] = [(x[0] + y[0], x[1] + y[1], x[2] + y[2])]


def _united(lists: pd.Series) -> pd.Series:
    out = []
    for branches in lists:
        groups = unite([(x["s"], int(x["l"]), int(x["b"])) for x in branches])
        out.append([{"s": s, "to": f"({g[0]}|+{len(g) - 1})"} for g in groups if len(g) > 1 for s in g])
    return pd.Series(out)


def templates(urls: DataFrame) -> DataFrame:
    """(host, classed, template, n, n_labelled, n_bad) from urls (host, classed array, bad: 1, 0 or null)."""
    nodes = urls.groupBy("host", "classed").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    known = nodes.groupBy("host").agg(F.sum("n_labelled").alias("known"))
    cut = (F.col("known") == 0) & (F.size("classed") > DEPTH)
    short = F.concat(F.slice("classed", 1, DEPTH - 1), F.array(F.lit("**")))
    nodes = materialize(nodes.join(known, "host").withColumn("t", F.when(cut, short).otherwise(F.col("classed"))).drop("known"), "url-nodes")
    depth = _depth(nodes)
    united = F.pandas_udf(_united, "array<struct<s:string,to:string>>")
    keys = ["host", "prefix", "s"]
    for level in range(depth):
        here = nodes.where(F.size("t") > level).withColumns({"prefix": F.slice("t", 1, level), "s": _at(level)})
        children = here.groupBy(*keys).agg(F.sum("n").alias("own"))
        parents = children.groupBy("host", "prefix").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("kinds"))
        few = F.col("own") < F.greatest(F.lit(RARE_COUNT), RARE_SHARE * F.col("total"))
        rare = children.join(parents, ["host", "prefix"]).where(few & (F.col("kinds") > 1) & ~F.col("s").startswith("{")).select(*keys, F.lit(True).alias("rare"))
        joined = here.join(rare, keys, "left").withColumn("t", F.when(F.col("rare"), _set(level, F.lit("*"))).otherwise(F.col("t"))).select(*nodes.columns)
        nodes = checkpoint(joined.unionByName(nodes.where(F.size("t") <= level)))
    for level in range(depth - 1, -1, -1):
        here = nodes.where(F.size("t") > level).withColumns({"prefix": F.slice("t", 1, level), "s": _at(level)})
        suffixes = here.groupBy(*keys, F.expr(f"slice(t, {level + 2}, size(t))").alias("suffix")).agg(F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
        shapes = suffixes.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.bit_xor(F.xxhash64("suffix")).alias("shape"))
        # a node has few children: all but wildcards and classes hold RARE_SHARE of its urls
        groups = shapes.groupBy("host", "prefix", "shape").agg(F.collect_list(F.struct("s", "l", "b")).alias("branches")).where("size(branches) > 1")
        merged = groups.select("host", "prefix", F.inline(united("branches"))).select(*keys, "to")
        joined = here.join(merged, keys, "left").withColumn("t", F.when(F.col("to").isNotNull(), _set(level, F.col("to"))).otherwise(F.col("t"))).select(*nodes.columns)
        nodes = checkpoint(joined.unionByName(nodes.where(F.size("t") <= level)))
    return nodes.withColumn("template", F.concat(F.lit("/"), F.array_join("t", "/"))).drop("t")


def judge_templates(found: DataFrame) -> DataFrame:
    """(host, template, purity, rejected): the bad rate smoothed towards the host's, which is smoothed towards the table's."""
    by = found.groupBy("host", "template").agg(F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
    hosts = by.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    bad, known = by.agg(F.sum("b"), F.sum("l")).first()
    base = ((bad or 0) + 1) / ((known or 0) + 2)
    host_rate = (F.col("hb") + PRIOR * base) / (F.col("hl") + PRIOR)
    purity = (F.col("b") + PRIOR * host_rate) / (F.col("l") + PRIOR)
    return by.join(hosts, "host").select("host", "template", purity.alias("purity"), (purity > THRESHOLD).alias("rejected"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages.

    labels: (page_id, bad), at most one row an id counts (the worst). Urls that are null or have no :// have an empty host and
    path and share one template. Repeated rows stay, each counts; of branches with equal rates those of smaller names merge first.
    Urls of any length are read whole. Other columns are not read. Without labels nothing is rejected by its template.
    """
    host, path = parse(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("classed", _segments(F.col("path")))
    known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    found = templates(own.join(known, "page_id", "left"))
    judged = found.join(judge_templates(found), ["host", "template"]).select("host", "classed", "template", "purity", "rejected")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    out = own.join(judged, ["host", "classed"]).withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow"))})
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages that show a labelled document, whose id is the number in the url's path."""
    number = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"://[^/?#]*/[^?#]*?(\d{1,18})[^/\d?#]*/?(?:[?#]|$)", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    return shown.join(labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")), "doc_id").select("page_id", "bad")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: host, path, rule and verdict of every page's url."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    pages = pages.select("page_id", "url")
    return judge(pages, labelled_pages(pages, labels)).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
