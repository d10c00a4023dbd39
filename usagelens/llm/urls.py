"""URL filters by a path-template tree.

Each url gives a host and a path. Explicit rules decide first. Their verdicts are also the labels by which
the tree judges the other urls: per host, path segments become tree levels; a segment with at least ``SUPPORT`` pages is
literal, the others of a parent are one wildcard. Labelled literal siblings are merged where a two-proportion test can't tell their
purity apart: their pages are summed by purity in ``BINS`` steps, and the steps, from pure to impure, are joined to the branch before
while the test allows. Unlabelled literals stay branches of their own.

A node's block rate is smoothed toward its parent's and, alike, toward that of its template over all hosts, so what is known of
``/es/`` elsewhere reaches an unlabelled ``/es/``. A url is blocked if its template's smoothed rate is over a half. A node is
a leaf, its template ending in ``/**``, once its labels are unanimous, or it has none and those of its template on all hosts are unanimous
or absent, or it is too small for a literal. Else its next level is built, however deep.

All steps are joins and group-bys with partial aggregates; what meets in one group is at most ``BINS + 1`` rows.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by the
corpus rate. Repeated rows are judged alike. Null page ids stay. Ties of rules go to the first by text. Empty segments of a path are skipped;
a very long path costs a level only while many pages share it. Extra columns, whatever their names, are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import checkpoint, table

SUPPORT, BINS, WEIGHT, Z = 3, 20, 4.0, 1.96
#: So many rules become one expression; more are joined by the suffixes of the host.
FEW_RULES = 100

#: (verdict, rule): host, a slash, and how the path begins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, UPPER.lower()), F.regexp_extract(url, _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        top, _, start = rule.partition("/")
        fits.append(F.when(((host == top) | host.endswith("." + top)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def ruled(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The distinct (host, path, n) with the longest rule that fits, or null, and its verdict."""
    if len(rules) <= FEW_RULES:
        blocked = F.col("rule").isin([r for v, r in rules if v == "block"])
        return urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("said", F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")))
    rows = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    known = urls.sparkSession.createDataFrame(rows, "said string, rule string, top string, start string")
    parts = F.split("host", r"\.")
    tops = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fit = urls.select("host", "path", F.explode(tops).alias("top")).join(known, "top").where(F.col("path").startswith(F.col("start")))
    best = fit.groupBy("host", "path").agg(F.min(F.struct(-F.length("rule"), F.col("rule"), F.col("said"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("host", "path", "n", F.col("best.rule").alias("rule"), F.col("best.said").alias("said"))


def rate(bad: Column, all_: Column, *priors: Column) -> Column:
    return (bad + WEIGHT * sum(priors, F.lit(0.0))) / (all_ + WEIGHT * len(priors))


def branches(literal: DataFrame) -> DataFrame:
    """(host, prefix, segment, token): the branch of each labelled literal (host, prefix, segment, good, bad)."""
    seen = F.col("good") + F.col("bad")
    literal = literal.withColumn("bin", F.floor(F.col("bad") * BINS / seen).cast("int"))
    bins = literal.groupBy("host", "prefix", "bin").agg(F.sum("good").cast("double").alias("g"), F.sum("bad").cast("double").alias("b"))
    steps = bins.groupBy("host", "prefix").agg(F.sort_array(F.collect_list(F.struct("bin", "g", "b"))).alias("steps"))

    def joined(done: Column, step: Column) -> Column:
        last = F.element_at(done, -1)
        n, m = last["g"] + last["b"], step["g"] + step["b"]
        pooled = (last["b"] + step["b"]) / (n + m)
        apart = F.abs(step["b"] / m - last["b"] / n) > Z * F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n + 1 / m))
        one = F.array(F.struct(last["bins"].alias("bins"), last["g"].alias("g"), last["b"].alias("b")))
        more = F.array(F.struct(F.concat(last["bins"], F.array(step["bin"])).alias("bins"), (last["g"] + step["g"]).alias("g"), (last["b"] + step["b"]).alias("b")))
        new = F.array(F.struct(F.array(step["bin"]).alias("bins"), step["g"].alias("g"), step["b"].alias("b")))
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.size(done) == 0, new).when(apart, F.concat(before, one, new)).otherwise(F.concat(before, more))

    none = F.array().cast("array<struct<bins:array<int>,g:double,b:double>>")
    groups = steps.select("host", "prefix", F.posexplode(F.aggregate("steps", none, joined)).alias("branch", "group")).select("host", "prefix", "branch", F.explode("group.bins").alias("bin"))
    placed = literal.select("host", "prefix", "segment", "bin").join(groups, ["host", "prefix", "bin"])
    named = placed.groupBy("host", "prefix", "branch").agg(F.min("segment").alias("first"), F.count(F.lit(1)).alias("many"))
    name = F.when(F.col("many") > 1, F.concat("first", F.lit("+"), (F.col("many") - 1).cast("string"))).otherwise(F.col("first"))
    return placed.join(named.select("host", "prefix", "branch", name.alias("token")), ["host", "prefix", "branch"]).select("host", "prefix", "segment", "token")


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, rate) of distinct (host, path, n, good, bad)."""
    whole = urls.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select(F.expr("(coalesce(b, 0) + 1.0) / (coalesce(g, 0) + coalesce(b, 0) + 2.0)").alias("known"))
    hosts = urls.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb")).crossJoin(F.broadcast(whole))  # one row
    hosts = hosts.select("host", rate(F.col("hb"), F.col("hg") + F.col("hb"), F.col("known")).alias("rate"), "known")
    # shape: the path with wildcards, the same on all hosts; known: its rate over all of them.
    rows = urls.join(hosts, "host").withColumns({"prefix": F.lit(""), "shape": F.lit(""), "rest": F.filter(F.split("path", "/"), lambda s: s != "")})
    finished = rows.where(F.size("rest") == 0).select("host", "path", F.col("host").alias("template"), "rate")
    rows = checkpoint(rows.where(F.size("rest") > 0))
    while not rows.isEmpty():
        rows = rows.withColumn("segment", F.get("rest", F.lit(0)))
        kids = rows.groupBy("host", "prefix", "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).where(F.col("n") >= SUPPORT)
        labelled = F.col("good") + F.col("bad") > 0
        tokens = branches(kids.where(labelled)).unionByName(kids.where(~labelled).select("host", "prefix", "segment", F.col("segment").alias("token")))
        rows = rows.join(tokens, ["host", "prefix", "segment"], "left")
        rows = rows.withColumns({
            "prefix": F.concat("prefix", F.lit("/"), F.coalesce("token", F.lit("*"))),
            "shape": F.concat("shape", F.lit("/"), F.when(F.col("token").isNull(), F.lit("*")).otherwise(F.col("segment"))),
            "rest": F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))),
        }).drop("token", "segment")
        shapes = rows.groupBy("shape").agg(F.sum("good").alias("sg"), F.sum("bad").alias("sb"), F.first("known").alias("above"))
        shapes = shapes.select("shape", rate(F.col("sb"), F.col("sg") + F.col("sb"), F.col("above")).alias("known"), ((F.col("sg") > 0) & (F.col("sb") > 0)).alias("mixed"))
        rows = rows.drop("known").join(shapes, "shape")
        nodes = rows.groupBy("host", "prefix").agg(F.sum("n").alias("all"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.first("rate").alias("above"), (F.sum(F.col("known") * F.col("n")) / F.sum("n")).alias("elsewhere"), F.max("mixed").alias("open"))
        leaf = (F.col("all") < SUPPORT) | F.when(F.col("g") + F.col("b") > 0, (F.col("g") == 0) | (F.col("b") == 0)).otherwise(~F.col("open"))
        nodes = nodes.select("host", "prefix", rate(F.col("b"), F.col("g") + F.col("b"), F.col("above"), F.col("elsewhere")).alias("rate"), leaf.alias("leaf"))
        rows = checkpoint(rows.drop("rate", "mixed").join(nodes, ["host", "prefix"]))
        end = F.col("leaf") | (F.size("rest") == 0)
        finished = finished.unionAll(rows.where(end).select("host", "path", F.concat("host", "prefix", F.when(F.size("rest") > 0, F.lit("/**")).otherwise(F.lit(""))).alias("template"), "rate"))
        rows = rows.where(~end).drop("leaf")
    return finished


def judged(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, rate) for each row."""
    rules = RULES if rules is None else rules
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"))
    urls = checkpoint(ruled(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), rules))
    count = lambda v: F.when(F.col("said") == v, F.col("n")).otherwise(F.lit(0).cast("long"))
    found = templates(urls.select("host", "path", "n", count("allow").alias("good"), count("block").alias("bad")))
    out = rows.join(urls.select("host", "path", "rule", "said"), ["host", "path"]).join(found, ["host", "path"])
    verdict = F.coalesce("said", F.when(F.col("rate") > 0.5, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id), "host", "path", "rule", verdict.alias("verdict"), "template", "rate")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
