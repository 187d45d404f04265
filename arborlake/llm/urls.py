"""URL verdicts: explicit host and path rules, and beyond them a tree of path templates for each host.

Urls that a rule decides are the labels. Each path is cut into segments; a slash at its end is none. Segments that vary by form (numbers,
long hexadecimal or mixed tokens) are kept by their first character and ending alone. Then the children of every
node of a host's tree are compared: those with at least `enough` labels are put in order of their labelled
rate, in `bins` steps, and neighbours whose rates do not differ (two proportions, |z| < `z`) are one branch.
Varying children become the wildcard "*", which also takes those with too few labels, but for branches that
differ from the largest ("*~1", ...); other children merge into "?" (which no segment can be) or stay by
themselves, as those with too few labels do. Statistics, not the number of children, merge branches.

A host's tree has few labels, so trees are also grown for the domains around the host (a.b.example.com,
b.example.com, example.com), by the same rule. A template's purity is smoothed by `weight` pseudo-urls towards
the purity of the path's template in the next larger domain, and there towards that of all domains, where each
domain that has labels counts once; without any, towards `prior`. A template is rejected when its purity
reaches `reject`. So a path that is blocked on some hosts of a domain is evidence for the others, and one
domain's is weak evidence for another one.

All of it is a fixed number of joins and aggregates over distinct (host, path form) rows, counted on the map
side first; windows run over the at most 2 * `bins` rate steps of a node. Keys are unique on one side of every
join, and that side is written before, so that Spark can split the rows of a hot host.

Defined results: null urls and urls without :// have empty host and path, fit no rule and are judged
by the empty host's template; repeated rows keep a row each; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.common import stored

#: (verdict, host, path start)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segment_form(segment: Column) -> Column:
    """Segments that vary by form as "*", first character and file ending; others with "=" ahead where they begin like such."""
    ending = F.regexp_extract(segment, r"\.[A-Za-z]{1,5}\z", 0)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(ending))
    varies = stem.rlike(r"\A[0-9]+\z") | stem.rlike(r"\A[0-9a-fA-F-]{8,}\z") | (stem.rlike(r"[0-9]") & (F.length(stem) >= 12))
    return F.when(varies, F.concat(F.lit("*"), F.substring(stem, 1, 1), ending)).when(segment.rlike(r"\A[*=]"), F.concat(F.lit("="), segment)).otherwise(segment)


def domains(host: Column) -> Column:
    """The host and the domains around it down to two labels, smallest first; an address of numbers has none."""
    labels = F.split(host, r"\.")
    around = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(r"\A[0-9.:]*\z"), F.array(host)).otherwise(around)


def differs(n: Column, b: Column, n2: Column, b2: Column, z: float) -> Column:
    """Two proportions, b of n and b2 of n2."""
    pooled = (b + b2) / (n + n2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / n2))
    return (spread > 0) & (F.abs(b / n - b2 / n2) >= z * spread)


def branches(child: DataFrame, z: float, enough: int, bins: int) -> DataFrame:
    """scope, parent, segment, name, of the children (scope, parent, segment, n, b) that merge or are kept apart."""
    tested = child.where(F.col("n") >= enough).withColumns({"varies": F.col("segment").startswith("*"), "bin": F.least(F.floor(F.col("b") / F.col("n") * bins), F.lit(bins - 1)).cast("int")})
    steps = tested.groupBy("scope", "parent", "varies", "bin").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("members"))
    order = W.partitionBy("scope", "parent", "varies").orderBy("bin")
    begins = F.coalesce(differs(F.col("n"), F.col("b"), F.lag("n").over(order), F.lag("b").over(order), z), F.lit(False))
    steps = steps.withColumn("begins", begins.cast("int")).withColumn("cluster", F.sum("begins").over(order))
    whole = W.partitionBy("scope", "parent", "varies", "cluster")
    steps = steps.withColumns({"all_n": F.sum("n").over(whole), "all_members": F.sum("members").over(whole)})
    rank = F.dense_rank().over(W.partitionBy("scope", "parent", "varies").orderBy(F.desc("all_n"), "cluster")) - 1
    mark = F.when(F.col("rank") == 0, "").otherwise(F.concat(F.lit("~"), F.col("rank")))
    name = F.when(F.col("varies"), F.concat(F.lit("*"), mark)).when(F.col("all_members") > 1, F.concat(F.lit("?"), mark))
    steps = stored(steps.withColumn("rank", rank).select("scope", "parent", "varies", "bin", name.alias("name")).where("name is not null"))
    return stored(tested.join(steps, ["scope", "parent", "varies", "bin"]).select("scope", "parent", "segment", "name"))


def judge(pages: DataFrame, rules: list[Rule], *, teaches: Column | None = None, z: float = 1.96, enough: int = 10, weight: float = 4.0, prior: float = 0.2, reject: float = 0.5, bins: int = 20) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. `teaches`: which pages' rules are labels (all, if none)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), (F.lit(True) if teaches is None else teaches).alias("teaches"), host.alias("host"), path.alias("path")).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    parts = F.split(F.regexp_replace("path", r"\A/|(?<=.)/\z", ""), "/")
    rows = stored(rows.withColumn("form", F.array_join(F.transform(parts, segment_form), "/")))

    label = F.when(F.col("teaches"), F.col("fit.verdict"))
    paths = stored(rows.groupBy("host", "form").agg(F.count(label).alias("n"), F.count(F.when(label == "block", 1)).alias("b")))
    around = paths.select("host", "form", "n", "b", F.posexplode(domains(F.col("host"))).alias("place", "scope"))
    own = stored(around.groupBy("scope", "form").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))

    segments = own.withColumn("segments", F.split("form", "/"))
    nodes = segments.select("scope", "form", "n", "b", F.posexplode("segments").alias("level", "segment"), "segments").withColumn("parent", F.xxhash64(F.slice("segments", 1, F.col("level")))).drop("segments")
    child = stored(nodes.groupBy("scope", "parent", "segment").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    named = nodes.join(branches(child, z, enough, bins), ["scope", "parent", "segment"], "left")
    name = F.coalesce("name", F.when(F.col("segment").startswith("*"), "*").otherwise(F.col("segment")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", name.alias("name")))), lambda x: x["name"]), "/")  # as many as the path has segments
    leaf = stored(named.groupBy("scope", "form").agg(F.concat(F.lit("/"), whole).alias("template"), F.first("n").alias("n"), F.first("b").alias("b")))

    templates = stored(leaf.groupBy("scope", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    outermost = F.element_at(domains(F.col("scope")), -1) == F.col("scope")
    everywhere = templates.where(outermost & (F.col("n") > 0)).groupBy("template").agg(F.count("*").alias("n"), F.sum(F.col("b") / F.col("n")).alias("rate"))
    first = stored(everywhere.select("template", ((F.col("rate") + weight * prior) / (F.col("n") + weight)).alias("everywhere")))
    judged = leaf.select("scope", "form", "template").join(templates, ["scope", "template"]).join(first, "template", "left")
    judged = stored(judged.select("scope", "form", F.struct(F.col("n").alias("n"), F.col("b").alias("b"), "template", F.coalesce("everywhere", F.lit(prior)).alias("everywhere")).alias("t")))
    chain = F.reverse(F.array_sort(F.collect_list(F.struct("place", "t"))))  # one for each domain, the largest first
    smoothed = F.aggregate("chain", F.col("chain")[0]["t"]["everywhere"], lambda p, x: (x["t"]["b"] + weight * p) / (x["t"]["n"] + weight))
    scored = around.select("host", "form", "place", "scope").join(judged, ["scope", "form"]).groupBy("host", "form").agg(chain.alias("chain"))
    scored = stored(scored.select("host", "form", F.element_at("chain", -1)["t"]["template"].alias("template"), smoothed.alias("purity")))
    decided = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.join(scored, ["host", "form"]).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", decided).alias("verdict"), "template", "purity")
