"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

The total budget (all tokens times `share`) flows down by weights (1 where none is given). A leaf offers
its tokens times `max_epochs`, a node the sum of its leaves' offers. What a node cannot use is shared among
its siblings first, by weight; only what they cannot use either stays with the ancestors, which have already
filled against the sums. Each leaf then takes whole epochs, and of one more epoch a token prefix in an order
seeded by that epoch's number: documents while the tokens before them stay below the rest of the budget, so
a leaf overshoots by less than one document (or the rows equal to it).

Filling a level is a water level: children sorted by offer for each weight are full as long as their offers
and an equal level for the others fit. So each level is one window over siblings, and no tree comes to the
driver. A prefix ends at a key: token sums by (leaf, key slot) tell the slot, and only that slot's rows are
ordered. Rows are then taken by comparing keys, and no text is shuffled unless the leaves outgrow a broadcast.

Defined results: a null lang or source is a leaf of its own, and a source without a number has domain
"other"; null and empty texts have no tokens, and are taken when their key lies in the prefix; rows equal
in doc_id and text share their key and go together; columns besides doc_id, text, lang and source pass
through untouched, whatever their names; an empty table gives an empty table. Tokens are white-space words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.common import stored

LEAF = ("domain", "lang", "source")
#: Names from the root down to a node; weights are by path.
Path = tuple[str | None, ...]
#: The domain of a source by its number modulo their count.
DOMAINS = ("web", "books", "code", "talk")
SLOTS = 4096


def domain_of(source: Column) -> Column:
    """The top of the tree."""
    number = F.regexp_extract(source, r"([0-9]{1,9})\z", 1)
    return F.when(number.rlike("[0-9]"), F.element_at(F.array(*map(F.lit, DOMAINS)), (number.cast("int") % len(DOMAINS) + 1).cast("int"))).otherwise("other")


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def document_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))).cast("binary"))


def epoch_key(document: Column, epoch: Column, seed: int) -> Column:
    """60 bits, uniform, of another order for each epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), document).cast("binary")), 1, 15), 16, 10).cast("long")


def weighted(nodes: DataFrame, depth: int, weights: dict[Path, float]) -> DataFrame:
    """nodes with `w`: the weight of their path of `depth` names."""
    given = [(*path, float(w)) for path, w in weights.items() if len(path) == depth]
    if not given:
        return nodes.withColumn("w", F.lit(1.0))
    names = LEAF[:depth]
    table = nodes.sparkSession.createDataFrame(given, ", ".join(f"_{n} string" for n in names) + ", _w double")
    same = [F.col(n).eqNullSafe(F.col("_" + n)) for n in names]
    return nodes.join(F.broadcast(table), same, "left").withColumn("w", F.coalesce("_w", F.lit(1.0))).drop("_w", *("_" + n for n in names))  # as many rows as the caller gave weights


def filled(nodes: DataFrame, parents: tuple[str, ...]) -> DataFrame:
    """nodes (offer, w, amount of their parent) with amount their own: the parent's, shared by weight up to the offers."""
    siblings = W.partitionBy(*parents)
    so_far = siblings.orderBy("ratio", "offer", *LEAF[len(parents) : len(parents) + 1]).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Weightless nodes get nothing; among the others the node of least offer for its weight is full first.
    nodes = nodes.withColumn("offer", F.when(F.col("w") > 0, F.col("offer")).otherwise(0.0)).withColumn("ratio", F.when(F.col("w") > 0, F.col("offer") / F.col("w")).otherwise(0.0))
    nodes = nodes.withColumn("full", F.sum("offer").over(so_far) + F.col("ratio") * (F.sum("w").over(siblings) - F.sum("w").over(so_far)) <= F.col("amount"))
    spent = F.sum(F.when(F.col("full"), F.col("offer")).otherwise(0.0)).over(siblings)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(siblings)
    return nodes.withColumn("amount", F.when(F.col("full"), F.col("offer")).otherwise(F.least("offer", F.col("w") * (F.col("amount") - spent) / F.nullif(open_weight, F.lit(0.0))))).drop("ratio", "full")


def budgets(leaves: DataFrame, weights: dict[Path, float], share: float, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, whole: tokens) with `amount`: their tokens of the mix."""
    leaves = leaves.withColumn("offer", (F.col("whole") * max_epochs).cast("double"))
    nodes = leaves.groupBy("domain").agg(F.sum("offer").alias("offer"), F.sum("whole").alias("whole"))
    nodes = nodes.withColumn("amount", F.floor(F.sum("whole").over(W.partitionBy()) * share).cast("double"))
    nodes = filled(weighted(nodes, 1, weights), ()).select("domain", F.col("amount").alias("given"))
    below = leaves.groupBy("domain", "lang").agg(F.sum("offer").alias("offer")).join(nodes, "domain").withColumnRenamed("given", "amount")
    below = filled(weighted(below, 2, weights), LEAF[:1]).select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), "amount")
    own = leaves.join(below, F.col("domain").eqNullSafe(F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l"))).drop("_d", "_l")
    return filled(weighted(own, 3, weights), LEAF[:2]).select(*LEAF, "whole", "amount")


def planned(rows: DataFrame, weights: dict[Path, float], share: float, max_epochs: int, seed: int) -> DataFrame:
    """For each leaf of `rows` (domain, lang, source, document, tokens): `full` epochs, and `cut`, the last key of the next one."""
    leaves = stored(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("whole")))
    plan = stored(budgets(leaves, weights, share, max_epochs).withColumn("full", F.floor(F.col("amount") / F.greatest("whole", F.lit(1)) + 1e-9).cast("int")).withColumn("rest", F.col("amount") - F.col("full") * F.col("whole")))
    names = [F.col(n).alias("_" + n) for n in LEAF]
    same = [F.col(n).eqNullSafe(F.col("_" + n)) for n in LEAF]
    open_ = plan.where("rest > 1e-6").select(*names, "full", "rest")
    keyed = rows.join(open_, same).select(*LEAF, "rest", "tokens", epoch_key(F.col("document"), F.col("full") + 1, seed).alias("key"))
    keyed = keyed.withColumn("slot", F.floor(F.col("key") / F.lit((1 << 60) // SLOTS)).cast("int"))
    ahead = W.partitionBy(*LEAF).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)  # at most SLOTS rows a leaf
    slots = keyed.groupBy(*LEAF, "slot", "rest").agg(F.sum("tokens").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    last = slots.where("ahead < rest").groupBy(*LEAF).agg(F.max("slot").alias("slot"), F.max_by("ahead", "slot").alias("ahead"))
    last = last.select(*names, F.col("slot").alias("_slot"), "ahead")
    inside = keyed.join(last, [*same, F.col("slot") == F.col("_slot")]).drop("_slot", *("_" + n for n in LEAF))
    before = W.partitionBy(*LEAF).orderBy("key").rangeBetween(W.unboundedPreceding, -1)
    cuts = inside.withColumn("before", F.col("ahead") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).where("before < rest").groupBy(*LEAF).agg(F.max("key").alias("cut"))
    cuts = cuts.select(*names, "cut")
    return stored(plan.join(cuts, same, "left").select(*LEAF, "full", "cut"))


def tallied(docs: DataFrame, domain: Callable[[Column], Column]) -> DataFrame:
    """doc_id, domain, lang, source, tokens, document: what the plan needs, without texts."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    return stored(docs.select("doc_id", domain(source).alias("domain"), F.col("lang").cast("string").alias("lang"), source.alias("source"), token_count(text).alias("tokens"), document_key(F.col("doc_id"), text).alias("document")))


def copies(full: str, cut: str, key: Column) -> Column:
    """How often a document is taken."""
    return F.col(full) + F.when(key <= F.col(cut), 1).otherwise(0)


def mix(docs: DataFrame, weights: dict[Path, float] | None = None, share: float = 1.0, max_epochs: int = 2, seed: int = 11, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """doc_id, domain, lang, source, epoch, tokens, taken: a row for each epoch that takes the document, or one with taken false."""
    rows = tallied(docs, domain)
    plan = planned(rows, weights or {}, share, max_epochs, seed).select(*(F.col(n).alias("_" + n) for n in LEAF), "full", "cut")
    rows = rows.join(plan, [F.col(n).eqNullSafe(F.col("_" + n)) for n in LEAF])
    rows = rows.withColumn("n", copies("full", "cut", epoch_key(F.col("document"), F.col("full") + 1, seed)))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))))
    return rows.select("doc_id", *LEAF, "epoch", "tokens", (F.col("n") > 0).alias("taken"))


def mixed(docs: DataFrame, weights: dict[Path, float] | None = None, share: float = 1.0, max_epochs: int = 2, seed: int = 11, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The documents that the mix takes, once for each epoch, with their own columns."""
    plan = planned(tallied(docs, domain), weights or {}, share, max_epochs, seed)
    # All of a row travels as one struct, so no column name can clash.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    source, lang = F.col("row.source").cast("string"), F.col("row.lang").cast("string")
    same = domain(source).eqNullSafe(F.col("domain")) & lang.eqNullSafe(F.col("lang")) & source.eqNullSafe(F.col("source"))
    rows = whole.join(plan, same)
    key = epoch_key(document_key(F.col("row.doc_id"), F.col("row.text").cast("string")), F.col("full") + 1, seed)
    rows = rows.select("row", F.explode(F.array_repeat(F.lit(1), copies("full", "cut", key))).alias("taken"))
    return rows.select("row.*")
