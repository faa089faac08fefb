"""Mixing sources to target weights: budgets down a tree of domain, language and source, and seeded token prefixes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import c, fresh, lookup, saved, words

LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mixture:
    """weights: level, then name, to an integer weight; what is not named weighs 1, so alike. percent: the budget in hundredths
    of the available tokens, or budget: its tokens. epochs: times that a leaf may be read at most. seed: of the order in
    each epoch. bucket: rows of a leaf that are put in order together, about. broadcast_leaves, broadcast_rows:
    leaves and rows at the end of prefixes broadcast at most."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    percent: int = 100
    budget: int | None = None
    epochs: int = 4
    seed: int = 7
    bucket: int = 4096
    broadcast_leaves: int = 20_000
    broadcast_rows: int = 500_000


def weight(level: str, name: Column, given: Mapping[str, Mapping[str, int]]) -> Column:
    out: Column | None = None
    for key, w in sorted(given.get(level, {}).items()):
        out = F.when(name == key, w) if out is None else out.when(name == key, w)
    return (F.lit(1) if out is None else out.otherwise(1)).cast("decimal(19,0)")


def shared_out(children: DataFrame, parents: list[str]) -> DataFrame:
    """children (parents..., budget of the parent, weight, cap, key) with `got`, whole tokens of the budget.

    The largest common rate at which nobody gets more than its cap: in the order of cap / weight, a child is full if all before
    it and it itself being full leave the rest at least its rate. What full children cannot take goes to their siblings in
    proportion to weight; only a shortage of all siblings would reach the parent, whose cap is the sum of theirs.
    """
    share = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double"))
    by = Window.partitionBy(*parents).orderBy(F.asc_nulls_last(share), "key")
    before = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = by.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    d = "decimal(38,0)"
    x = children.withColumns({
        "filled": F.sum("cap").over(before),
        "later": F.coalesce(F.sum("weight").over(after), F.lit(0)).cast("decimal(19,0)"),
    })
    full = F.col("filled").cast("double") + share * F.col("later").cast("double") <= F.col("budget").cast("double")
    x = x.withColumn("full", F.coalesce(full, F.lit(False)))
    x = x.withColumns({
        "taken": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole),
        "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(whole),
    })
    rest = (F.col("budget") - F.col("taken")).cast("decimal(19,0)")
    part = F.floor((rest.cast("double") * F.col("weight").cast("double")) / F.greatest(F.col("open"), F.lit(1)).cast("double"))
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.lit(0), F.least(F.col("cap"), part.cast(d))))
    return x.withColumn("got", got.cast("long"))


def leaf_budgets(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """domain, language, source, tokens, docs and budget of leaves (domain, language, source, tokens, docs)."""
    d = "decimal(19,0)"
    some = lambda level: weight(level, F.col(level), mix.weights) > 0
    caps = leaves.withColumn("cap", F.when(some("source"), F.col("tokens") * mix.epochs).otherwise(0).cast(d))
    langs = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap"))
    langs = langs.withColumn("cap", F.when(some("language"), F.col("cap")).otherwise(0).cast(d))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("cap", F.when(some("domain"), F.col("cap")).otherwise(0).cast(d))
    total = leaves.agg(F.sum("tokens").alias("tokens")).first().asDict() | domains.agg(F.sum("cap").alias("cap")).first().asDict()
    budget = mix.budget if mix.budget is not None else (total["tokens"] or 0) * mix.percent // 100
    budget = min(budget, int(total["cap"] or 0))
    top = domains.select("domain", "cap", F.lit(budget).cast(d).alias("budget"), weight("domain", F.col("domain"), mix.weights).alias("weight"), F.col("domain").alias("key"), F.lit(0).alias("root"))
    top = shared_out(top, ["root"]).select("domain", F.col("got").cast(d).alias("budget"))
    on = F.col("domain").eqNullSafe(F.col("d"))
    mid = langs.join(top.withColumnRenamed("domain", "d"), on).drop("d")
    mid = mid.withColumns({"weight": weight("language", F.col("language"), mix.weights), "key": F.col("language")})
    mid = shared_out(mid, ["domain"]).select(F.col("domain").alias("d"), F.col("language").alias("l"), F.col("got").cast(d).alias("budget"))
    low = caps.join(mid, on & F.col("language").eqNullSafe(F.col("l"))).drop("d", "l")
    low = low.withColumns({"weight": weight("source", F.col("source"), mix.weights), "key": F.col("source")})
    return shared_out(low, ["domain", "language"]).select(*LEVELS, "tokens", "docs", F.col("got").alias("budget"))


def mix_sources(
    docs: DataFrame, domain: Column, language: str = "lang", source: str = "source", doc_id: str = "doc_id", text: str = "text", mix: Mixture = Mixture()
) -> DataFrame:
    """docs, each row with a struct column `mix` (by another name if taken): n_tokens (words), epochs (whole passes over its
    leaf plus one if it is in the prefix of the next), budget (of its leaf).

    A leaf's partial epoch takes rows in an order seeded by epoch, id and text while their tokens fit: the first row
    that does not fit ends the prefix. The order is by hash; a leaf is cut into ranges of it whose sums say in which range the
    prefix ends, and only that range is sorted, so that no leaf is gathered. Nulls are names of their own; rows
    without words have no tokens and come with whatever prefix reaches them; repeated rows keep their own places. No rows, no rows.
    """
    (name,) = fresh(docs, "mix")
    row, tokens, at = "m_row", "m_tokens", "m_at"
    order = F.xxhash64(F.lit(mix.seed), c(doc_id).cast("string"), c(text))
    own = (F.struct(*[c(x) for x in docs.columns]).alias("doc"), domain.alias("m_domain"), c(language).alias("m_language"), c(source).alias("m_source"))
    marked = docs.select(*own, F.monotonically_increasing_id().alias(row), F.size(words(c(text))).cast("long").alias(tokens), order.alias(at))
    marked = saved(marked, "mix")
    leaf = (F.col("m_domain").alias("domain"), F.col("m_language").alias("language"), F.col("m_source").alias("source"))
    leaves = saved(marked.groupBy(*leaf).agg(F.sum(c(tokens)).alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    plan = leaf_budgets(leaves, mix)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("docs") / mix.bucket, F.lit(1.0))))).cast("int")
    plan = plan.withColumns({"passes": passes, "bits": bits}).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    plan = saved(plan, "plan")

    named = plan.select(*[F.col(k).alias(f"p_{k}") for k in LEVELS], *[F.col(k).alias(f"p_{k}") for k in ("passes", "bits", "rest", "budget")])
    on = leaf[0].eqNullSafe(F.col("p_domain")) & leaf[1].eqNullSafe(F.col("p_language")) & leaf[2].eqNullSafe(F.col("p_source"))

    def placed(df: DataFrame) -> DataFrame:
        """df with its leaf's plan, the place of each row in the order of its leaf's last epoch, and the range of that."""
        out = lookup(df, named, on, "inner", mix.broadcast_leaves)
        out = out.withColumn("p_place", F.xxhash64(c(at), F.col("p_passes") + F.lit(mix.seed)))
        return out.withColumn("p_range", F.when(F.col("p_bits") == 0, 0).otherwise(F.expr("shiftrightunsigned(p_place, 64 - p_bits)")).cast("long"))

    key = placed(marked.drop("doc"))
    by = ["p_domain", "p_language", "p_source"]
    sums = key.groupBy(*by, "p_range").agg(F.sum(c(tokens)).alias("n"), F.first("p_rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("p_range"))
    sums = sums.withColumn("upto", upto).withColumn("left", F.col("rest") - F.col("upto") + F.col("n"))
    part = F.when(F.col("n") <= F.col("left"), "all").when(F.col("left") > 0, "some")
    sums = saved(sums.withColumn("part", part).where("part is not null"), "ranges")
    ends = sums.select(*[F.col(x).alias(f"s{x[1:]}") for x in (*by, "p_range")], "left", "part")
    inside = (F.col("p_range") == F.col("s_range")) & F.col("p_domain").eqNullSafe(F.col("s_domain"))
    inside = inside & F.col("p_language").eqNullSafe(F.col("s_language")) & F.col("p_source").eqNullSafe(F.col("s_source"))
    edge = lookup(key, ends.where("part = 'some'"), inside, "inner", mix.broadcast_leaves)
    fits = F.sum(c(tokens)).over(Window.partitionBy(*by).orderBy("p_place", row)) <= F.col("left")
    edge = saved(edge.select(c(row).alias("e_row"), fits.alias("e_fits")).where("e_fits"), "edge")
    out = lookup(placed(marked), ends.select("s_domain", "s_language", "s_source", "s_range", "part"), inside, "left", mix.broadcast_leaves)
    out = lookup(out, edge.select("e_row"), c(row) == F.col("e_row"), "left", mix.broadcast_rows)
    more = F.when((F.col("part") == "all") | F.col("e_row").isNotNull(), 1).otherwise(0)
    digest = F.struct(c(tokens).alias("n_tokens"), (F.col("p_passes") + more).cast("long").alias("epochs"), F.col("p_budget").alias("budget"))
    return out.select("doc", digest.alias("digest")).select(*[F.col("doc")[x].alias(x) for x in docs.columns], F.col("digest").alias(name))
