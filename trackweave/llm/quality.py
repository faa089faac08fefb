"""Quality rules on documents and on the hosts that they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, fresh, let, lookup, saved, words

DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


@dataclass(frozen=True)
class QualityRules:
    """min_words, repeat_percent: a document of fewer words, or of more words in repeated windows, fails.
    window: words of a window. host_limit: a host whose shrunk failure rate is above it fails with all documents.
    broadcast_hosts: so many hosts at most are broadcast."""

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    host_limit: float = 0.7
    broadcast_hosts: int = 20_000


def repeated_words(found: Column, window: int) -> Column:
    """How many of the words lie in a window that the array holds twice or more.

    A hash of each window finds the arrays that may hold one; only those sort the windows themselves,
    whose texts decide.
    """
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - (window - 1))
    some = lambda w: let(
        F.transform(starts(w), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(window)])),
        lambda h: F.size(F.array_distinct(h)) < F.size(h),
    )

    def count(w: Column) -> Column:
        entries = F.array_sort(F.transform(starts(w), lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("s"), i.alias("i"))))
        at = lambda e: F.array_sort(
            F.filter(
                F.transform(e, lambda x, k: F.when((x["s"] == F.get(e, k - 1)["s"]) | (x["s"] == F.get(e, k + 1)["s"]), x["i"])),
                lambda i: i.isNotNull(),
            )
        )
        first = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            let(entries, at),
            first,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    return let(found, lambda w: F.when(F.size(w) <= window, 0).when(some(w), count(w)).otherwise(0)).cast("long")


def text_counts(text: Column, rules: QualityRules) -> Column:
    """A struct of the five counts of a text."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w, rules.window).alias("n_repeat_words"),
        ),
    )


def host_verdicts(docs: DataFrame, host: str, failed: str, rules: QualityRules) -> DataFrame:
    """One row per host: documents n, failures f, and whether (f + a) / (n + a + b) is above the limit.

    a and b are those of the beta distribution that has the mean and the variance of the hosts' failure
    rates, weighted by documents (method of moments). One host only, or rates all alike: the prior weighs as
    much as all documents of a mean host. Null is a host of its own.
    """
    hosts = docs.groupBy(c(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(c(failed).cast("long")).alias("f"))
    hosts = saved(hosts, "hosts")
    n, f = F.sum("n"), F.sum("f")
    square = F.sum(F.col("f") * F.col("f") / F.col("n"))
    prior = hosts.agg(n.alias("all_n"), f.alias("all_f"), square.alias("square"), F.count(F.lit(1)).alias("hosts")).select(
        "*", (F.col("all_f") / F.col("all_n")).alias("mean")
    )
    row = prior.withColumn("variance", F.col("square") / F.col("all_n") - F.col("mean") * F.col("mean")).first()
    if not row["all_n"]:
        return hosts.select("host", "n", "f", F.lit(False).alias("host_failed"))
    mean, variance = float(row["mean"]), float(row["variance"] or 0.0)
    weight = row["all_n"] / row["hosts"]
    if row["hosts"] > 1 and variance > 1e-12 and 0 < mean < 1:
        weight = min(max(mean * (1 - mean) / variance - 1, 1.0), weight)
    a, b = mean * weight, (1 - mean) * weight
    rate = (F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.select("host", "n", "f", (rate > rules.host_limit).alias("host_failed"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = QualityRules(), columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns of them), each row with one struct column `quality` (by another name if taken) of DIGEST.

    A null or empty text has no words and so fails min_words. Repeated rows count as often as they come.
    An empty table gives no rows. Other columns pass through whatever their names.
    """
    name, counted, failed, mark, match = fresh(docs, "quality", "q_counts", "q_failed", "q_host_failed", "q_host")
    base = docs.withColumn(counted, text_counts(c(text), rules)).withColumn(
        failed,
        (c(counted)["n_words"] < rules.min_words) | (100 * c(counted)["n_repeat_words"] > rules.repeat_percent * c(counted)["n_words"]),
    )
    kept = docs.columns if columns is None else columns
    base = saved(base.select(*[c(x) for x in dict.fromkeys([*kept, host, counted, failed])]), "quality")
    hosts = host_verdicts(base, host, failed, rules).select(F.col("host").alias(match), F.col("host_failed").alias(mark))
    out = lookup(base, hosts, c(host).eqNullSafe(c(match)), "left", rules.broadcast_hosts)
    bad = F.coalesce(c(mark), F.lit(False))
    digest = F.struct(
        *[c(counted)[k].alias(k) for k in DIGEST[:5]],
        c(failed).alias("base_failed"),
        bad.alias("host_failed"),
        (~c(failed) & ~bad).alias("kept"),
    )
    return out.withColumn(name, digest).select(*[c(x) for x in kept], c(name))
