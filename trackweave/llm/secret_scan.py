"""Secrets in texts, judged by who else holds them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, fresh, let, saved

# Kind, pattern, group that holds the value, its least length.
KINDS = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)


@dataclass(frozen=True)
class Ownership:
    """shared_owners: a value that so many owners hold is a copied example. distinct_chars: fewer different characters are a placeholder."""

    shared_owners: int = 3
    distinct_chars: int = 6


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of {kind, start, end, value} for the leftmost non-overlapping matches whose value is long enough.

    The pieces between the matches give the offsets, in code points. A match that is too short is passed over, not tried again.
    """
    entry = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"

    def walk(pieces: Column, whole: Column, values: Column) -> Column:
        both = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("p"), whole.alias("w"), values.alias("v"))
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(entry).alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.char_length(x["p"])
            end = start + F.char_length(x["w"])
            found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"))
            return F.struct(
                end.cast("long").alias("at"),
                F.when(F.char_length(x["v"]) >= least, F.concat(a["out"], F.array(found).cast(entry))).otherwise(a["out"]).alias("out"),
            )

        return F.aggregate(both, first, step, lambda a: a["out"])

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda whole: walk(F.split(text, pattern, -1), whole, whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(entry))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By start, then as KINDS lists the kinds, then by end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k[0], i)])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank[x["kind"]].alias("b"), x["end"].alias("e"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def secret_scan(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), rules: Ownership = Ownership()
) -> DataFrame:
    """docs without the text, each row with one struct column `secrets` (by another name if taken): spans, an array of
    {kind, start, end, value, verdict, owners, repos} in order, and n_live, n_shared.

    owners and repos are how many distinct ones hold the value anywhere. Of them only the owners decide: a value is `shared` from
    shared_owners owners on or if it looks like a placeholder, else `live`, in however many repositories of fewer owners. Null owners and repositories count as one each. A null or empty text has
    no spans. Repeated rows are judged alike. A value that very many documents hold is counted per owner and task first.
    """
    (name,) = fresh(docs, "secrets")
    other = [x for x in docs.columns if x.lower() != text.lower()]
    whole = F.coalesce(c(text), F.lit(""))
    found = in_order(F.concat(*[spans_of(whole, *k) for k in KINDS]))
    repo = F.to_json(F.struct(*[c(x).cast("string").alias(f"r{i}") for i, x in enumerate(repository)]))
    own = (F.struct(*[c(x) for x in other]).alias("doc"), c(owner).cast("string").alias("owner"), repo.alias("repo"), F.monotonically_increasing_id().alias("row"))
    base = saved(docs.select(*own, found.alias("spans")), "spans")
    one = base.where(F.size("spans") > 0).select("row", "owner", "repo", F.posexplode("spans").alias("i", "x"))
    one = one.select("row", "owner", "repo", "i", "x", F.sha2(F.col("x.value"), 256).alias("hash"))
    chars = F.size(F.array_distinct(F.split(F.first("value"), "")))
    held = one.groupBy("hash", "owner", "repo").agg(F.first("x.value").alias("value"))
    held = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.first("value").alias("value"))
    held = held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), chars.alias("chars"))
    shared = (F.col("owners") >= rules.shared_owners) | (F.col("chars") < rules.distinct_chars)
    verdicts = saved(held.select("hash", "owners", "repos", F.when(shared, "shared").otherwise("live").alias("verdict")), "verdicts")
    judged = one.join(verdicts, "hash").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "verdict", "owners", "repos"))).alias("v"))
    judged = judged.withColumnRenamed("row", "j_row")
    out = base.join(judged, F.col("row") == F.col("j_row"), "left")
    all_spans = F.transform(
        "spans",
        lambda x, i: F.struct(
            *[x[k].alias(k) for k in ("kind", "start", "end", "value")], *[F.get(F.col("v"), i)[k].alias(k) for k in ("verdict", "owners", "repos")]
        ),
    )
    count = lambda verdict: F.size(F.filter(F.coalesce("v", F.array()), lambda x: x["verdict"] == verdict)).cast("long")
    digest = F.struct(all_spans.alias("spans"), count("live").alias("n_live"), count("shared").alias("n_shared"))
    return out.select("doc", digest.alias("digest")).select(*[F.col("doc")[x].alias(x) for x in other], F.col("digest").alias(name))
