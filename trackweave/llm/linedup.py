"""Line dedup by content-defined chunks of lines, one from every line on and one up to every line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, forget, fresh, let, lookup, saved


@dataclass(frozen=True)
class LineChunks:
    """A passage of lines that repeats goes if it has long_words words, or least_lines lines and least_words words. Words are
    counted as blanks and line feeds plus one. broadcast_rows: hashes of repeated chunks
    broadcast at most; of digests half of it, of line numbers by text twice as many."""

    long_words: int = 50
    least_lines: int = 2
    least_words: int = 10
    broadcast_rows: int = 500_000

    @property
    def most_lines(self) -> int:
        """Lines of the longest chunk: a line counts as one word at least."""
        return max(1, min(max(self.least_lines, self.least_words), self.long_words))


def blanks(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["at"] + 1, chunk["n"]), "\n")


def chunks(lines: Column, rules: LineChunks) -> Column:
    """Array of {at, n, hash}: from each line on, and up to each line, the fewest lines that the rules let go; at counts from 0.

    A line of a passage that the rules let go lies in such a chunk within the passage: if the passage up to the line is not
    long enough, the chunk from the passage's first line on reaches beyond the line, else the chunk up to the line starts
    within. So what the chunks cover is what all passages cover, whatever their neighbours are.
    """
    radix = rules.most_lines + 1

    def fewest(n_words: Column, i: Column, step: int) -> Column:
        total, out = F.lit(0), F
        for n in range(1, rules.most_lines + 1):
            total = total + F.get(n_words, i + step * (n - 1))
            goes = (total >= rules.long_words) | (total >= rules.least_words) if n >= rules.least_lines else total >= rules.long_words
            out = out.when(goes, n)
        return out

    def places(n_words: Column) -> Column:
        on = F.transform(n_words, lambda x, i: let(fewest(n_words, i, 1), lambda n: i * radix + n))
        up = F.transform(n_words, lambda x, i: let(fewest(n_words, i, -1), lambda n: (i - n + 1) * radix + n))
        return F.filter(F.array_union(on, up), lambda x: x.isNotNull())

    def hashed(code: Column) -> Column:
        n = F.pmod(code, F.lit(radix))
        found = F.struct(((code - n) / radix).cast("int").alias("at"), n.cast("int").alias("n"))
        return let(found, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.xxhash64(chunk_text(lines, x)).alias("hash")))

    return F.transform(let(F.transform(lines, lambda x: blanks(x) + 1), places), hashed)


def sent(df: DataFrame, arrays: str, rules: LineChunks) -> DataFrame:
    """df, marked for broadcast if its arrays hold 2 * broadcast_rows numbers at most."""
    return F.broadcast(df) if (df.agg(F.sum(F.size(arrays))).first()[0] or 0) <= 2 * rules.broadcast_rows else df


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: LineChunks = LineChunks()) -> DataFrame:
    """docs with every repeated passage of lines taken out of the text, and a struct column `lines` (by another name if taken):
    n_chunks, n_removed: lines of the text, and those taken out.

    A line goes if it lies in a passage that the rules let go and that has an earlier copy which it does not overlap; of equal
    passages anywhere the one of the smallest (id, place) is the first. So the first of equal lines always stays. Passages count
    as equal by their bytes: a 64-bit hash proposes, the texts decide. Short passages stay (LineChunks). A text that loses all
    lines becomes empty; a null text stays null. Null ids come last. Repeated rows are repeats of each other, told apart by
    row. An empty table gives no rows.
    """
    (name,) = fresh(docs, "lines")
    others = [c(x) for x in docs.columns if x.lower() != text.lower()]
    made = let(F.split(F.coalesce(c(text), F.lit("")), "\n", -1), lambda x: F.struct(x.alias("lines"), chunks(x, rules).alias("chunks")))
    own = (F.struct(*others).alias("doc"), F.monotonically_increasing_id().alias("row"), c(text).isNotNull().alias("there"))
    base = saved(docs.select(*own, made.alias("made")), "chunks")
    groups = base.select(F.explode("made.chunks.hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    groups = saved(groups, "repeated")
    # Only the numbers of chunks meet the repeated hashes; a text moves no more than once for all of its chunks.
    hits = lookup(base.select("row", F.explode("made.chunks").alias("x")).select("row", "x.*"), groups, "hash", "left_semi", rules.broadcast_rows)
    hits = saved(hits.groupBy(F.col("row").alias("h_row")).agg(F.collect_list(F.struct("at", "n", "hash")).alias("hits")), "hits")
    texts = F.transform("hits", lambda x: F.struct(*[x[k].alias(k) for k in ("at", "n", "hash")], chunk_text(F.col("made.lines"), x).alias("chunk")))
    again = base.join(sent(hits, "hits", rules), F.col("row") == F.col("h_row")).select(F.col("doc")[doc_id].cast("long").alias("id"), "row", F.explode(texts).alias("x"))
    again = saved(again.select("id", "row", "x.*"), "again")
    # Within a hash the texts decide; the first place of each is found per task before anything meets. Only then does a digest
    # stand for the text.
    digest = F.unhex(F.substring(F.sha2("chunk", 256), 1, 32))  # 16 bytes
    place = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "row", "at")
    firsts = again.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = saved(firsts.select(digest.alias("same"), "first"), "firsts")
    found = lookup(again.select("row", "at", "n", digest.alias("same")), firsts, "same", "inner", rules.broadcast_rows // 2)
    found = found.where((F.col("row") != F.col("first.row")) | (F.col("at") >= F.col("first.at") + F.col("n")))
    gone = found.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("line"))
    gone = saved(gone.groupBy("row").agg(F.collect_set("line").alias("gone")).withColumnRenamed("row", "g_row"), "gone")
    forget(groups, hits, again, firsts)
    out = base.join(sent(gone, "gone", rules), F.col("row") == F.col("g_row"), "left")
    lines = F.col("made.lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    rest = F.when(F.col("gone").isNull(), lines).otherwise(F.transform(left, lambda i: F.get(lines, i)))
    clean = F.when(F.col("there"), F.array_join(rest, "\n"))
    digest = F.struct(F.size(lines).cast("long").alias("n_chunks"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    out = out.select("doc", clean.alias("clean"), digest.alias("digest"))
    column = lambda x: F.col("clean") if x.lower() == text.lower() else F.col("doc")[x]
    return out.select(*[column(x).alias(x) for x in docs.columns], F.col("digest").alias(name))
