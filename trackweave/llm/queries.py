"""The queries of this package, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.audit import filter_masks, interactions
from trackweave.llm.bpe import encode_texts
from trackweave.llm.chat import conversation_digests, formatted, linear_trees
from trackweave.llm.common import saved
from trackweave.llm.hardneg import hard_negatives
from trackweave.llm.linedup import line_dedup
from trackweave.llm.mixing import Mixture, mix_sources
from trackweave.llm.neardup import NearDup, near_duplicates
from trackweave.llm.quality import DIGEST, quality_rules
from trackweave.llm.secret_scan import secret_scan, written
from trackweave.llm.simhash import simhash_duplicates
from trackweave.llm.tokencodec import read_tokens, token_folder, write_tokens
from trackweave.llm.topk import top_k
from trackweave.llm.warc import archive_folder, read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = quality_rules(docs, columns=["doc_id"])
    return judged.select("doc_id", *[F.col("quality")[k].alias(k) for k in DIGEST])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(spark, manifest, folder)


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    folder = token_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, folder, public_tokenizers.path(tokenizer)), folder)


#: Documents carry no domain; their source's number modulo 4 stands for it.
DOMAIN = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0) % 4)"


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mix = Mixture(weights={"language": {"en": 4, "de": 2}, "domain": {"d0": 2}}, percent=80, epochs=2)
    out = mix_sources(docs, F.expr(DOMAIN), mix=mix)
    return out.select("doc_id", "lang", "source", *[F.col("mix")[k].alias(k) for k in ("n_tokens", "epochs", "budget")])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("lines.n_chunks").alias("n_chunks"), F.col("lines.n_removed").alias("n_removed"))


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(say).alias("text")
    )
    return conversation_digests(saved(formatted(linear_trees(rows.unionByName(more)), unique=True), "conversations"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secret_scan(docs)
    spans = F.col("secrets.spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(written(spans), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        F.col("secrets.n_live").alias("n_live"),
        F.col("secrets.n_shared").alias("n_shared"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path(ranks), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), rules=NearDup(shingle=4))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return interactions(filter_masks(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_warc,
        op3_token_files,
        op4_mix_sources,
        op5_line_dedup,
        op6_reply_trees,
        op7_secret_scan,
        op8_byte_bpe,
        op9_near_duplicates,
        op10_top_k,
        op11_hard_negatives,
        op12_simhash,
        op13_filter_audit,
    )
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), base AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM base GROUP BY source
), prior AS (
  SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS variance, sum(n) / count(*) AS w, count(*) AS h FROM hosts
), weight AS (
  SELECT mean, CASE WHEN h > 1 AND variance > 1e-12 AND mean > 0 AND mean < 1
    THEN least(greatest(mean * (1 - mean) / variance - 1, 1.0), w) ELSE w END AS v FROM prior
), verdicts AS (
  SELECT source, (f + mean * v) / (n + mean * v + (1 - mean) * v) > 0.7 AS host_failed FROM hosts, weight
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
  NOT base_failed AND NOT host_failed AS kept
FROM base LEFT JOIN verdicts ON base.source IS NOT DISTINCT FROM verdicts.source
""",
    "op2_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111',
    '1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h[i])]), '') AS b FROM p
), digests AS (
  SELECT page_id, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5 * i + 1] AS INTEGER)
    + 8 * CAST(b[5 * i + 2] AS INTEGER) + 4 * CAST(b[5 * i + 3] AS INTEGER) + 2 * CAST(b[5 * i + 4] AS INTEGER)
    + CAST(b[5 * i + 5] AS INTEGER)]), '') AS d FROM bits
), firsts AS (
  SELECT h, min(page_id) AS f FROM p GROUP BY h
)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > f THEN f END AS refers_to
FROM p JOIN digests USING (page_id) JOIN firsts USING (h)
""",
    "op5_line_dedup": """
WITH w AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: length(x) - length(replace(x, ' ', '')) + 1) AS ws
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), i AS (
  SELECT doc_id, ls, ws, unnest(range(1, len(ls) + 1)) AS i FROM w
), n AS (
  SELECT doc_id, ls, i,
    list_min(list_filter(range(1, 11), lambda n: i + n - 1 <= len(ls) AND list_sum(ws[i:i + n - 1]) >= CASE WHEN n = 1 THEN 50 ELSE 10 END)) AS a,
    list_min(list_filter(range(1, 11), lambda n: i - n >= 0 AND list_sum(ws[i - n + 1:i]) >= CASE WHEN n = 1 THEN 50 ELSE 10 END)) AS b
  FROM i
), c AS (
  SELECT DISTINCT doc_id, "at", n, s FROM (
    SELECT doc_id, i AS "at", a AS n, array_to_string(ls[i:i + a - 1], chr(10)) AS s FROM n WHERE a IS NOT NULL
    UNION ALL SELECT doc_id, i - b + 1, b, array_to_string(ls[i - b + 1:i], chr(10)) FROM n WHERE b IS NOT NULL)
), firsts AS (
  SELECT s, min(struct_pack(d := doc_id, a := "at")) AS f FROM c GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range("at", "at" + n)) AS i FROM c JOIN firsts USING (s) WHERE doc_id <> f.d OR "at" >= f.a + n
), kept AS (
  SELECT doc_id, string_agg(ls[i], chr(10) ORDER BY i) AS t, count(*) AS n FROM i ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text, CAST(len(ls) AS BIGINT) AS n_chunks, CAST(len(ls) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM documents JOIN w USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op6_reply_trees": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<s>', ''))) // 3
    + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '[INST]', ''))) // 6
    + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + length(role) AS n FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + 17) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op7_secret_scan": r"""
WITH kinds AS (
  SELECT * FROM (VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
    (1, 'access', '(())AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '(())[0-9a-f]+', 0, 32)) AS k(o, kind, p, g, least_)
), m AS (
  SELECT doc_id, source, lang, o, kind, least_, regexp_split_to_array(t, p) AS ps,
    regexp_extract_all(t, p, 0) AS ws, CASE WHEN g = 2 THEN regexp_extract_all(t, p, 2) ELSE regexp_extract_all(t, p, 0) END AS vs
  FROM (SELECT *, coalesce(text, '') AS t FROM documents), kinds
), one AS (
  SELECT doc_id, source, lang, o, kind, vs[i] AS v,
    list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS s, length(ws[i]) AS n
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM m) WHERE length(vs[i]) >= least_
), shared AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) >= 3 OR len(list_distinct(string_split(v, ''))) < 6 AS shared FROM one GROUP BY v
), spans AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, o) AS spans,
    count(*) FILTER (NOT shared) AS n_live, count(*) FILTER (shared) AS n_shared
  FROM one JOIN shared USING (v) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM documents d LEFT JOIN spans USING (doc_id)
""",
    "op9_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT r.x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, r.x = min(y) AS kept
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.x GROUP BY r.x
""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
), r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
""",
    "op13_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS f FROM t
), m AS (
  SELECT doc_id, part, CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > f, false) AS INTEGER) AS mask FROM w
), l AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), h AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x AS (
  SELECT unnest(range(5)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i + 1]), '') AS filter_order, CAST(i + 1 AS INTEGER) AS step, o[i + 1] AS own,
    CAST(coalesce(list_sum(list_transform(o[1:i], lambda k: 1 << k)), 0) AS BIGINT) AS before FROM o, x
), r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER ((mask & (before + (1 << own))) = 0) AS kept,
    sum(n) FILTER ((mask >> own) & 1 = 1 AND mask & before = 0) AS removed, sum(n) FILTER ((mask >> own) & 1 = 1 AND mask & before <> 0) AS redundant,
    sum(n) FILTER (mask = 1 << own) AS unique_fails, sum(good) FILTER ((mask >> own) & 1 = 1 AND mask & before = 0) AS good_lost,
    sum(toxic) FILTER ((mask >> own) & 1 = 1 AND mask & before = 0) AS toxic_lost
  FROM h, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM r
""",
}
