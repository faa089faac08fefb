import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackweave.llm import bpe, chat, neardup, secret_scan, topk, warc

DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 5}") for i, t in enumerate(texts)], DOCS)


# Secrets


def brute_spans(text):
    out = []
    kinds = (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    )
    for k, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def test_secret_spans_equal_brute_force(spark):
    random.seed(4)
    parts = ["token", "API_KEY", "password", "secret", "=", ":", " ", '"', "abcdefgh", "xy", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "é😀", "\n", "pass", "wd", "deadbeef"]
    texts = [None, "", "token = token: abcdefghijk", "AKIAAKIAAKIAAKIA", "a" * 40, "x" * 5000 + " token=abcdefgh1"]
    texts += ["".join(random.choice(parts) for _ in range(random.randrange(1, 30))) for _ in range(150)]
    docs = frame(spark, texts).withColumns({"row": F.lit(1), "v": F.lit(2), "secrets": F.lit(3), "hash": F.lit(4)})
    out = secret_scan.secret_scan(docs)
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r[-1].spans] for r in out.collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


def test_values_of_many_owners_are_shared(spark):
    texts = ["token=commonvalue123"] * 6 + ["token=onlyonehere99", "secret: aaaaaaaaaaaa", "nothing"]
    rows = {r.doc_id: r.secrets for r in secret_scan.secret_scan(frame(spark, texts)).collect()}
    assert [rows[i].n_shared for i in range(9)] == [1] * 6 + [0, 1, 0] and rows[6].n_live == 1 and rows[6].spans[0].verdict == "live"


def test_spans_carry_owners_and_repositories(spark):
    rows = [(i, "token=commonvalue123 secret: onlyonehere99" if i == 4 else "token=commonvalue123", f"l{i}", f"s{i % 2}") for i in range(6)]
    out = secret_scan.secret_scan(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: [(x.verdict, x.owners, x.repos) for x in r.secrets.spans] for r in out.collect()}
    assert got == {i: [("live", 2, 6)] + [("live", 1, 1)] * (i == 4) for i in range(6)}


# Chat


def test_formatted_conversations_read_back(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "a\\</s>\\\\<s>", None, "", "\n[INST]\n", "[\\INST]<s><s>"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(hard)] + [(2, 5, None, "x"), (2, None, "assistant", "y"), (2, 5, None, "x"), (None, 1, "system", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.linear_trees(df))
    got = {r.conv_id: r for r in chat.conversation_digests(out).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert set(got) == {1, 2, None}
    for conv, turns in want.items():
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), digest)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in out.collect():
        assert all(r.formatted[m.end :].startswith("</s>") for m in r.mask)
    assert chat.formatted(chat.linear_trees(df.limit(0))).count() == 0


def test_best_branches(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (1, 6, 3, 1.0), (2, 1, 99, None), (3, 1, 2, 1.0), (3, 2, 1, 1.0)]
    nodes += [(4, i, i - 1 if i else None, 1.0) for i in range(70)]
    nodes += [(5, 1, None, 1.0), (5, 2, 3, 1.0), (5, 3, 4, 1.0), (5, 4, 2, 1.0), (5, 5, 4, 1.0), (5, None, 1, 1.0), (6, 1, 1, 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    paths = defaultdict(list)
    for r in chat.best_paths(df, best=2).orderBy("place").collect():
        paths[r.tree, r.path_rank].append(r.node)
    assert paths[1, 1] == [1, 2, 4] and paths[1, 2] == [1, 3, 5] and paths[2, 1] == [1]
    assert paths[4, 1] == list(range(70)) and paths[5, 1] == [1]
    assert {t for t, _ in paths} == {1, 2, 4, 5}  # trees 3 and 6 are cycles only


def test_repeated_nodes_and_clashing_columns(spark):
    nodes = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "low"), (1, 2, 1, 3.0, "assistant", "high"), (1, 2, 1, 3.0, "assistant", "high"), (1, 3, 1, 2.0, None, None)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double, role string, text string").withColumns({x: F.lit(1) for x in ("place", "leaf", "mask", "t", "n")})
    out = chat.formatted(df, chat.Branches(best=5)).orderBy("path_rank").collect()
    assert [(r.leaf, r.formatted) for r in out] == [(2, "<s>[INST]user[/INST]q</s>[INST]assistant[/INST]high</s>"), (3, "<s>[INST]user[/INST]q</s>[INST][/INST]</s>")]


# WARC


def test_archives_read_back(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc"
    html = ["<a>", None, "", "<a>", trap, trap, "é" * 9000, "b" * 70000] + [f"page {i}" for i in range(60)]
    pages = spark.createDataFrame([(100 - i, f"http://x/{i} y\r\n", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    rules = warc.Archives(file_bytes=20000, split_bytes=3000, header_bytes=2000)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, folder, rules=rules)
    got = {r.page_id: tuple(r)[1:] for r in warc.read_archives(spark, manifest, folder, rules).collect()}
    first = {}
    for i, t in enumerate(html):
        first[t or ""] = min(first.get(t or "", 999), 100 - i)
    for i, t in enumerate(html):
        data, p = (t or "").encode(), 100 - i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        f = first[t or ""]
        assert got[p] == (len(data), digest, "response" if f == p else "revisit", None if f == p else f)
    assert len(got) == len(html)
    none = warc.write_archives(pages.limit(0), folder + "0")
    assert warc.read_archives(spark, none, folder + "0").count() == 0


def test_negative_repeated_and_null_page_ids(spark, tmp_path):
    rows = [(-5, None, "a"), (-5, "u", "a"), (3, "u", "a"), (3, "u", "b"), (None, "u", "a"), (7, "u", None)]
    pages = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "page_id long, url string, html string, page int, payload int, sha1 int, first int")
    folder = f"file://{tmp_path}/warc"
    got = warc.read_archives(spark, warc.write_archives(pages, folder), folder).collect()
    want = [(-5, 1, "response", None)] * 2 + [(3, 1, "revisit", -5), (3, 1, "response", None), (None, 1, "response", None), (7, 0, "response", None)]
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_headers_beyond_what_a_task_reads_at_first(spark, tmp_path):
    rows = [(i, "http://x/" + "é " * (40000 if i % 7 == 3 else 5) + str(i), f"page {i} WARC/1.1\r\n") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    rules = warc.Archives(file_bytes=400000, split_bytes=1000, header_bytes=500)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, folder, rules=rules)
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read_archives(spark, manifest, folder, rules).collect()}
    assert got == {i: (len(html), "response") for i, _, html in rows}
    with pytest.raises(ValueError, match="in the manifest"):
        warc.read_archives(spark, manifest.withColumn("records", F.col("records") + 1), folder, rules)


def test_damaged_headers_are_no_records():
    assert warc.parse_header(b"WARC/1.1\r\nContent-Length: x\r\n\r\n", 0) is None
    assert warc.parse_header(b"WARC/1.1\r\nno colon\r\n\r\n", 0) is None
    assert warc.parse_header(b"WARC/1.1\r\nContent-Length: 3", 0) is None


# Byte-level BPE


def test_bpe_equals_the_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(6)
    texts = [None, "", " ", "  a", "it's we'll  x  y\n\n z", "\x00\x1c\x85 é😀ñ漢字 12345", "a" * 300, "ab" * 200 + "c", "   \t\n" * 50, "The quick brown fox"]
    texts += ["".join(chr(random.choice([32, 32, 97, 101, 105, 110, 116, 115, 233, 0x4E00, 0x1F600, 39, 48, 10])) for _ in range(random.randrange(1, 80))) for _ in range(60)]
    out = bpe.encode_texts(frame(spark, texts), path, public_tokenizers.PATTERN, keep_ids=True, rules=bpe.Encoding(shards=3, batch=7))
    got = {r.id: r for r in out.collect()}
    for i, text in enumerate(texts):
        ids = t.encode_ordinary(text or "")
        assert got[i].ids == ",".join(map(str, ids)), text
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    for word in (b"", b"a", b"abababababab", b"th" * 40, bytes(range(256))):
        if word:
            assert bpe.merged_by_heap(word, ranks) == t._encode_single_piece(word)


def test_bpe_fold_looks_each_pair_up_once(spark, tmp_path):
    import base64
    import re

    random.seed(14)
    ranks = {bytes([i]): 255 - i for i in range(256)}
    while len(ranks) < 900:  # many ties, pairs with one left, and ranks that merges do not reach in order
        ranks.setdefault(random.choice(list(ranks)[95:]) + random.choice(list(ranks)[97:101]), len(ranks))
    ranks[b"abc" * 9] = 65535
    path = tmp_path / "own.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(k).decode()} {v}" for k, v in ranks.items()))
    starts, slots = bpe.rank_rows(pairs := bpe.pairs_of(ranks))
    assert sum(x > 0 for x in slots) == len(pairs)
    assert all(slots[starts[(k >> 16) + 1] + (k & 65535) + 1] == (k >> 16) + 1 << bpe.ID_BITS | v + 1 for k, v in pairs.items())
    words = {"".join(random.choice("abcd\x00é" if i % 3 else "abc") for _ in range(random.randrange(1, 55))) for i in range(300)} | {"abc" * 9, "a" * 64, "z"}
    frame = spark.createDataFrame([(w,) for w in words], "word string").select("word", bpe.merged(F.col("word"), str(path)).alias("ids"))
    for r in frame.collect():
        assert r.ids == bpe.merged_by_heap(r.word.encode(), ranks), r.word
    plan = re.sub(r"\d+(,\d+)+", "", frame._jdf.queryExecution().analyzed().toString())
    assert plan.count("get(") <= 32 and "xxhash64" not in plan  # these are interpreted for every merge of every word; were 88 and 32


# Near duplicates


def brute_components(texts, k):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("partners", [16, 0])
def test_components_equal_brute_force(spark, partners):
    random.seed(8)
    base = [[f"w{random.randrange(500)}" for _ in range(120)] for _ in range(5)]
    texts = {0: None, 1: "", 2: "One Two", 3: "one two", 4: "one  two\tthree", 5: "x"}
    for i in range(6, 150):
        words = list(random.choice(base))
        for _ in range(random.randrange(9)):
            words[random.randrange(len(words))] = f"n{random.randrange(9999)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, n int, digest int")
    rules = neardup.NearDup(shingle=4, partners=partners, block=16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, rules=rules).collect()}
    assert got == brute_components(texts, 4)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, "a b c d e"), (5, "a b c d e"), (5, "other words here now"), (3, "other words here now"), (None, "a b c d e"), (None, "x y"), (None, "x y"), (9, long), (8, long + " z"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("id", "n", "digest", "keys", "rep")})
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, rules=neardup.NearDup(shingle=4)).collect()), key=str)
    want = [(5, 2, 5, True)] * 2 + [(5, 1, 3, False), (3, 1, 3, True), (None, 2, 5, False)] + [(None, 1, None, True)] * 2 + [(9, 29997, 8, False), (8, 29998, 8, True), (4, 0, 4, True)]
    assert got == sorted(want, key=str)


def test_sketches_agree_with_the_probability_of_similarity():
    keys = neardup.mixed(np.arange(1, 2 * 288 + 1, dtype=np.uint64))
    rng = np.random.default_rng(1)
    for size, share in ((1, 1.0), (3, 1 / 3), (1000, 0.8)):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        if size == 1:
            b = a
        elif size == 3:
            a, b = np.append(a[:1], a[1:2]), np.append(a[:1], a[2:])
        else:
            b = np.concatenate((a[: size * 8 // 9], rng.integers(0, 2**63, size - size * 8 // 9).astype(np.uint64)))
        x, y = neardup.sketch(np.unique(a), 288, keys), neardup.sketch(np.unique(b), 288, keys)
        assert not (x == neardup.EMPTY).any() and abs((x == y).mean() - share) < 0.12


# Top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(12)] + [(400, None, 0), (401, [1.0, None] + [0.0] * 6, 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] + [0.0] * 7, 0)]
    rows.append(rows[5])
    rows += [(7, rows[9][1], 0), (7, rows[0][1], 0), (None, rows[0][1], 0)]  # other vectors of one id, and no id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    v = [(i, np.floor(256 * np.array(e)).astype(np.int64)) for i, e, _ in rows if i is not None and i < 400]
    want = []
    for q, x in v:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in v if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for rules in (topk.TopK(), topk.TopK(queries=4, block=40)):
        got = topk.top_k(df.repartition(4), df.where("vec_id % 50 = 0"), rules=rules)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    few = df.where("vec_id in (0, 50, 51)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# Pipeline


def test_pipeline_catches_copies_and_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    random.seed(12)
    words = lambda n, tag: [f"{tag}{random.randrange(10**6)}" for _ in range(n)]
    passage = " ".join(words(70, "p"))
    clean = ["\n".join(" ".join(words(30, f"c{i}x")) for _ in range(3)) for i in range(40)]
    near = [list(words(200, "n"))]
    copy = list(near[0])
    copy[5] = "changed"
    rows = clean + [clean[0], " ".join(near[0]), " ".join(copy), "too short", f"{clean[3][:0]}{' '.join(words(40, 'q'))}\n{passage}", f"{' '.join(words(40, 'r'))}\n{passage}", None]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "byte_bpe"]
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in kept.collect()}
        if name != "byte_bpe":
            assert kept.columns == docs.columns
    assert set(range(len(rows))) - set(seen["quality_rules"]) == {43, 46}
    lines = seen["line_dedup"]
    assert all(lines[i].text == rows[i] for i in range(40)) and lines[44].text == rows[44]
    assert passage not in lines[45].text and lines[45].n_chars == len(lines[45].text)
    assert set(lines) - set(seen["near_duplicates"]) <= {40, 42} and 42 not in seen["near_duplicates"]
    assert set(seen["byte_bpe"]) == set(seen["mix_sources"]) <= set(seen["near_duplicates"])
    for i, r in seen["byte_bpe"].items():
        assert r.decoded_sha256 == hashlib.sha256(seen["mix_sources"][i].text.encode()).hexdigest()


def test_ranges_of_archives_are_read_by_a_stated_number_of_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 30) for i in range(400)], "page_id long, url string, html string")
    rules, folder = warc.Archives(split_bytes=200, ranges=100), f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, folder, rules=rules)
    ranges = sum(-(-r.size // 200) for r in manifest.collect())
    out = warc.read_archives(spark, manifest, folder, rules)
    tasks = -(-ranges // 100)
    assert ranges > 1000 and f"RepartitionByExpression [path#" in out._jdf.queryExecution().toString() and out.count() == 400
    assert f", {tasks}\n" in out._jdf.queryExecution().optimizedPlan().toString() and tasks > 4
