import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackweave.llm.linedup import LineChunks, line_dedup
from trackweave.llm.mixing import Mixture, mix_sources
from trackweave.llm.quality import QualityRules, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    random.seed(5)
    vocabulary = ["a", "b", "c", "däs", "😀x", "#", "$%", "q r"]
    texts = [None, "", " ", "\n\n", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n \n"]
    texts += [random.choice(["", " ", "\t"]) + random.choice([" ", "\n", "  ", "\x0b"]).join(random.choice(vocabulary[: random.randrange(1, 8)]) for _ in range(random.randrange(60))) for _ in range(80)]
    texts.append(" ".join(f"w{i % 4000}" for i in range(9000)))
    docs = frame(spark, texts).withColumns({"quality": F.lit(1), "q_counts": F.lit(2), "N_Words": F.lit(3), "host": F.lit(4)})
    out = quality_rules(docs)
    assert out.columns[:-1] == docs.columns
    got = {r.doc_id: r[-1] for r in out.collect()}
    for i, t in enumerate(texts):
        n = brute_counts(t)
        assert tuple(got[i])[:5] == n, t
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_hosts_that_mostly_fail_lose_all(spark):
    good = " ".join(f"w{i}" for i in range(30))
    sources = ["bad"] * 50 + ["good"] * 60 + ["fine"] * 60 + [None] * 2
    texts = ["too short"] * 48 + [good] * 124
    rows = quality_rules(frame(spark, texts, sources)).select("source", "quality.*").collect()
    assert {r.host_failed for r in rows if r.source == "bad"} == {True} and not any(r.kept for r in rows if r.source == "bad")
    assert all(r.kept for r in rows if r.source != "bad")
    assert quality_rules(frame(spark, []).limit(0)).count() == 0
    assert quality_rules(frame(spark, [good] * 3)).where("quality.kept").count() == 3
    assert quality_rules(frame(spark, ["x"] * 3), rules=QualityRules(min_words=1)).where("quality.kept").count() == 3


LONG = " ".join(f"p{i}" for i in range(60))


def test_repeated_passages_go_and_the_first_stays(spark):
    own = [" ".join(f"d{i}w{k}" for k in range(20)) for i in range(6)]
    texts = [f"{own[0]}\n{LONG}\n{own[1]}", f"{own[2]}\n{own[3]}\n{LONG}", LONG, None, "", "short\nshort", "short\nshort", own[4], f"{own[5]}\n{LONG}\n{LONG}"]
    docs = frame(spark, texts).withColumns({"lines": F.lit(1), "gone": F.lit(2), "row": F.lit(3), "hash": F.lit(4), "same": F.lit(5)})
    out = line_dedup(docs)
    assert out.columns[:-1] == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == texts[0] and got[1] == f"{own[2]}\n{own[3]}" and got[2] == "" and got[3] is None
    assert got[4] == "" and got[5] == got[6] == "short\nshort" and got[7] == own[4] and got[8] == own[5]
    assert line_dedup(frame(spark, []).limit(0)).count() == 0


def test_chunks_survive_shifts(spark):
    random.seed(2)
    block = [" ".join(f"b{i}x{k}" for k in range(8)) for i in range(40)]
    texts = ["\n".join([f"head {i} {k} only here" for k in range(i)] + block) for i in range(4)]
    rows = {r.doc_id: r for r in line_dedup(frame(spark, texts), rules=LineChunks()).collect()}
    assert rows[0].text == texts[0]
    for i in (1, 2, 3):
        left = set(rows[i].text.split("\n")) & set(block)
        assert len(left) < 8, left  # the edges of the block at most
        assert all(f"head {i} {k} only here" in rows[i].text for k in range(i))


def test_line_dedup_equals_brute_force(spark):
    random.seed(9)
    pool = [" ".join(random.choice("abcdefgh") + str(k % 3) for k in range(random.choice([2, 12, 55]))) for _ in range(12)]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randrange(1, 9))) for _ in range(60)]
    out = line_dedup(frame(spark, texts)).collect()
    words = Counter()
    for r in out:
        for x in r.text.split("\n"):
            if len(x.split()) >= 50:
                words[x] += 1
    assert words and max(words.values()) == 1  # long lines are chunks of their own, so each is left once
    assert {x for t in texts for x in t.split("\n") if len(x.split()) >= 50} == set(words)


def brute_line_dedup(texts, rules=LineChunks()):
    """Every passage of lines that the rules let go, of any length, against the first copy of its bytes."""
    split, first, gone = [t.split("\n") for t in texts], {}, [set() for _ in texts]
    for d, lines in enumerate(split):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = "\n".join(lines[i:j])
                n = run.count(" ") + run.count("\n") + 1
                if n >= rules.long_words or (j - i >= rules.least_lines and n >= rules.least_words):
                    at = first.setdefault(run, (d, i))
                    if at[0] != d or i >= at[1] + j - i:
                        gone[d] |= set(range(i, j))
    return ["\n".join(x for k, x in enumerate(lines) if k not in gone[d]) for d, lines in enumerate(split)]


def test_passages_between_other_neighbours_go(spark):
    random.seed(11)
    passages, texts, own = [], [], []
    for n in range(2, 7):
        for size in (3, 12, 30, 49):
            passages.append("\n".join(" ".join(f"p{n}x{size}y{i}z{k}" for k in range(size)) for i in range(n)))
    for copy in range(3):
        for p, passage in enumerate(passages):
            mine = [" ".join(f"u{copy}p{p}l{i}k{k}" for k in range(random.randrange(1, 15))) for i in range(4)]
            own.append("\n".join(mine))
            texts.append("\n".join([*mine[:2], passage, *mine[2:]]))
    got = {r.doc_id: r.text for r in line_dedup(frame(spark, texts)).collect()}
    least = lambda p: passages[p].count(" ") + passages[p].count("\n") + 1 >= 10
    for i, t in enumerate(texts):
        p = i % len(passages)
        assert got[i] == (own[i] if i >= len(passages) and least(p) else t), (i, p)
    assert [got[i] for i in range(len(texts))] == brute_line_dedup(texts)


def test_line_dedup_equals_all_passages(spark):
    random.seed(12)
    pool = [" ".join(random.choice("ab") + str(k) for k in range(n)) for n in (1, 1, 2, 4, 5, 9, 30, 55)] + ["", " "]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randrange(1, 14))) for _ in range(150)] + ["a b c d e f\n" * 5, "x\ny\n" * 12]
    for rules in (LineChunks(), LineChunks(least_lines=3, least_words=7, long_words=20), LineChunks(least_lines=1), LineChunks(broadcast_rows=3)):
        out = {r.doc_id: r for r in line_dedup(frame(spark, texts).repartition(5), rules=rules).collect()}
        assert [out[i].text for i in range(len(texts))] == brute_line_dedup(texts, rules)


def brute_budgets(leaves, weights, budget, epochs):
    """Fills a tree step by step: what full children cannot take goes to their siblings."""

    def share(children, total):
        got, open_ = {}, dict(children)
        while open_:
            w = sum(x[0] for x in open_.values())
            full = {k: c for k, (x, c) in open_.items() if w and c <= total * x / w}
            if not full:
                return got | {k: int(total * x / w) if w else 0 for k, (x, c) in open_.items()}
            got |= full
            total -= sum(full.values())
            open_ = {k: v for k, v in open_.items() if k not in full}
        return got

    w = lambda level, name: weights.get(level, {}).get(name, 1)
    cap = {k: n * epochs for k, n in leaves.items()}
    domains, langs = Counter(), Counter()
    for (d, l, s), n in cap.items():
        domains[d] += n
        langs[d, l] += n
    out = {}
    for d, b in share({d: (w("domain", d), c) for d, c in domains.items()}, min(budget, sum(cap.values()))).items():
        for l, b2 in share({l: (w("language", l), c) for (dd, l), c in langs.items() if dd == d}, b).items():
            for s, b3 in share({s: (w("source", s), c) for (dd, ll, s), c in cap.items() if (dd, ll) == (d, l)}, b2).items():
                out[d, l, s] = b3
    return out


@pytest.mark.parametrize("percent,epochs", [(40, 1), (90, 1), (150, 2), (1000, 3)])
def test_mixture_equals_brute_force(spark, percent, epochs):
    random.seed(percent)
    rows = []
    for i in range(400):
        d, l, s = random.choice(["d0", "d0", "d0", "d1", None]), random.choice(["en", "en", "de"]), random.choice(["a", "b", "c"])
        rows.append((i, " ".join("w" * random.randrange(1, 4) for _ in range(random.randrange(0, 30))), l, s, d))
    rows.append((999, None, "en", "a", "d0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string").withColumns({"mix": F.lit(1), "budget": F.lit(2), "part": F.lit(3)})
    weights = {"domain": {"d1": 3}, "language": {"en": 2}, "source": {"c": 5}}
    mix = Mixture(weights=weights, percent=percent, epochs=epochs, bucket=8)
    out = mix_sources(docs, F.col("domain"), mix=mix)
    assert out.columns[:-1] == docs.columns
    got = out.collect()
    leaves, taken, sizes = Counter(), Counter(), {}
    for r in got:
        k = (r.domain, r.lang, r.source)
        assert r[-1].n_tokens == len((r.text or "").split())
        leaves[k] += r[-1].n_tokens
        taken[k] += r[-1].n_tokens * r[-1].epochs
        sizes[k] = r[-1].budget
    want = brute_budgets(leaves, weights, sum(leaves.values()) * percent // 100, epochs)
    for k in leaves:
        assert abs(sizes[k] - want[k]) <= 2, (k, sizes[k], want[k])
        assert sizes[k] - 30 < taken[k] <= sizes[k], k
        own = [r for r in got if (r.domain, r.lang, r.source) == k]
        passes = sizes[k] // leaves[k]
        assert {r[-1].epochs for r in own} <= {passes, passes + 1}
    again = {r.doc_id: r[-1].epochs for r in mix_sources(docs.repartition(3), F.col("domain"), mix=mix).collect()}
    assert again == {r.doc_id: r[-1].epochs for r in got}


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mix_sources(docs, F.lit("d")).count() == 0
