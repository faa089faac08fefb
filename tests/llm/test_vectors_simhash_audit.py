import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackweave.llm import audit, hardneg, simhash, vectors

# Whole-number vectors


def test_products_are_exact_and_leave_64_bits_with_an_error():
    big = 2.0**31
    q, m = np.array([[big, 1.0]]), np.array([[big, 1.0], [big, 2.0], [big, 3.0], [0.0, 0.0]])
    assert vectors.products(q[:, ::-1], m[:, ::-1]).tolist() == [[2**62 + 1, 2**62 + 2, 2**62 + 3, 0]]
    assert vectors.products(np.array([[2.0**60, -3.0]]), np.array([[2.0, 5.0], [-4.0, 1.0]])).tolist() == [[2**61 - 15, -(2**62) - 3]]
    assert vectors.products(np.array([[3.0, 4.0]]), np.array([[5.0, 6.0]])).tolist() == [[39]]
    with pytest.raises(OverflowError):
        vectors.products(np.array([[2.0**40]]), np.array([[2.0**40]]))
    assert vectors.products(np.zeros((2, 3)), np.zeros((0, 3))).shape == (2, 0)


# Hard negatives


def brute_negatives(rows, k=5, n=3):
    rows = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, anchors = [], {}
    for i, v, y in rows:
        if i % 50 == 0:
            anchors[i] = max(anchors.get(i, (v, y)), (v, y))
    for a, (v, y) in anchors.items():
        ranked = sorted((-dot(v, w), i, z) for i, w, z in rows)
        for p, positive, _ in [r for r in ranked if r[2] == y and r[1] != a][:k]:
            p, found = -p, [(i, -s) for s, i, z in ranked if z != y and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, positive, r + 1, i, p, s) for r, (i, s) in enumerate(found[:n])]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    random.seed(11)
    rows = [(i, [round(random.uniform(-1, 1), 1) for _ in range(6)], random.randrange(3)) for i in range(260)]
    rows += [(None, [1.0] * 6, 1), (300, None, 1), (301, [1.0, None, 0.0], 1), (302, [1.0, float("nan")], 2), (303, [float("inf")], 2), (304, [1.0] * 6, None)]
    rows += [(50, [0.5] * 6, 1), (50, [0.5] * 6, 1), (7, rows[7][1], 0), (400, [], 0), (450, [0.9], 1), (-50, [1.0] * 9, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_negatives([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    for rules in (hardneg.HardNegatives(), hardneg.HardNegatives(anchors=3, block=17, chunk=2)):
        extra = df.withColumns({x: F.lit("x") for x in ("id", "v", "score", "place", "anchor", "rank")})
        got = hardneg.hard_negatives(extra, extra.where("vec_id % 50 = 0"), rules=rules)
        assert sorted(map(tuple, got.collect())) == want
    assert hardneg.hard_negatives(df.limit(0), df.limit(0)).count() == 0 and hardneg.hard_negatives(df, df.limit(0)).count() == 0
    assert len({r[0] for r in want}) > 5


# SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = Counter(k for g in grams for k in range(64) if xxhash.xxh64_intdigest(g, 42) >> k & 1)
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(grams))


def test_code_covers_every_word_and_close_words_meet():
    table = simhash.around()
    sizes = (table >= 0).sum(axis=1)
    assert table.shape[0] == 2048 and {int(x).bit_count() for x in table[:, 0]} == {0, 1, 2, 3} and set(sizes.tolist()) == {1, 6}
    assert all(simhash._remainders(np.array([simhash.GENERATOR << i]))[0] == 0 for i in range(12))
    random.seed(12)
    for _ in range(300):
        x = random.getrandbits(64)
        y = x
        for bit in random.sample(range(64), random.randrange(5)):
            y ^= 1 << bit
        both = [simhash.anchors_of(np.array([v], np.uint64)) for v in (x, y)]
        assert all(sum(home) == 1 for blocks in both for _, _, home in blocks)
        assert any(set(a[h]) <= set(b) for one, two in (both, both[::-1]) for (_, a, h), (_, b, _) in zip(one, two))


def test_spanning_pairs_reach_what_all_links_reach():
    random.seed(13)
    for _ in range(60):
        base = [random.getrandbits(64) for _ in range(3)]
        prints = np.array([random.choice(base) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ random.choice((0, 1 << random.randrange(64))) for _ in range(40)], np.uint64)
        labels = np.array([i if random.random() < 0.7 else random.randrange(40) for i in range(40)])
        half = random.randrange(1, 40)
        links = simhash.spanning(prints[:half], labels[:half], prints, labels)

        def groups(pairs):
            to = {int(x): int(x) for x in labels}
            find = lambda x: x if to[x] == x else find(to[x])
            for a, b in pairs:
                to[find(a)] = find(b)
            return {x: min(y for y in to if find(y) == find(x)) for x in to}

        every = [(int(labels[i]), int(labels[j])) for i in range(half) for j in range(40) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4]
        assert groups(links) == groups(every) and len(links) < len(set(labels.tolist()))


def brute_components(prints):
    """Smallest id reachable, of (id, print); rows without id link nothing."""
    ids = [(i, p) for i, p in prints if i is not None]
    distinct = sorted({p for _, p in ids})
    to = {p: p for p in distinct}
    find = lambda x: x if to[x] == x else find(to[x])
    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 4:
            to[find(a)] = find(b)
    least = {}
    for i, p in ids:
        least[find(p)] = min(least.get(find(p), i), i)
    return [least[find(p)] if p in to else None for _, p in prints]


def test_simhash_equals_brute_force(spark):
    random.seed(14)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.choices(vocabulary, k=random.choice((2, 3, 5, 150, 300)))) for _ in range(60)]
    for t in texts[:25]:
        for _ in range(6):
            words = t.split()
            words[-1] = random.choice(vocabulary)
            texts.append(random.choice((" ", "\t\n", "  ")).join(words).upper())
    texts += [None, "", " \n ", "é ß İ ſ", "É ß İ ſ", "word " * 90000, "word " * 90001, texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "nobody else says this at all here"), (5, texts[9]), (5, texts[5])]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("print", "comp", "fingerprint", "anchor", "id")})
    want = sorted(zip((i for i, _ in rows), (brute_print(t) for _, t in rows), brute_components([(i, brute_print(t)) for i, t in rows])), key=str)
    for rules in (simhash.SimHash(), simhash.SimHash(homes=3, copies=5)):
        got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_duplicates(df, rules=rules).collect()]
        assert sorted(got, key=str) == want
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0
    assert len({x for _, _, x in want}) < 0.8 * len(want)


def test_links_of_random_and_crowded_fingerprints(spark):
    random.seed(15)
    prints = {random.getrandbits(64) for _ in range(300)}
    for center in list(prints)[:3]:
        crowd = {center}
        while len(crowd) < 250:
            crowd.add(random.choice(list(crowd)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
        prints |= crowd
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = {r.print % (1 << 64): r.comp for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "print long"), simhash.SimHash(homes=64, copies=100)).collect()}
    want = brute_components([(x, x) for x in prints])
    groups, other = defaultdict(set), defaultdict(set)
    for x, w in zip(prints, want):
        groups[got[x]].add(x)
        other[w].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values())) and set(got) == prints


# Filter interaction


def brute_audit(rows, labels):
    masks = []
    for i, t, part in rows:
        text = t or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= x <= "Z" for x in text) > 3 * len(text),
            "D": any(x in "#$%&*|" for x in text),
            "E": i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows),
        }
        masks.append((part or "", fails, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out = []
    for part in {m[0] for m in masks}:
        mine, shapley, found = [m for m in masks if m[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order):
                gone, stay = [m for m in left if m[1][f]], [m for m in left if not m[1][f]]
                only = sum(m[1][f] and sum(m[1].values()) == 1 for m in mine)
                redundant = sum(m[1][f] for m in mine) - len(gone)
                found.append([part, "".join(order), step + 1, len(stay), len(gone), redundant, only, sum(m[2] for m in gone), sum(m[3] for m in gone), f])
                shapley[f] += len(gone)
                left = stay
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


def test_filter_audit_equals_brute_force(spark):
    random.seed(16)
    words = ["a", "B", "c#", "d", "é", "Zz", "|", *(f"w{i}" for i in range(300))]
    texts = [" ".join(random.choices(words[: random.choice((3, 40, 307))], k=random.choice((0, 10, 199, 200, 250)))) for _ in range(50)]
    texts += [None, "", *texts[:20], "ABC", "\x0b\x0c a", "x" * 100000 + " y" * 90000]
    rows = [(random.randrange(60), t, random.choice(("en", "de", None, ""))) for t in texts] + [(None, texts[0], "en"), (None, None, None), (3, "twice", "en"), (3, "twice", "fr")]
    labels = [(random.choice((None, *range(60))), random.choice((0, 1, None)), random.choice((0, 1, None))) for _ in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({x: F.lit(1) for x in ("id", "mask", "part", "same", "good", "toxic", "quality")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.filter_masks(docs, marks)).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, labels)
    assert audit.interactions(audit.filter_masks(docs.limit(0), marks.limit(0))).count() == 0


def test_two_filters_and_the_matrices(spark):
    orders, own, by = audit.incidence(5)
    assert len(orders) == 120 and own.shape == (600,) and all(x.shape == (32, 600) and x.dtype == np.int64 for x in by.values())
    masks = spark.createDataFrame([("p", m, m == 3, None) for m in (0, 1, 2, 3, 3)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(masks, "XY").collect()}
    assert got == {("XY", 1): (2, 3, 0, 1, 2, 0, 4), ("XY", 2): (1, 1, 2, 1, 0, 0, 4), ("YX", 1): (2, 3, 0, 1, 2, 0, 4), ("YX", 2): (1, 1, 2, 1, 0, 0, 4)}
    with pytest.raises(ValueError):
        audit.interactions(masks, "XX")
