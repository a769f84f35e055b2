"""N-gram join, components, top-k search and decontamination against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from shipledger.llm import decontaminate, ngram_join, topk
from shipledger.llm.components import components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_components(rows, n, percent):
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 3000))
    passage = [word() for _ in range(60)]
    rows, doc = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.choice([3, 4, 5, 30, 80, 200]))] + (passage if group % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((doc, " ".join(copy)))
            doc += rng.randint(1, 4)
    rng.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One Two"), (9004, "one\ttwo"), (9005, "oné two"), (9006, "ONÉ two"), (9007, "same"), (9007, "same")]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(spark, n, percent):
    rows = corpus()
    df = spark.createDataFrame(rows + [(None, "one two")], "doc_id long, text string").selectExpr("*", "1 AS class", "'y' AS doc")
    found = ngram_join.jaccard_components(df, n, percent).collect()
    assert [r.n_shingles for r in found if r.doc_id is None] == [len(shingles("one two", n))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found if r.doc_id is not None)
    assert got == brute_components(rows, n, percent)


def test_ngram_join_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    rng = random.Random(1)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for doc in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"x{rng.randint(0, 9999)}"
        rows.append((doc, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(df, 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_ngram_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(df).count() == 0


def test_partial_matrices_agree_with_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 250)).astype(np.uint64)) for _ in range(40)]
    sets += [s[:-1] for s in sets[:20] if len(s) > 1]
    sizes = np.array([len(s) for s in sets])
    for columns in (7, 64, 4096):
        links = ngram_join.linked(sets, sets, sizes, sizes, 60, columns)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert links[i, j] == (both > 0 and 100 * both >= 60 * (len(a) + len(b) - both))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5), (100, 200)] + [(1000, 2000 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, 1000: 1000, **{2000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_topk(vectors, queries, k):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and usable(v)]
    out = []
    for q, qv in whole:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in whole if i != q and len(v) == len(qv))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 30])).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(15)] + [(400, [0.0] * 8), (401, None), (402, []), (403, [1.0] * 7 + [None]), (404, [float("nan")] * 8), (405, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (500, [1.0, 2.0]), (501, [2.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS block", "2 AS norm")
    ids = {0, 100, 200, 300, 400, 401, 402, 500}
    for block_rows in (4096, 20):
        found = topk.exact_top_k(df, df.where(df.vec_id.isin(sorted(ids))), k=10, block_rows=block_rows, query_rows=3)
        assert sorted(tuple(r) for r in found.collect()) == brute_topk(vectors, ids, 10)
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_pruning_keeps_what_reaches_the_bound():
    rng = np.random.default_rng(8)
    q, x = np.floor(rng.normal(size=(5, 16)) * 200), np.floor(rng.normal(size=(400, 16)) * 200)
    scores = q @ x.T
    bounds = np.sort(scores, axis=1)[:, -7]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    at_q, at_x = topk.survivors(q, x, bounds, axes)
    kept = set(zip(at_q.tolist(), at_x.tolist()))
    assert {(i, j) for i, j in zip(*np.nonzero(scores >= bounds[:, None]))} <= kept
    assert len(kept) < 0.6 * scores.size


ITEM = "Alpha beta, gamma delta: epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."


def test_leaks(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(f"z{rng.randint(0, 999)}" for _ in range(n))
    items = [(1, ITEM), (2, "two words"), (3, None), (4, ""), (5, ITEM.upper()), (6, filler(40))]
    docs = [
        (1, f"{filler(50)} {ITEM.lower()} {filler(30)}"),
        (2, filler(200)),
        (3, ITEM.replace(",", "\n\n")),
        (4, "just TWO - words"),
        (5, "alpha beta gamma delta epsilon " + filler(30)),
        (6, None),
        (7, ""),
        (8, f"{filler(5)} {' '.join(ITEM.split()[1:])} {filler(9)}"),
        (None, ITEM),
        (9, items[5][1]),
        (9, items[5][1]),
        (10, filler(30000) + " " + ITEM),
    ]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS item_id", "1 AS words", "2 AS _key", "3 AS `a.b`")
    items_df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'n' AS n_words")
    found = decontaminate.find_leaks(docs_df, items_df).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    exact = {(d, i) for d in (1, 3, None, 10) for i in (1, 5)} | {(4, 2), (9, 6)}
    assert got - {(8, 1), (8, 5)} == exact
    assert all(r.similarity == 1.0 for r in found if r.doc_id != 8)
    assert [r.first_word for r in found if (r.doc_id, r.item_id) == (1, 1)] == [50]
    clean = decontaminate.drop_leaks(docs_df, items_df)
    assert clean.columns == docs_df.columns
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id != 8) == [2, 5, 6, 7]
    for none in (decontaminate.find_leaks(docs_df.limit(0), items_df), decontaminate.find_leaks(docs_df, items_df.limit(0))):
        assert none.count() == 0


def test_simhash_counts_bits_either_way(spark):
    rng = random.Random(7)
    rows = [([f"w{rng.randint(0, 30)}" for _ in range(n)],) for n in (0, 1, 2, 40, 126, 127, 128, 600)]
    df = spark.createDataFrame(rows, "words array<string>")
    both = df.selectExpr("size(words) AS n", f"{decontaminate.simhash('words')} AS a", f"{decontaminate.simhash('words', 0)} AS b").collect()
    assert len(both) == 8 and all(r.a == r.b for r in both) and len({r.a for r in both}) == 8


def brute_leaks(spark, docs, items, similarity, radius):
    """Best window of every document for every item, over all windows of all documents."""
    split = lambda text: [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    windows = []
    for d, text in docs:
        words = split(text)
        for n in {len(split(t)) for _, t in items} - {0}:
            windows += [(d, n, at, words[at : at + n]) for at in range(max(1, len(words) - n + 1)) if words]
    rows = windows + [(-1 - i, 0, 0, split(t)) for i, (_, t) in enumerate(items) if split(t)]
    df = spark.createDataFrame(rows, "d long, n int, at int, words array<string>")
    prints = {(r.d, r.n, r.at): r.p for r in df.selectExpr("d", "n", "at", f"{decontaminate.simhash('words')} AS p").collect()}

    def bag(words):
        k = decontaminate.SHINGLE
        return Counter([" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)])

    best = {}
    for i, (item, text) in enumerate(items):
        own = bag(split(text))
        for d, n, at, words in windows:
            if split(text) and n == len(split(text)):
                other = bag(words)
                both = sum(len(s) * c for s, c in (own & other).items())
                share = both / sum(len(s) * c for s, c in (own | other).items())
                far = ((prints[d, n, at] ^ prints[-1 - i, 0, 0]) & (2**64 - 1)).bit_count()
                if share >= similarity and far <= radius:
                    best[d, item] = max(best.get((d, item), (0, 0)), (share, -at))
    return {key: (-at, round(share, 9)) for key, (share, at) in best.items()}


def test_every_window_within_the_radius_is_found(spark):
    rng = random.Random(12)
    vocabulary = [f"{c}{d}" * rng.randint(1, 4) for c in "abcdefgh" for d in "xyzuvw"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [some(n) for n in (60, 40, 40, 15, 5, 3, 60)] + [["again", "and"] * 15, []]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = []
    for t in texts:
        half = len(t) // 2
        changed = list(t)
        if not t:
            docs.append((len(docs), ""))
            continue
        for _ in range(max(1, len(t) // 30)):
            changed[rng.randrange(len(t))] = "other"
        at = rng.randrange(len(t) + 1)
        for words in (t, t[half:] + t[:half], changed, t[:at] + ["put", "in"] + t[at:], t[:at] + t[at + 2 :], t[1:], t + t, t[: len(t) * 4 // 5]):
            docs.append((len(docs), " ".join(some(rng.randint(0, 9)) + words + some(rng.randint(0, 9)))))
            docs.append((len(docs), " ".join(words)))
    expected = brute_leaks(spark, docs, items, decontaminate.SIMILARITY, decontaminate.RADIUS)
    assert len(expected) > 40
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 9)) for r in found.collect()} == expected


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(9)
    radius = decontaminate.RADIUS
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        signed = [x - (1 << 64) if x >> 63 else x for x in (a, b)]
        rows.append(tuple(signed))
    pairs = spark.createDataFrame(rows, "a long, b long")
    agree = pairs.selectExpr(f"arrays_overlap({decontaminate.blocks('a', radius)}, {decontaminate.blocks('b', radius)}) AS x")
    assert agree.where("NOT x").count() == 0
