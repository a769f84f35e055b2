"""Line dedup and sharding against plain versions."""

import zlib
from collections import defaultdict

import numpy as np

from shipledger.llm import line_dedup, sharding

LINES = ["  A repeated line of text", "short", "", "another LINE that repeats \t", "unique line number "]


def brute(docs):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= 10 else None

    order = {None: -(1 << 63)}
    owners = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if key(line):
                owners[key(line)].add(order.get(doc, doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or min(owners[key(x)]) == order.get(doc, doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    docs = [(i, "\n".join([LINES[i % 5], LINES[(i * 3) % 5] + ("" if i % 2 else "x"), f"own line of document {i}", LINES[4] + str(i // 3)])) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "a repeated line of text\nA REPEATED LINE OF TEXT"), (None, "another line that repeats"), (3, "second row of three\nÄ repeated line öf"), (60, "x" * 300000 + "\n" + LINES[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'old' AS n_lines", "2 AS keys")
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        rows = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
        assert rows.columns == ["doc_id", "text", "keys", "n_lines", "n_dropped"]
        found = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows.collect()], key=str)
        assert found == brute(docs)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(5):
        docs = spark.createDataFrame([(i, f"this is line {i} alone\nthis one is everywhere")], "doc_id long, text string")
        lost = runs.add_batch(docs)
        assert lost.count() == (1 if i else 0)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    keys = [r.key for run in runs.runs() for r in run.collect()]
    assert len(keys) == len(set(keys)) == 6


def shards(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS shard", "'x' AS slot")
    return sharding.shard_documents(df, n).collect()


def test_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "wörd " * int(rng.integers(0, 400))) for i in range(600)] + [(None, "x"), (1, None), (2, ""), (2, "")]
    found = shards(spark, rows, 7)
    assert len(found) == len(rows)
    sizes, slots, by_text = np.zeros(7), defaultdict(list), defaultdict(set)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        by_text[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert all(len(s) == 1 for s in by_text.values())


def test_hot_text_is_split(spark):
    rows = [(i, "the same text " * 20) for i in range(3000)] + [(10000 + i, f"text {i} " * 20) for i in range(3000)]
    found = shards(spark, rows, 5)
    sizes = np.bincount([r.shard for r in found], weights=[r.size for r in found], minlength=5)
    assert sizes.max() < 1.02 * sizes.min()


def test_groups_below_a_shard_stay_whole(spark):
    rows = [(i, f"group {i % 6} " * 30) for i in range(1200)] + [(10000 + i, f"text {i} " * 20) for i in range(3000)]
    found = shards(spark, rows, 8)
    by_text, total = defaultdict(list), sum(r.size for r in found)
    for r in found:
        by_text[r.text_crc32].append(r)
    large = [g for g in by_text.values() if len(g) > 100]
    assert len(large) == 6 and all(0.2 < sum(r.size for r in g) * 8 / total < 1 for g in large)
    assert all(len({r.shard for r in g}) == 1 for g in by_text.values())
    sizes = np.bincount([r.shard for r in found], weights=[r.size for r in found], minlength=8)
    assert sizes.max() < 1.02 * sizes.min()


def test_placing_follows_the_dot_product():
    """Every choice again, by a plain search over all shards."""
    rng = np.random.default_rng(2)
    weights = rng.random((40, 3)) * rng.choice([0.05, 0.4, 1.3], size=(40, 1))
    residual, plain = np.ones((5, 3)), [[1.0] * 3 for _ in range(5)]
    chosen = sharding.place_whole(weights, residual)
    assert -1 in chosen and len(set(chosen.tolist())) > 3
    for i in sorted(range(40), key=lambda i: -max(weights[i])):
        room = [s for s in range(5) if plain[s][0] >= weights[i][0]]
        if max(weights[i]) > 1 or not room:
            assert chosen[i] == -1
            continue
        best = max(room, key=lambda s: (sum(a * b for a, b in zip(plain[s], weights[i])), -s))
        assert chosen[i] == best
        plain[best] = [a - b for a, b in zip(plain[best], weights[i])]
    assert np.allclose(residual, plain)
    bundles = rng.random((200, 3)) / 100
    shard = sharding.pack(bundles, residual.copy())
    room = residual[:, 0] - np.bincount(shard, weights=bundles[:, 0], minlength=5)
    before = residual[:, 0].max() - residual[:, 0].min()
    assert room.max() - room.min() <= before


def test_few_and_no_rows(spark):
    assert shards(spark, [], 4) == []
    assert {r.slot for r in shards(spark, [(1, "a"), (2, "b")], 4)} == {0}
