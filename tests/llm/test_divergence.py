"""Source divergence against whole counts in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shipledger.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def brute(rows, min_docs, ranks):
    """The rows of the result, by whole counts."""
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        found = [t.translate(LOWER) for t in TERM.findall(text)]
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, seen in df.items():
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        groups = sorted(s for a, s in counts if a == lang)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in groups}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n[s] + 2 * len(kept)) for t in kept} for s in groups}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in groups) + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", best, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def result(spark, rows, **limits):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, part string, `a.b` int")
    found = divergence.source_divergence(docs.repartition(3), **limits)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def some_rows(rng, count):
    words = ["the", "The", "été", "ß", "漢字", "x1y", "a_b", "don't", "\x7fq", "ÉCOLE", "[z]", "end."] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(count):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice(["s1", "s1", "s2", "é", None, f"rare{rng.randint(0, 3)}"])
        text = None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        rows.append((lang, source, text))
    return rows


@pytest.mark.parametrize("limits", [{}, {"min_docs": 3, "ranks": 2, "held": 300, "slice_terms": 4}, {"min_docs": 1, "ranks": 100}])
def test_equals_whole_counts(spark, limits):
    rows = some_rows(random.Random(len(limits)), 120)
    rows += [("de", "one", "ein wort"), ("it", "a", None), ("it", "b", ""), ("long", "a", "go " * 5000), ("long", "b", "gone " * 3000 + "go")]
    assert result(spark, rows, **limits) == brute(rows, limits.get("min_docs", 10), limits.get("ranks", 10))


def test_small_cells(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 5)
    rows = some_rows(random.Random(9), 80)
    assert result(spark, rows, min_docs=2) == brute(rows, 2, 10)


def test_repeated_rows_and_empty_tables(spark):
    rows = [("en", "a", "same words")] * 10 + [("en", "b", "other words")]
    assert result(spark, rows) == brute(rows, 10, 10)
    assert result(spark, rows[:1]) == [] and brute(rows[:1], 10, 10) == []
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(docs).count() == 0
    with pytest.raises(ValueError):
        divergence.source_divergence(docs, min_docs=0)


def test_shares_of_large_counts():
    counts, total = np.array([0, 10**13, 8 * 10**15], dtype=np.int64), 9 * 10**15 - 1
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
