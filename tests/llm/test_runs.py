"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shipledger.llm import queries, runs


def brute(words, min_length, min_exponent):
    """Every run, by start, then period."""
    n, found = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(min_length, min_exponent * q):
                if not any(words[s : s + length - p] == words[s + p : s + length] for p in range(1, q)):
                    found.append((s, length, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    words = [rng.choice("ab" if rng.random() < 0.5 else "abcde") for _ in range(rng.randint(0, 90))]
    if words and rng.random() < 0.6:
        a = rng.randrange(len(words))
        p = rng.randint(1, max(1, (len(words) - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    return words + ["x"] + words if rng.random() < 0.3 else words


@pytest.mark.parametrize("limits", [(24, 3), (12, 4), (9, 3), (4, 3), (6, 2), (1, 2)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(limits[0])
    for _ in range(60):
        docs = [[ord(w) for w in some_words(rng)] for _ in range(rng.randint(1, 4))]
        bounds = np.cumsum([0, *map(len, docs)])
        found = runs.document_runs(np.array(sum(docs, []), dtype=np.int64), bounds, *limits)
        assert found == {i: r for i, w in enumerate(docs) if (r := brute(w, *limits))}


def test_long_runs_take_little_time():
    ids = np.array([1] * 40_000 + [2, 3, 4] * 20_000 + list(range(50_000)) * 2, dtype=np.int64)
    assert runs.document_runs(ids, np.array([0, len(ids)]), 24, 3)[0] == [(0, 40_000, 1), (40_000, 60_000, 3)]


def test_least_lcp():
    assert runs.least_lcp(24, 3) == 16 and runs.least_lcp(1, 2) == 1


TEXTS = [None, "", " \t\n", "a b", "go " * 30, "x y z " * 9 + "end", "\x0b".join(["u v"] * 25), "one two\n" * 8 + "one two three", "a " * 24 + "b " * 24 + "a " * 24]


def test_frames(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again", 1), (None, "q " * 40, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string, `a.b` int")
    found = runs.find_runs(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        words = [w.decode() for w in (TEXTS[r.doc_id] if r.doc_id is not None else "q " * 40 or "").encode().split()] if r.doc_id is None or TEXTS[r.doc_id] else []
        expected = brute(words, 24, 3)
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == expected
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in expected)]
        assert r.collapsed == " ".join(kept)
    assert runs.find_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, min_exponent=1)


def test_op12_follows_its_contract(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: rng.choice(TEXTS + [" ".join(some_words(rng) * rng.randint(1, 3)) for _ in range(8)]) for i in range(250)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op12_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    changed = 0
    for r in rows:
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        expected = brute(words, 24, 3)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in expected)]
        assert r.n_runs == len(expected)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in expected))
        assert r.collapsed_sha256 == sha(" ".join(kept))
        best = min(expected, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert changed > 10
