"""Quality of documents by ordinal regression on graded ratings.

Grades are 0 (toxic), 1 (poor) and 2 (good). A cumulative-link model shares one weight vector over
hashed features of the text between all grades and separates them by ordered thresholds:

    P(grade <= k | x) = 1 / (1 + exp(w.x - threshold_k))

It gives the expected grade and the tail probability P(grade >= 2), by which documents are selected.
Features are whether a word or the beginning of one occurs, which share of the tokens have a form
(capitals, digits, marks) and how repetitive the text is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.work import map_rows, unused

BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on at most; taken by hash of their doc_id.
SAMPLE_ROWS = 8192
GRADES = 3
SHARES = [0.003, 0.01, 0.03, 0.1, 0.3, 0.6]
_WORD = re.compile(r"[^\W_]+")


def _bucket(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % BUCKETS


def form(token: str) -> str:
    """What a token looks like: A for words in capitals, a for others, 0 for digits, marks (runs as two)."""
    if token.isalpha():
        return "A" if len(token) > 1 and token.isupper() else "a"
    word = token[:24]
    kept = re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    kept = re.sub(r"\d+", "0", kept)
    return re.sub(r"([^\w\s]|_)\1+", r"\1\1", kept)[:8]


class _Tokens(dict):
    """Form and feature buckets of tokens seen so far."""

    def __init__(self, wanted: np.ndarray | None, limit: int = 150_000):
        super().__init__()
        self.wanted, self.limit = wanted, limit

    def __missing__(self, token: str) -> tuple[str, tuple[int, ...]]:
        if len(self) > self.limit:
            self.clear()
        names = []
        for word in _WORD.findall(token.lower()):
            names.append(_bucket("w|" + word[:40]))
            if len(word) > 5:
                names.append(_bucket("p|" + word[:5]))
            if len(word) > 4:
                names.append(_bucket("p|" + word[:4]))
        if self.wanted is not None:
            names = [b for b in names if self.wanted[b]]
        value = self[token] = (form(token), tuple(names))
        return value


class Features:
    """Distinct feature buckets of a text; with ``wanted`` only those of the model."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.tokens = _Tokens(wanted)
        self.wanted = wanted
        self.shares: dict[tuple[str, int], int] = {}

    def _share(self, name: str, value: float, found: set[int]) -> None:
        for i, least in enumerate(SHARES):
            if value < least:
                break
            key = (name, i)
            bucket = self.shares.get(key)
            if bucket is None:
                if len(self.shares) > 100_000:
                    self.shares.clear()
                bucket = self.shares[key] = _bucket(f"s|{name}|{i}")
            found.add(bucket)

    def __call__(self, text: str | None) -> list[int]:
        tokens = (text or "").split()
        counts, total = Counter(tokens), len(tokens)
        found: set[int] = set()
        forms: dict[str, int] = {}
        for token, count in counts.items():
            shape, buckets = self.tokens[token]
            forms[shape] = forms.get(shape, 0) + count
            if buckets:
                found.update(buckets)
        if total:
            for shape, count in forms.items():
                if shape != "a":
                    self._share(shape, count / total, found)
            self._share("#adjacent", sum(map(eq, tokens, islice(tokens, 1, None))) / total, found)
            self._share("#repeated", 1 - len(counts) / total if total >= 20 else 0.0, found)
            self._share("#top", max(counts.values()) / total if total >= 20 else 0.0, found)
        else:
            found.add(_bucket("#empty"))
        if self.wanted is not None:
            return sorted(b for b in found if self.wanted[b])
        return sorted(found)


@dataclass
class OrdinalModel:
    """Weights of buckets and ordered thresholds; ``buckets`` may be empty when nothing was learnt."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    dense: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.dense = np.zeros(BUCKETS, dtype=np.float64)
        self.dense[self.buckets] = self.weights

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) for every score, in columns."""
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)


def fit_ordinal(
    lengths: np.ndarray, column: np.ndarray, grades: np.ndarray, least_rows: int = 4, least_score: float = 4.0, penalty: float = 0.5, steps: int = 400
) -> OrdinalModel:
    """Fit weights and thresholds by maximum likelihood with an L2 penalty.

    ``column`` holds the buckets of all rows one after the other, ``lengths`` how many each row has.
    Buckets are taken whose rows have a mean grade ``least_score`` standard errors away from that of all rows,
    and at least ``least_rows`` rows; others say nothing and would add up in long texts.
    """
    n = len(lengths)
    none = OrdinalModel(np.zeros(0, dtype=np.int64), np.zeros(0), np.array([-20.0, -10.0]))
    if n == 0 or len(set(grades.tolist())) < 2:
        return none
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    count = np.bincount(column, minlength=BUCKETS)
    mean, spread = grades.mean(), max(1e-9, grades.std())
    total = np.bincount(column, weights=(grades - mean)[row], minlength=BUCKETS)
    score = np.abs(total) / (spread * np.sqrt(np.maximum(1, count)))
    used = np.flatnonzero((count >= least_rows) & (score >= least_score))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[column] >= 0
    x = np.zeros((n, len(used)), dtype=np.float32)
    x[row[keep], place[column[keep]]] = 1
    # Thresholds start from the grades' shares and stay ordered: the first, then positive gaps.
    share = np.clip([(grades <= k).mean() for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.maximum(1e-3, np.diff(start)))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, t0, gaps = params[: len(used)], params[len(used)], np.exp(params[len(used) + 1 :])
        cuts = np.concatenate([[t0], t0 + np.cumsum(gaps)])
        score = (x @ w.astype(np.float32)).astype(np.float64)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -500, 500)))
        padded = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        upper, lower = padded[np.arange(n), grades + 1], padded[np.arange(n), grades]
        chance = np.maximum(1e-12, upper - lower)
        slope_u, slope_l = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        grad_w = x.T @ (slope_u - slope_l).astype(np.float32) + penalty * w
        grad_cuts = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            grad_cuts[k] = -(slope_u[grades == k].sum() - slope_l[grades == k + 1].sum())
        tail = np.cumsum(grad_cuts[::-1])[::-1]
        grad = np.concatenate([grad_w, [tail[0]], tail[1:] * gaps]) / n
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w, t0, gaps = params[: len(used)], params[len(used)], np.exp(params[len(used) + 1 :])
    return OrdinalModel(used, w, np.concatenate([[t0], t0 + np.cumsum(gaps)]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents (labels: doc_id, quality, toxic).

    Labels with a null count for nothing; a text that occurs several times counts once. Without labels
    nothing is learnt and every document with a word passes.
    """
    grade = F.when(F.col("toxic") == 1, 0).otherwise(F.when(F.col("quality") == 1, 2).otherwise(1))
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
        .select("doc_id", grade.alias("grade"))
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        features = Features()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxhash.xxh3_64_intdigest((t or "").encode()) >> 1 for t in texts], pa.int64()),
                    pa.array([features(t) for t in texts], pa.list_(pa.int32())),
                ],
                names=["doc_id", "grade", "text", "features"],
            )

    # At most sample_rows short rows on both ways.
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "grade", "text")
        .mapInArrow(run, "doc_id long, grade int, text long, features array<int>")
        .toArrow()
        .combine_chunks()
    )
    ids, grades, texts = (found.column(n).to_numpy() for n in ("doc_id", "grade", "text"))
    order = np.lexsort((grades, ids, texts))
    order = order[np.append(True, np.diff(texts[order]) != 0)[: len(order)]]
    features = found.column("features").take(pa.array(order))
    lengths = pc.list_value_length(features).to_numpy()
    columns = pc.list_flatten(features).to_numpy()
    return fit_ordinal(lengths, columns, grades[order].astype(np.int64))


def score(
    docs: DataFrame, model: OrdinalModel, grade: str = "expected_grade", tail: str = "tail_probability"
) -> DataFrame:
    """``docs`` with the expected grade and the tail probability P(grade >= 2).

    The columns ``grade`` and ``tail`` replace such columns; all rows and other columns stay; texts are read whole. A text
    that is null, empty or white space has the lowest grade, whatever the model.
    """
    docs = docs.drop(grade, tail)
    at = docs.columns.index("text")
    # The selected buckets and weights: bounded by the number of buckets.
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*shared.value)
        features = Features(model.dense != 0)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sums = np.array([model.dense[features(t)].sum() for t in part.column(at).to_pylist()])
                chances = model.probabilities(sums)
                chances[[not (t and t.strip()) for t in part.column(at).to_pylist()]] = np.eye(GRADES)[0]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(chances @ np.arange(GRADES)), pa.array(chances[:, GRADES - 1])],
                    names=[*part.schema.names, grade, tail],
                )

    return map_rows(docs, run, {grade: "double", tail: "double"})


#: Documents with a smaller chance of the best grade are rejected.
LEAST_TAIL = 0.5


def select(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``docs`` whose tail probability is at least ``least_tail``, with their own columns only."""
    grade, tail = unused("_grade", docs.columns), unused("_tail", docs.columns)
    scored = score(docs, model, grade, tail)
    return scored.where(F.col(tail) >= least_tail).drop(grade, tail)
