"""Jaccard self-join of documents over word n-grams by vertical partitioning.

N-grams are 64-bit hashes of words, and their global order is cut into fragments, ranges of the
hash. Every step counts within fragments and sums what the fragments say:

1. Documents with the same set form a class, known by a hash of the set; from here on a class counts once.
2. Screening. A class can only have a partner if enough of its n-grams occur in another class. Each
   fragment counts, for every class, its n-grams there that are shared; the sums decide. Most
   documents end here. An n-gram that several classes of one batch hold is known to be shared
   and sent once, so a common n-gram costs a message per batch, not per document.
3. Clusters. The n-grams of the remaining classes get their document frequency, again by
   fragment. By the prefix principle two similar sets share one of their rarest n-grams; classes that share
   one get into one cluster through the smallest class that holds it. No pair is formed.
4. Counting. A cluster is cut into blocks of bounded size. For two blocks whose set sizes allow a link,
   the overlaps of all pairs are one matrix, the sum of the partial matrices of the fragments; pairs
   that cannot reach the threshold with what is left are dropped in between. What leaves a task is not the
   pairs but the number of links of every class and a forest that connects what is linked.
5. Links join classes into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.components import components
from shipledger.llm.work import numbered, slices, written

#: Rows of a table of ids up to which it is broadcast (8 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Distinct n-gram hashes of texts, sorted."""

    def __init__(self, n: int, limit: int = 200_000):
        self.n, self.limit, self.words = n, limit, _Words()
        self.factors = [int(_ODD[k % 4]) + 2 * (k // 4) for k in range(n)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Words are runs without ASCII white space, A-Z in lower case; fewer than n words are one n-gram."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.words) > self.limit:
            self.words.clear()
        hashes = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        count = max(1, len(words) - self.n + 1)
        mixed = np.full(count, min(len(words), self.n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(self.n, len(words))):
                mixed += hashes[k : k + count] * np.uint64(self.factors[k])
                mixed ^= mixed >> np.uint64(29)
                mixed *= _ODD[1]
            mixed ^= mixed >> np.uint64(32)
            mixed *= _ODD[0]
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Number of the hash range, all of the same width."""
    return ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _classes(n: int):
    """doc_id, n_shingles, class (hash of the set; null for an empty one), short (its first 8 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(n)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, names, short = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingler(text)
                    sizes.append(len(found))
                    names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    short.append(int.from_bytes(names[-1][:8], "little", signed=True) if len(found) else None)
                yield _batch(
                    {"doc_id": (part.column(0), pa.int64()), "n_shingles": (sizes, pa.int64()), "class": (names, pa.binary()), "short": (short, pa.int64())}
                )

    return run


_BATCH_SHINGLES = 1 << 20
SENT = "fragment int, batch long, ids binary, counts binary, prints binary, shared binary, ready binary"


def _send(n: int, fragments: int):
    """Messages to the fragments: for every batch of classes the n-grams that one class of it holds.

    ``ids`` (first 8 bytes of the class) and ``counts`` are the segments, ``prints`` the low 32 bits of
    their n-grams; ``shared`` are n-grams that several classes of the batch hold. ``ready`` (in one
    message per batch) has id, size and number of such n-grams of every class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(n)
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        sets: list[np.ndarray] = []
        have, seen = 0, set()

        def messages() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, sets, have, seen
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            first = np.append(True, every[1:] != every[:-1])
            group = np.cumsum(first) - 1
            alone = (np.bincount(group) == 1)[group]
            local = np.bincount(owner[~alone], minlength=len(sets))
            names = np.array(ids, dtype=np.uint64)
            ready = np.stack([names, np.array([len(s) for s in sets], dtype=np.uint64), local.astype(np.uint64)]).T
            common = every[first & ~alone]
            every, owner = every[alone], owner[alone]
            cuts = np.searchsorted(fragment_of(every, fragments), np.arange(fragments + 1))
            common_cuts = np.searchsorted(fragment_of(common, fragments), np.arange(fragments + 1))
            home = (number >> 32) % fragments
            for f in range(fragments):
                part, mine = every[cuts[f] : cuts[f + 1]], owner[cuts[f] : cuts[f + 1]]
                known = common[common_cuts[f] : common_cuts[f + 1]]
                if not len(part) and not len(known) and f != home:
                    continue
                by_owner = np.argsort(mine, kind="stable")
                owners, counts = np.unique(mine, return_counts=True)
                yield _batch(
                    {
                        "fragment": ([f], pa.int32()),
                        "batch": ([number], pa.int64()),
                        "ids": ([names[owners].tobytes()], pa.binary()),
                        "counts": ([counts.astype("<u4").tobytes()], pa.binary()),
                        "prints": ([part[by_owner].astype("<u4").tobytes()], pa.binary()),
                        "shared": ([known.astype("<u4").tobytes()], pa.binary()),
                        "ready": ([np.ascontiguousarray(ready).tobytes() if f == home else None], pa.binary()),
                    }
                )
            number, ids, sets, have, seen = number + 1, [], [], 0, set()

        for batch in batches:
            for text in batch.column(0):
                found = shingler(text.as_py())
                name = xxhash.xxh3_128_digest(found.tobytes())[:8]
                if not len(found) or name in seen:
                    continue
                seen.add(name)
                ids.append(int.from_bytes(name, "little"))
                sets.append(found)
                have += len(found)
                if have >= _BATCH_SHINGLES:
                    yield from messages()
        if sets:
            yield from messages()

    return run


def _joined(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v or b"", dtype=kind) for v in column.to_pylist()]


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of a fragment: per batch, ids of classes and how many of their n-grams here are shared."""
    fragments, numbers, readies = [], [], []
    ids, counts, prints, shared = [], [], [], []
    for batch in batches:
        fragments += batch.column(0).to_pylist()
        numbers += batch.column(1).to_pylist()
        ids += _joined(batch.column(2), "<u8")
        counts += _joined(batch.column(3), "<u4")
        prints += _joined(batch.column(4), "<u4")
        shared += _joined(batch.column(5), "<u4")
        readies += batch.column(6).to_pylist()
    if not fragments:
        return
    base = [np.uint64(f << 32) for f in fragments]
    key = np.concatenate([p.astype(np.uint64) | b for p, b in zip(prints, base)])
    name = np.concatenate([np.repeat(i, c) for i, c in zip(ids, counts)])
    source = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
    known = np.unique(np.concatenate([s.astype(np.uint64) | b for s, b in zip(shared, base)]))
    order = np.lexsort((name, key))
    key_s, name_s = key[order], name[order]
    # An n-gram is shared if a batch says so or if two classes hold it.
    new_key = np.append(True, key_s[1:] != key_s[:-1]) if len(key_s) else np.zeros(0, dtype=bool)
    new_pair = new_key | np.append(True, name_s[1:] != name_s[:-1])[: len(key_s)]
    group = np.cumsum(new_key) - 1
    classes = np.bincount(group, weights=new_pair) if len(key_s) else np.zeros(0)
    is_shared = np.zeros(len(key), dtype=bool)
    is_shared[order] = (classes > 1)[group] | np.isin(key_s, known)
    source, name = source[is_shared], name[is_shared]
    cuts = np.searchsorted(source, np.arange(len(prints) + 1))
    for i, (number, ready) in enumerate(zip(numbers, readies)):
        own, times = np.unique(name[cuts[i] : cuts[i + 1]], return_counts=True)
        if len(own) or ready is not None:
            yield _batch(
                {
                    "batch": ([number], pa.int64()),
                    "ids": ([own.tobytes()], pa.binary()),
                    "times": ([times.astype("<u4").tobytes()], pa.binary()),
                    "ready": ([ready], pa.binary()),
                }
            )


def _screen(percent: int):
    """Ids of the classes of a batch that may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for answers in batch.column(0).to_pylist():
                ready = next(a["ready"] for a in answers if a["ready"] is not None)
                names, sizes, local = np.frombuffer(ready, dtype="<u8").reshape(-1, 3).T
                order = np.argsort(names)
                total = local[order].astype(np.int64)
                for a in answers:
                    places = np.searchsorted(names[order], np.frombuffer(a["ids"], dtype="<u8"))
                    total[places] += np.frombuffer(a["times"], dtype="<u4")
                keep = 100 * total >= percent * sizes[order].astype(np.int64)
                yield _batch({"short": (names[order][keep].astype(np.int64), pa.int64())})

    return run


SETS = "batch long, ids binary, sizes binary, weights binary, grams binary"


def _pack_sets(n: int):
    """Batches of sets: class (its smallest doc_id), size, weight (documents in it) and n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        number = TaskContext.get().partitionId() << 32
        ids, weights, sets, have = [], [], [], 0

        def pack() -> pa.RecordBatch:
            nonlocal number, ids, weights, sets, have
            columns = {
                "batch": ([number], pa.int64()),
                "ids": ([np.array(ids, dtype="<i8").tobytes()], pa.binary()),
                "sizes": ([np.array([len(s) for s in sets], dtype="<u4").tobytes()], pa.binary()),
                "weights": ([np.array(weights, dtype="<i8").tobytes()], pa.binary()),
                "grams": ([np.concatenate(sets).tobytes()], pa.binary()),
            }
            number, ids, weights, sets, have = number + 1, [], [], [], 0
            return _batch(columns)

        for batch in batches:
            for doc, weight, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = shingler(text)
                ids.append(doc)
                weights.append(weight)
                sets.append(found)
                have += len(found)
                if have >= 1 << 18:
                    yield pack()
        if ids:
            yield pack()

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row["ids"], dtype="<i8"),
        np.frombuffer(row["sizes"], dtype="<u4"),
        np.frombuffer(row["weights"], dtype="<i8"),
        np.frombuffer(row["grams"], dtype="<u8"),
    )


def _ask(fragments: int):
    """Distinct n-grams of a batch with their number of classes and smallest class, by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, _, grams = _unpack(row)
                owner = np.repeat(ids, sizes)
                order = np.lexsort((owner, grams))
                distinct, first, counts = np.unique(grams[order], return_index=True, return_counts=True)
                least = owner[order][first]
                cuts = np.searchsorted(fragment_of(distinct, fragments), np.arange(fragments + 1))
                for f in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[f], cuts[f + 1])
                    yield _batch(
                        {
                            "fragment": ([int(f)], pa.int32()),
                            "batch": ([row["batch"]], pa.int64()),
                            "grams": ([distinct[part].tobytes()], pa.binary()),
                            "counts": ([counts[part].astype("<u8").tobytes()], pa.binary()),
                            "least": ([least[part].astype("<i8").tobytes()], pa.binary()),
                        }
                    )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every message the n-grams that at least two classes hold: frequency and smallest class."""
    numbers, grams, counts, least = [], [], [], []
    for batch in batches:
        numbers += batch.column(1).to_pylist()
        grams += _joined(batch.column(2), "<u8")
        counts += _joined(batch.column(3), "<u8")
        least += _joined(batch.column(4), "<i8")
    if not numbers:
        return
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
    smallest = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(smallest, place, np.concatenate(least))
    start = 0
    for number, own in zip(numbers, grams):
        at = place[start : start + len(own)]
        start += len(own)
        keep = total[at] > 1
        if keep.any():
            yield _batch(
                {
                    "batch": ([number], pa.int64()),
                    "grams": ([own[keep].tobytes()], pa.binary()),
                    "total": ([total[at][keep].tobytes()], pa.binary()),
                    "least": ([smallest[at][keep].tobytes()], pa.binary()),
                }
            )


def _prefixes(percent: int):
    """Per class: size, weight, shared n-grams (sorted), and the hubs of its prefix.

    A partner shares at least ceil(percent * size / 100) n-grams, so it shares one of the first
    size - that + 1 in any order that is the same for all; here the rarest come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, weights, grams = _unpack(row)
                answers = row["answers"] or []
                known = np.concatenate([np.frombuffer(a["grams"], dtype="<u8") for a in answers] or [np.zeros(0, "<u8")])
                total = np.concatenate([np.frombuffer(a["total"], dtype="<u8") for a in answers] or [np.zeros(0, "<u8")])
                least = np.concatenate([np.frombuffer(a["least"], dtype="<i8") for a in answers] or [np.zeros(0, "<i8")])
                order = np.argsort(known)
                known, total, least = known[order], total[order], least[order]
                out: dict[str, list] = {"doc": [], "size": [], "weight": [], "grams": [], "hubs": []}
                ends = np.cumsum(sizes)
                for doc, size, weight, end in zip(ids.tolist(), sizes.tolist(), weights.tolist(), ends.tolist()):
                    own = grams[end - size : end]
                    place = np.searchsorted(known, own)
                    place = np.minimum(place, max(0, len(known) - 1))
                    is_known = known[place] == own if len(known) else np.zeros(size, dtype=bool)
                    own, place = own[is_known], place[is_known]
                    prefix = size - (percent * size + 99) // 100 + 1 - (size - len(own))
                    if prefix <= 0:
                        continue
                    rare = np.lexsort((own, total[place]))[:prefix]
                    out["doc"].append(doc)
                    out["size"].append(size)
                    out["weight"].append(weight)
                    out["grams"].append(own.tobytes())
                    out["hubs"].append(np.unique(least[place[rare]]).tolist())
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield _batch({name: (values, kind) for (name, values), kind in zip(out.items(), kinds)})

    return run


PREFIXES = "doc long, size int, weight long, grams binary, hubs array<long>"
#: Columns of a fragment in a partial matrix, and n-grams and sets of a block.
MATRIX_COLUMNS = 2048
BLOCK_GRAMS, BLOCK_SETS = 1 << 19, 512


def linked(a_sets, b_sets, a_sizes, b_sizes, percent: int, columns: int = MATRIX_COLUMNS) -> np.ndarray:
    """Which sets of two blocks are linked: 100 * intersection >= percent * union."""
    a_all, b_all = np.concatenate(a_sets), np.concatenate(b_sets)
    order = np.intersect1d(a_all, b_all)  # the global order, as far as it matters here
    a_row = np.repeat(np.arange(len(a_sets)), [len(s) for s in a_sets])
    b_row = np.repeat(np.arange(len(b_sets)), [len(s) for s in b_sets])

    def placed(every, row):
        place = np.minimum(np.searchsorted(order, every), max(0, len(order) - 1))
        keep = order[place] == every if len(order) else np.zeros(len(every), dtype=bool)
        place, row = place[keep], row[keep]
        by_place = np.argsort(place, kind="stable")
        return place[by_place], row[by_place]

    a_place, a_row = placed(a_all, a_row)
    b_place, b_row = placed(b_all, b_row)
    overlap = np.zeros((len(a_sets), len(b_sets)), dtype=np.float32)
    sizes = a_sizes[:, None].astype(np.int64) + b_sizes[None, :]
    # 100 * i >= percent * (a + b - i)
    needed = -((-percent * sizes) // (100 + percent))
    left_a = np.bincount(a_row, minlength=len(a_sets)).astype(np.int64)
    left_b = np.bincount(b_row, minlength=len(b_sets)).astype(np.int64)
    for low in range(0, len(order), columns):
        high = min(low + columns, len(order))
        most = overlap + np.minimum(left_a[:, None], left_b[None, :])
        rows = np.flatnonzero((most >= needed).any(axis=1))
        cols = np.flatnonzero((most >= needed).any(axis=0))
        if not len(rows):
            return np.zeros(overlap.shape, dtype=bool)
        parts = []
        for place, row, count in ((a_place, a_row, len(a_sets)), (b_place, b_row, len(b_sets))):
            cut = slice(*np.searchsorted(place, [low, high]))
            matrix = np.zeros((count, high - low), dtype=np.float32)
            matrix[row[cut], place[cut] - low] = 1
            parts.append(matrix)
        left_a -= parts[0].sum(axis=1).astype(np.int64)
        left_b -= parts[1].sum(axis=1).astype(np.int64)
        overlap[np.ix_(rows, cols)] += parts[0][rows] @ parts[1][cols].T
    return (overlap >= needed) & (overlap > 0)


def _count_pairs(percent: int):
    """Links of two blocks: (a, b, links): edges of a forest have b, link counts have links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                same = batch.column(2)[i].as_py()
                blocks = []
                for members in (left, right):
                    blocks.append(
                        (
                            np.array([m["doc"] for m in members], dtype=np.int64),
                            np.array([m["size"] for m in members], dtype=np.int64),
                            np.array([m["weight"] for m in members], dtype=np.int64),
                            [np.frombuffer(m["grams"], dtype="<u8") for m in members],
                        )
                    )
                (a_docs, a_sizes, a_weights, a_sets), (b_docs, b_sizes, b_weights, b_sets) = blocks
                links = linked(a_sets, b_sets, a_sizes, b_sizes, percent)
                if same:
                    np.fill_diagonal(links, False)
                edges = _forest(a_docs, b_docs, links)
                counts = [(d, c) for d, c in zip(a_docs.tolist(), (links @ b_weights).tolist()) if c]
                if not same:
                    counts += [(d, c) for d, c in zip(b_docs.tolist(), (links.T @ a_weights).tolist()) if c]
                rows = [(a, b, None) for a, b in edges] + [(d, None, c) for d, c in counts]
                if rows:
                    yield _batch({n: (list(v), pa.int64()) for n, v in zip(("a", "b", "links"), zip(*rows))})

    return run


def _forest(a_docs: np.ndarray, b_docs: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Edges from linked nodes to the smallest node that links reach within the two blocks."""
    nodes = np.unique(np.concatenate([a_docs, b_docs]))
    at_a, at_b = np.searchsorted(nodes, a_docs), np.searchsorted(nodes, b_docs)
    least = np.arange(len(nodes))
    rows, cols = np.nonzero(links)
    rows, cols = at_a[rows], at_b[cols]
    while True:
        before = least.copy()
        np.minimum.at(least, rows, before[cols])
        np.minimum.at(least, cols, before[rows])
        least = least[least]
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return list(zip(nodes[moved].tolist(), nodes[least[moved]].tolist()))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, fragments: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of ``docs`` (doc_id, text).

    Two rows link when 100 * |intersection| >= ``percent`` * |union| of their sets of word n-grams.
    ``component_id`` is the smallest doc_id reachable by links, ``n_links`` the number of rows linked.
    A row without words is linked with nothing. A row with a null doc_id takes no part in
    links and has a null component. Rows that repeat a doc_id each count by their own text. Other columns
    are ignored; an empty table gives no rows; texts of any length are taken whole.
    """
    spark = docs.sparkSession
    fragments = fragments or slices(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(_classes(n), "doc_id long, n_shingles long, class binary, short long"), "ngram-rows")
    classes = written(
        rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("class", "short")
        .agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("weight")),
        "ngram-classes",
    )
    sent = texts.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(_send(n, fragments), SENT)
    answers = sent.repartitionById(fragments, F.col("fragment")).mapInArrow(
        _count_shared, "batch long, ids binary, times binary, ready binary"
    )
    maybe = (
        answers.groupBy("batch")
        .agg(F.collect_list(F.struct("ids", "times", "ready")).alias("answers"))
        .select("answers")
        .mapInArrow(_screen(percent), "short long")
        .distinct()
    )
    asked = written(
        classes.join(maybe, "short", "left_semi").select("doc", "weight"),
        "ngram-maybe",
    )
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    sets = written(
        texts.withColumnRenamed("doc_id", "doc")
        .join(few, "doc")
        .select("doc", "weight", "text")
        .mapInArrow(_pack_sets(n), SETS),
        "ngram-sets",
    )
    asks = sets.mapInArrow(_ask(fragments), "fragment int, batch long, grams binary, counts binary, least binary")
    known = asks.repartitionById(fragments, F.col("fragment")).mapInArrow(
        _answer, "batch long, grams binary, total binary, least binary"
    )
    by_batch = known.groupBy("batch").agg(F.collect_list(F.struct("grams", "total", "least")).alias("answers"))
    members = written(
        sets.join(by_batch, "batch", "left").mapInArrow(_prefixes(percent), PREFIXES), "ngram-prefixes"
    )
    hubs = members.select(F.col("doc").alias("a"), F.explode("hubs").alias("b"))
    clusters = components(hubs).select(F.col("node").alias("doc"), F.col("root").alias("cluster"))
    level = F.floor(F.log2(F.greatest(F.lit(1), F.col("size")))).cast("int")
    per_block = F.greatest(F.lit(16), F.least(F.lit(BLOCK_SETS), (F.lit(BLOCK_GRAMS) / F.pow(F.lit(2), level)).cast("int")))
    ranked = numbered(
        members.select("doc", "size").join(clusters, "doc").withColumn("level", level),
        ["cluster", "level"],
        [F.col("size").asc(), F.col("doc").asc()],
        "place",
    )
    member = F.struct("doc", "size", "weight", "grams")
    blocks = written(
        ranked.select("doc", "cluster", "level", F.floor(F.col("place") / per_block).cast("long").alias("block"))
        .join(members.select("doc", "size", "weight", "grams"), "doc")
        .groupBy("cluster", "level", "block")
        .agg(F.collect_list(member).alias("members"), F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("sets")),
        "ngram-blocks",
    )
    meta = blocks.select("cluster", F.struct("level", "block").alias("at"), "least", "most", "sets")
    left = meta.select("cluster", *[F.col(c).alias(f"l_{c}") for c in ("at", "least", "most", "sets")])
    right = meta.select("cluster", *[F.col(c).alias(f"r_{c}") for c in ("at", "least", "most", "sets")])
    pairs = left.join(right, "cluster").where(
        (F.col("l_at") <= F.col("r_at"))
        & (100 * F.col("l_most") >= percent * F.col("r_least"))
        & ((F.col("l_at") < F.col("r_at")) | (F.col("l_sets") > 1))
    )
    data = blocks.select("cluster", F.struct("level", "block").alias("at"), "members")
    found = written(
        pairs.select("cluster", "l_at", "r_at")
        .join(data.select("cluster", F.col("at").alias("l_at"), F.col("members").alias("l")), ["cluster", "l_at"])
        .join(data.select("cluster", F.col("at").alias("r_at"), F.col("members").alias("r")), ["cluster", "r_at"])
        .select("l", "r", (F.col("l_at") == F.col("r_at")).alias("same"))
        .mapInArrow(_count_pairs(percent), "a long, b long, links long"),
        "ngram-links",
    )
    roots = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    links = found.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("doc")).agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(roots.withColumnRenamed("node", "doc"), "doc", "left")
        .join(links, "doc", "left")
        .select(
            "class",
            F.coalesce("root", "doc").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    return rows.select("doc_id", "n_shingles", "class").join(by_class, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )
