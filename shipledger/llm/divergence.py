"""How far the sources of a language are from each other in their terms, by in-mapper stripes.

1. Partitions fold whole documents into stripes, one per language and term: the number of documents with the
   term, and its occurrences by source. Every ``held`` bytes of text the stripes of a task are spilled as rows. A stripe of the
   empty term counts the documents of every source, so that sources without a term are known.
2. Stripes are merged by key: a shuffle on (language, term), sorted, of which a task holds one merged stripe at a time.
   Terms in fewer than ``min_docs`` documents of the language go.
3. Merged stripes, in slices of some thousands of terms of a language, meet the totals of the language's sources and
   directly give divergences: per pair of sources the sum over the slice, per source the best terms of the slice.
   Terms that neither source of a pair has give all the same value, so they are counted, not visited. Sums
   are added over slices, the best of the slices ranked.

All arithmetic is on integers: p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipledger.llm.word_cache import parts
from shipledger.llm.work import slices, written

MIN_DOCS = 10
RANKS = 10
#: Bytes of text whose stripes a task holds before they are spilled.
HELD = 1 << 24
#: Terms of a slice of merged stripes.
SLICE_TERMS = 8192
#: Languages up to which the table of their vocabularies is broadcast.
BROADCAST_ROWS = 100_000
#: Cells of the matrix (terms x sources) that are computed at a time.
CELLS = 1 << 20

STRIPE = "lang string, term binary, docs long, sources array<string>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"

_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

#: Bytes of UTF-8 that belong to terms stay, with A-Z in lower case; others become spaces.
_TERM_BYTES = np.array(
    [b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], dtype=np.uint8
)

Stripe = list  # [documents, {source: occurrences}]


def _stripe_rows(stripes: list[tuple[str, bytes, Stripe]]) -> pa.RecordBatch:
    langs, keys, found = zip(*stripes)
    offsets = pa.array(np.cumsum([0, *(len(s[1]) for s in found)]), pa.int32())
    sources = pa.array([source for s in found for source in s[1]], pa.string())
    counts = pa.array([n for s in found for n in s[1].values()], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()),
            pa.array(keys, pa.binary()),
            pa.array([s[0] for s in found], pa.int64()),
            pa.ListArray.from_arrays(offsets, sources),
            pa.ListArray.from_arrays(offsets, counts),
        ],
        schema=_STRIPE,
    )


def term_lists(texts: pa.Array) -> pa.ListArray:
    """The terms of every text and empty strings between them.

    Terms are runs of ASCII letters and characters from U+0080 on, A-Z as a-z.
    """
    texts = pc.cast(texts, pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    spaced = pa.py_buffer(_TERM_BYTES[data])
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), spaced))


def fold(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The stripes of some documents: Arrow's hash tables give terms, languages and sources numbers, sorted numbers give the counts."""
    lists, langs, sources = term_lists(texts), langs.dictionary_encode(), sources.dictionary_encode()
    coded = lists.flatten().dictionary_encode()
    names, size = coded.dictionary, len(coded.dictionary) + 1
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = code != pc.index(names, "").as_py()
    pair, n = np.unique(doc[real] * size + code[real], return_counts=True)
    # Every document also counts once under the empty term, the last number.
    pair = np.concatenate([pair, np.arange(len(texts)) * size + size - 1])
    n = np.concatenate([n, np.ones(len(texts), dtype=np.int64)])
    doc, code = np.divmod(pair, size)
    lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] for x in (langs, sources))
    many = len(sources.dictionary)
    cell = (lang * size + code) * many + source
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    counts, docs = np.add.reduceat(n[order], first), np.diff(np.append(first, len(cell)))
    key, source = np.divmod(cell[first], many)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lang, code = np.divmod(key[begin], size)
    offsets = pa.array(np.append(begin, len(key)), pa.int32())
    names = pa.concat_arrays([names, pa.array([""])])
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(lang)),
            names.take(pa.array(code)).cast(pa.binary()),
            pa.array(np.add.reduceat(docs, begin), pa.int64()),
            pa.ListArray.from_arrays(offsets, sources.dictionary.take(pa.array(source))),
            pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
        ],
        schema=_STRIPE,
    )


def _fold(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def spill() -> Iterator[pa.RecordBatch]:
            columns = [pa.chunked_array([b.column(i) for b in waiting]).combine_chunks() for i in range(3)]
            stripes = fold(*columns)
            for start in range(0, stripes.num_rows, 65536):
                yield stripes.slice(start, 65536)

        for batch in batches:
            start = 0
            for texts in parts(batch.column(2), held):
                waiting.append(pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, len(texts)) for i in (0, 1)), texts], names=["l", "s", "t"]))
                start += len(texts)
                size += pc.sum(pc.binary_length(texts)).as_py()
                if size >= held:
                    yield from spill()
                    waiting, size = [], 0
        if waiting:
            yield from spill()

    return run


def _merge(min_docs: int):
    """Merged stripes of sorted rows; the stripe of the empty term always stays.

    Of a batch, only keys with enough documents are unfolded; the last key is held until the next one comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, bytes, Stripe] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, keys, docs = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            other = pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(keys[1:], keys[:-1]))
            starts = np.concatenate([[0], np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1])
            ends = np.append(starts[1:], batch.num_rows)
            sums = np.add.reduceat(docs, starts)
            wanted = (sums >= min_docs) | (pc.binary_length(keys).to_numpy()[starts] == 0)
            wanted[[0, -1]] = True  # these may go on in other batches
            done = []
            offsets = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
            sources, counts = batch.column(3).flatten(), batch.column(4).flatten()
            for i in np.flatnonzero(wanted).tolist():
                a, b = int(starts[i]), int(ends[i])
                key = (langs[a].as_py(), keys[a].as_py())
                if held is not None and held[:2] != key:
                    done.append(held)
                    held = None
                stripe = held[2] if held is not None else [0, {}]
                stripe[0] += int(sums[i])
                low, length = int(offsets[a]), int(offsets[b] - offsets[a])
                of = stripe[1]
                for source, n in zip(sources.slice(low, length).to_pylist(), counts.slice(low, length).to_pylist()):
                    of[source] = of.get(source, 0) + n
                held = (*key, stripe)
            done = [d for d in done if d[2][0] >= min_docs or d[1] == b""]
            if done:
                yield _stripe_rows(done)
        if held is not None and (held[2][0] >= min_docs or held[1] == b""):
            yield _stripe_rows([held])

    return run


def merged_stripes(docs: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """Stripes of ``docs`` (lang, source, text): lang, term (UTF-8), docs, sources and their counts.

    Kept are terms in at least ``min_docs`` documents of the language; the empty term stands for the documents themselves.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = rows.mapInArrow(_fold(held), STRIPE)
    dealt = partial.repartition(slices(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return written(dealt.mapInArrow(_merge(min_docs), STRIPE), "stripes")


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(10^9 * (counts + 2) / total), where counts + 2 <= total < 9 * 10^15, in 64-bit integers."""
    value, rest = np.zeros(np.broadcast(counts, total).shape, dtype=np.int64), counts + 2
    for _ in range(3):  # three decimal digits at a time, so that nothing overflows
        rest = rest * 1000
        value = value * 1000 + rest // total
        rest = rest % total
    return value + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares, which are below 2^31."""
    return (p - q) ** 2 // (p + q)


def _emit(ranks: int):
    """The stripes of one slice (sorted by term) and the totals of its language, to partial sums and candidates."""

    def run(key, stripes: pa.Table, totals: pa.Table) -> pa.Table:
        order = np.argsort(np.array(totals.column("source").to_pylist(), dtype=object))
        sources = [totals.column("source")[int(i)].as_py() for i in order]
        n_terms = totals.column("n_terms")[0].as_py()
        total = totals.column("occurrences").to_numpy()[order] + 2 * n_terms
        whole = int(total.sum()) - 2 * n_terms * (len(sources) - 1)
        at = {source: i for i, source in enumerate(sources)}
        lang, first = totals.column("lang")[0].as_py(), totals.column("part")[0].as_py() == 0
        size = len(sources)
        sums = np.zeros((size, size), dtype=np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in sources]
        if n_terms:
            absent = shares(np.zeros(size, dtype=np.int64), total)
            apart = divergence(absent[:, None], absent[None, :])
            names = stripes.column("term").to_pylist()
            of, n = stripes.column("sources").combine_chunks(), stripes.column("counts").combine_chunks()
            rows = max(1, CELLS // size)
            for start in range(0, len(names), rows):
                part = of.slice(start, rows)
                cells = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                columns = np.fromiter(map(at.__getitem__, part.flatten().to_pylist()), dtype=np.int64, count=len(cells))
                counts = np.zeros((len(part), size), dtype=np.int64)
                counts[cells, columns] = n.slice(start, rows).flatten().to_numpy()
                p = shares(counts, total[None, :])
                q = shares(counts.sum(axis=1), whole)
                for s in range(size):
                    has = np.flatnonzero(counts[:, s])
                    # A pair that both have is counted once, by the first of them.
                    mine = (counts[has] == 0) | (np.arange(size) > s)[None, :]
                    gains = divergence(p[has], p[has, s][:, None]) - apart[s][None, :]
                    sums[s] += np.where(mine, gains, 0).sum(axis=0)
                    above = has[p[has, s] > q[has]]
                    values = divergence(p[above, s], q[above])
                    found = [(-int(v), names[start + int(i)]) for v, i in zip(values, above)]
                    best[s] = sorted(best[s] + found)[:ranks]
            sums += sums.T.copy()
            if first:
                sums += n_terms * apart
        found = [("pair", s, sources[t], int(sums[s, t])) for s in range(size) for t in range(size) if s != t and (first or sums[s, t])]
        found += [("term", s, term.decode("utf-8"), -value) for s in range(size) for value, term in best[s]]
        parts, holders, items, values = zip(*found) if found else ((), (), (), ())
        return pa.Table.from_arrays(
            [
                pa.array([lang] * len(found), pa.string()),
                pa.array([sources[s] for s in holders], pa.string()),
                pa.array(parts, pa.string()),
                pa.array(items, pa.string()),
                pa.array(values, pa.int64()),
            ],
            schema=_FOUND,
        )

    return run


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, held: int = HELD, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """Divergences of the sources of every language of ``docs`` (lang, source, text).

    ``part`` is ``pair`` (``item`` another source of the language, ``value`` the sum of f over all kept terms) or ``term`` (``item``
    a term of the source that is more frequent there than in the language, ``value`` its f; the best ``ranks`` of a source).
    ``rank`` counts from 1 per lang, source and part, by value descending, then item in UTF-8 order. Nulls are empty
    strings; repeated rows are documents of their own; a source without terms takes part; the only source of a
    language has no pair; an empty table gives no rows; other columns are ignored.
    """
    if min_docs < 1 or ranks < 1:
        raise ValueError("min_docs and ranks must be positive")
    stripes = merged_stripes(docs, min_docs, held)
    empty = F.col("term") == F.lit(b"")
    kept = stripes.where(~empty)
    groups = stripes.where(empty).select("lang", F.explode("sources").alias("source"))
    occurrences = (
        kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
        .groupBy("lang", F.col("c.sources").alias("source"))
        .agg(F.sum("c.counts").alias("occurrences"))
    )
    vocabulary = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms")), "vocabulary")
    totals = groups.join(occurrences, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0)
    totals = written(totals, "totals")
    # One row per language; only many are not broadcast, and then the join splits a skewed language.
    sizes = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_ROWS else vocabulary
    # Terms go to slices by hash: about slice_terms each, by the size of the vocabulary.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / slice_terms)).cast("int")
    sliced = kept.join(sizes, "lang").withColumn("part", F.pmod(F.xxhash64("term"), parts).cast("int"))
    repeated = totals.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    found = (
        sliced.select("lang", "part", "term", "sources", "counts")
        .groupBy("lang", "part")
        .cogroup(repeated.select("lang", "part", "source", "occurrences", "n_terms").groupBy("lang", "part"))
        .applyInArrow(_emit(ranks), FOUND)
    )
    found = written(found, "divergences")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = summed.withColumn("rank", F.row_number().over(place))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks))
