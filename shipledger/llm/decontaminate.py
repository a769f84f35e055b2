"""Documents that hold passages of a benchmark, by SimHash of item-sized windows.

1. Shingles of ``SHINGLE`` words of all documents are looked up among those of the benchmark. A window as similar
   to an item as asked holds that share of the item's weight in such shingles, wherever they stand. So the weight of
   these shingles is summed over windows of each item size, by running sums over the places where one enters or
   leaves, and every start is looked at whose sum is large enough for the lightest item of the size.
2. Windows and items get a 64-bit SimHash of their words. Fingerprints are cut into
   ``radius + 1`` blocks; two that differ in at most ``radius`` bits agree in a whole block, so a join on
   (size, block, value) finds all of them, and the exact distance is checked.
3. Candidates are verified by exact weighted-shingle similarity: the weighted Jaccard of the two bags
   of shingles, a shingle weighing as much as it has characters.

Everything is Column code. Documents with the same text are looked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipledger.llm.work import unused, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 11
#: Rows of a key table up to which it is broadcast (8 to 16 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

KEY = ["_hash", "_chars"]
_WORDS = "filter(split(lower(coalesce(text, '')), r'[^\\p{L}\\p{N}]+', -1), w -> w <> '')"


def _checked(keys: DataFrame) -> DataFrame:
    """A broadcast hint for a written table that its count shows to be small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _shingles(size: int, words: str = "words") -> str:
    """SQL for the hashes of all runs of ``size`` words."""
    others = "".join(f", get({words}, i + {k})" for k in range(1, size))
    return f"slice(transform({words}, (w, i) -> xxhash64({size}, w{others})), 1, greatest(0, size({words}) - {size - 1}))"


def _bag(words: str) -> str:
    """SQL for the shingles of a window as texts; a shorter window is one shingle."""
    return f"""IF(size({words}) < {SHINGLE}, IF(size({words}) = 0, array(), array(array_join({words}, ' '))),
      transform(sequence(1, greatest(1, size({words}) - {SHINGLE - 1})), i -> array_join(slice({words}, i, {SHINGLE}), ' ')))"""


#: The lowest bit of every byte.
_LOW_BITS = 0x0101010101010101
#: Words whose bits a byte can count, the highest one being signed.
_BYTE_WORDS = 127


def simhash(words: str, byte_words: int = _BYTE_WORDS) -> str:
    """SQL for the 64-bit SimHash of an array of words, each with its number of occurrences as weight.

    The bits of up to ``byte_words`` words are counted in the bytes of eight longs, those of more words one bit after the other.
    """
    steps = ", ".join(f"get(s, {k}) + (shiftrightunsigned(h, {k}) & {_LOW_BITS}L)" for k in range(8))
    counts = f"aggregate(hashes, array({', '.join(['0L'] * 8)}), (s, h) -> array({steps}))"
    in_bytes = "CAST(shiftrightunsigned(get(counts, b % 8), CAST(8 * (b div 8) AS INT)) & 255 AS INT)"
    in_turn = "aggregate(hashes, 0, (n, h) -> n + CAST(shiftrightunsigned(h, b) & 1 AS INT))"

    def bits(ones: str) -> str:
        return f"aggregate(sequence(0, 63), 0L, (x, b) -> x | IF(2 * {ones} > size(hashes), shiftleft(1L, b), 0L))"

    few = f"transform(array({counts}), counts -> {bits(in_bytes)})[0]"
    return f"transform(array(transform({words}, w -> xxhash64(w))), hashes -> IF(size(hashes) <= {byte_words}, {few}, {bits(in_turn)}))[0]"


def blocks(fingerprint: str, radius: int) -> str:
    """SQL for the (block, value) pairs of a fingerprint: ``radius + 1`` blocks of near equal width."""
    count = radius + 1
    cuts = [64 * i // count for i in range(count + 1)]
    parts = [
        f"named_struct('block', {i}, 'value', shiftrightunsigned({fingerprint}, {low}) & {(1 << (high - low)) - 1})"
        for i, (low, high) in enumerate(zip(cuts, cuts[1:]))
    ]
    return f"array({', '.join(parts)})"


_SIMILARITY = """
transform(array(array_union(bag, item_bag)), every -> aggregate(every,
  named_struct('both', CAST(0 AS BIGINT), 'any', CAST(0 AS BIGINT)),
  (s, x) -> transform(array(named_struct('a', size(filter(bag, y -> y = x)), 'b', size(filter(item_bag, y -> y = x)))),
    n -> named_struct('both', s.both + length(x) * least(n.a, n.b), 'any', s.any + length(x) * greatest(n.a, n.b)))[0],
  s -> IF(s.any = 0, 0D, s.both / s.any)))[0]
"""


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of a document for each item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words are runs of letters and digits
    in lower case. An item without words matches nothing, one of fewer than five words is one
    shingle; a null text has no words. Every row of a repeated text is reported, repeated rows with the same
    doc_id once; a null doc_id is reported as null. Items with equal texts are reported each. Empty
    tables give no rows; other columns are ignored.
    """
    items = written(
        benchmark.selectExpr("item_id", f"{_WORDS} AS words")
        .where(F.size("words") > 0)
        .selectExpr("item_id", "size(words) AS n_words", "words", f"{_bag('words')} AS item_bag")
        .withColumn("item_print", F.expr(simhash("words"))),
        "leak-items",
    )
    sizes = items.select(F.least("n_words", F.lit(SHINGLE)).alias("size")).distinct().collect()  # 5 rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"_hash": F.xxhash64("text"), "_chars": F.length("text")}
    )
    hits, places = [], []
    for size in sorted(r["size"] for r in sizes):
        own = items.where(F.least("n_words", F.lit(SHINGLE)) == size)
        place = (
            own.selectExpr("n_words", f"posexplode({_shingles(size)}) AS (at, shingle)", "item_bag")
            .selectExpr("n_words", "shingle", f"{size} AS size", "length(get(item_bag, at)) AS chars")
            .groupBy("n_words", "shingle", "size")
            .agg(F.max("chars").cast("long").alias("chars"))
        )
        places.append(place)
        asked = _checked(written(place.select("shingle").distinct(), "leak-shingles"))
        rows = texts.selectExpr(*KEY, f"{_WORDS} AS words").selectExpr(
            *KEY, "size(words) AS doc_words", f"posexplode({_shingles(size)}) AS (at, shingle)"
        )
        hits.append(rows.join(asked, "shingle", "left_semi"))
    if not hits:
        kind = benchmark.schema["item_id"].dataType.simpleString()
        return texts.where(F.lit(False)).selectExpr(
            "doc_id", f"CAST(NULL AS {kind}) AS item_id", "0 AS first_word", "0 AS n_words", "0D AS similarity"
        )
    found = written(reduce(DataFrame.unionByName, hits).distinct(), "leak-hits")
    weights = items.selectExpr("n_words", "aggregate(item_bag, 0L, (n, s) -> n + length(s)) AS weight")
    least = weights.groupBy("n_words").agg((F.min("weight") * similarity).alias("least"))
    met = found.join(reduce(DataFrame.unionByName, places), "shingle")
    # A shingle counts for the starts from where the window reaches it to its own place.
    turns = met.selectExpr(
        *KEY,
        "doc_words",
        "n_words",
        "explode(array(named_struct('at', greatest(0, at - (n_words - size)), 'chars', chars), named_struct('at', at + 1, 'chars', -chars))) AS turn",
    )
    stretch = ["doc_words", "n_words"]
    turns = turns.groupBy(*KEY, *stretch, F.col("turn.at").alias("at")).agg(F.sum("turn.chars").alias("chars"))
    along = Window.partitionBy(*KEY, "n_words").orderBy("at")
    starts = (
        turns.withColumn("held", F.sum("chars").over(along))
        .withColumn("until", F.least(F.lead("at").over(along), F.greatest(F.lit(0), F.col("doc_words") - F.col("n_words")) + 1))
        .join(_checked(written(least, "leak-least")), "n_words")
        # A little slack for the rounding of the share; the exact similarity decides.
        .where((F.col("held") >= F.col("least") - 1e-6) & (F.col("held") > 0) & (F.col("at") < F.col("until")))
        .select(*KEY, "n_words", F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("first_word"))
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("n_words", "first_word")).alias("places"))
    )
    starts = written(starts, "leak-starts")
    touched = _checked(starts.select(*KEY))
    own_docs = written(texts.join(touched, KEY, "left_semi"), "leak-documents")
    windows = (
        own_docs.dropDuplicates(KEY)
        .select(*KEY, "text")
        .join(starts, KEY)
        .selectExpr(*KEY, f"{_WORDS} AS words", "places")
        .selectExpr(*KEY, "explode(transform(places, p -> named_struct('n_words', p.n_words, 'first_word', p.first_word, 'words', slice(words, p.first_word + 1, p.n_words)))) AS w")
        .selectExpr(*KEY, "w.n_words", "w.first_word", "w.words")
        .withColumn("print", F.expr(simhash("words")))
    )
    windows = written(windows, "leak-windows")
    index = items.selectExpr("item_id", "n_words", "item_print", f"explode({blocks('item_print', radius)}) AS b").selectExpr(
        "item_id", "n_words", "item_print", "b.block", "b.value"
    )
    probes = windows.selectExpr(*KEY, "n_words", "first_word", "print", f"explode({blocks('print', radius)}) AS b").selectExpr(
        *KEY, "n_words", "first_word", "print", "b.block", "b.value"
    )
    near = (
        probes.join(index, ["n_words", "block", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select(*KEY, "n_words", "first_word", "item_id")
        .distinct()
    )
    verified = (
        near.join(windows.select(*KEY, "n_words", "first_word", "words"), [*KEY, "n_words", "first_word"])
        .join(items.select("item_id", "n_words", "item_bag"), ["item_id", "n_words"])
        .withColumn("bag", F.expr(_bag("words")))
        .withColumn("similarity", F.expr(_SIMILARITY))
        .where(F.col("similarity") >= similarity)
        .groupBy(*KEY, "item_id", "n_words")
        .agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("before"))).alias("best"))
    )
    return (
        own_docs.select("doc_id", *KEY)
        .join(verified, KEY)
        .select(
            "doc_id",
            "item_id",
            (-F.col("best.before")).alias("first_word"),
            "n_words",
            F.col("best.similarity").alias("similarity"),
        )
        .distinct()
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; all columns stay.

    Documents are dropped by their text, so a null doc_id makes no difference.
    """
    key_name = unused("_key", docs.columns)
    leaks = find_leaks(docs.select(F.struct(F.xxhash64("text"), F.length("text")).alias("doc_id"), "text"), benchmark, similarity, radius)
    bad = written(leaks.select(F.col("doc_id").alias(key_name)).distinct(), "leak-texts")
    key = F.struct(F.xxhash64(F.col("text")), F.length("text"))
    return docs.withColumn(key_name, key).join(_checked(bad), key_name, "left_anti").drop(key_name)
