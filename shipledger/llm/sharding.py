"""Shards of equal weight by vector bin packing.

Documents with equal texts form a group, and a group is placed as a whole where it fits. Groups that are large for a shard are packed
one by one, the heaviest first, each into the shard where the dot product of its vector with
the shard's residual capacity is highest, among those with room for its bytes. A group that is more than a shard in some measure, or
finds no room, is cut into pieces. The many small groups and the pieces fall into a fixed number of bundles by hash, whose bytes, tokens
and rows are summed in Spark, and the bundles are packed like the large groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.work import numbered, written

LOAD = ["size", "tokens", "rows"]


def place_whole(weights: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of every large group, -1 for those that must be cut; takes their weights from ``residual``.

    ``weights`` are (bytes, tokens, rows) in shares of a shard.
    """
    shard = np.full(len(weights), -1, dtype=np.int64)
    for item in np.argsort(-weights.max(axis=1, initial=0), kind="stable"):
        fits = residual[:, 0] >= weights[item, 0]
        if weights[item].max() > 1 or not fits.any():
            continue
        best = int(np.argmax(np.where(fits, residual @ weights[item], -np.inf)))
        shard[item] = best
        residual[best] -= weights[item]
    return shard


def pack(weights: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of every bundle, by dot product with residual capacity; ``weights`` as in :func:`place_whole`.

    Afterwards single bundles move from the shard with the least room to the one with the most as long as that brings
    the two closer in bytes, the measure that the law is about.
    """
    shard = np.zeros(len(weights), dtype=np.int64)
    for item in np.argsort(-weights.max(axis=1, initial=0), kind="stable"):
        best = int(np.argmax(residual @ weights[item]))
        shard[item] = best
        residual[best] -= weights[item]
    room = residual[:, 0].copy()
    for _ in range(8 * len(residual)):
        fullest, emptiest = int(room.argmin()), int(room.argmax())
        gap = room[emptiest] - room[fullest]
        own = np.flatnonzero((shard == fullest) & (weights[:, 0] < gap) & (weights[:, 0] > 0))
        if not len(own):
            break
        moved = own[np.argmin(np.abs(weights[own, 0] - gap / 2))]
        shard[moved] = emptiest
        room[fullest] += weights[moved, 0]
        room[emptiest] -= weights[moved, 0]
    return shard


def shard_documents(
    docs: DataFrame, n_shards: int, bundles_per_shard: int = 256, large_per_shard: int = 16
) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every row of ``docs``.

    ``size`` is the bytes of the text plus 16, ``tokens`` its words; a null text is an empty one. Slots
    number the rows of a shard from 0 in doc_id order (nulls first). Repeated rows are rows of their
    own. Other columns are ignored; an empty table gives no rows. Rows of one text share a shard unless they are more than a
    mean shard in bytes, tokens or rows, or no shard has room for their bytes beside other large groups. A group is large above
    1 / ``large_per_shard`` of a shard in a measure. The driver sees the sums of ``n_shards * bundles_per_shard`` bundles and at most
    ``3 * n_shards * large_per_shard`` large groups.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    bundles = n_shards * bundles_per_shard
    measured = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
        ),
        "measured",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    # A text is told by its hash, its checksum and its size.
    text_key = ["_text", "text_crc32", "size"]
    total = measured.agg(*sums).first()
    if not total["rows"]:
        return measured.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = measured.groupBy(*text_key).agg(
        F.sum(F.col("size")).alias("_size"), F.sum("tokens").alias("_tokens"), F.count(F.lit(1)).alias("_rows")
    )
    means = np.array([max(1, total[c]) / n_shards for c in LOAD])
    share = F.greatest(*[F.col(f"_{c}") / float(m) for c, m in zip(LOAD, means)])
    large = groups.where(share > 1 / large_per_shard).orderBy(*text_key).collect()
    residual = np.ones((n_shards, len(LOAD)))
    weights = np.array([[r[f"_{c}"] for c in LOAD] for r in large]).reshape(-1, len(LOAD)) / means
    alone = place_whole(weights, residual)
    # Of a group that is cut, about large_per_shard pieces would fill a shard.
    pieces = np.ceil(weights.max(axis=1, initial=0) * large_per_shard).astype(int)
    special = spark.createDataFrame(
        [(*(r[k] for k in text_key), None if s < 0 else int(s), int(n)) for r, s, n in zip(large, alone, pieces)],
        "_text long, text_crc32 long, size long, _alone int, _pieces int",
    )
    piece = F.pmod(F.xxhash64("doc_id"), F.coalesce("_pieces", F.lit(1)))
    placed = measured.join(F.broadcast(special), text_key, "left").withColumn(
        "_bundle", F.when(F.col("_alone").isNull(), F.pmod(F.xxhash64("_text", piece), F.lit(bundles)).cast("int"))
    )
    loads = placed.where(F.col("_bundle").isNotNull()).groupBy("_bundle").agg(*sums).orderBy("_bundle").collect()
    shard = pack(np.array([[float(r[c]) for c in LOAD] for r in loads]).reshape(-1, len(LOAD)) / means, residual)
    chosen = spark.createDataFrame([(r["_bundle"], int(s)) for r, s in zip(loads, shard)], "_bundle int, shard int")
    rows = placed.join(F.broadcast(chosen), "_bundle", "left").select(
        "doc_id", "size", "tokens", "text_crc32", F.coalesce("shard", "_alone").alias("shard")
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    return numbered(rows, ["shard"], order, "slot")
