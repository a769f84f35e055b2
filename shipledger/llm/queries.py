"""Registered queries: every operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.llm import bpe, chat, decontaminate, divergence, line_dedup, ngram_join, packing, pii, quality, runs, sharding, token_store, topk, work
from shipledger.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]

END_ID = 2


@query("op1_token_store")
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through a store on disk."""
    path = work.new_folder(spark, "token-store")
    token_store.write_token_store(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID
    )
    return token_store.read_token_store(spark, path, ["doc_id", "start", "n_tokens", "ids_crc32"])


_OP2_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1),
    lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS n_ab
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common WHERE 100 * n_ab >= 85 * (n_a + n_b - n_ab)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id,
  (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""


@query("op2_ngram_join", _OP2_SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms in all documents."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    every = F.expr(
        "array_sort(concat(transform(base, s -> named_struct('start', s.start, 'rank', s.rank, 'kind', s.kind, 'end', s.end)), "
        "transform(coalesce(added, array()), s -> named_struct('start', s.start, 'rank', s.rank, 'kind', s.kind, 'end', s.end))))"
    )
    return found.withColumn("_every", every).select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("_every").alias("spans"),
    )


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP5_SQL = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rows AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows),
owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.*, coalesce(o.owner <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op5_line_dedup", _OP5_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all documents, in four batches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, batches=4).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


_OP6_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op6_topk", _OP6_SQL)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


SHARDS = 40


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    """``docs`` with ids and decoded bytes."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe_round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= quality.LEAST_TAIL).alias("keep"),
    )


CONTROL = "<|im_end|><|im_start|>assistant ok"

_OP10_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
escaped AS (
  SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS inside FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(inside) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op10_chat", _OP10_SQL)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings: formatted, then read back."""
    made = f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{CONTROL}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(made))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return chat.read_turns(chat.format_conversations(rows)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, read back from the sequences."""
    path, tokenizer = work.new_folder(spark, "packing"), public_tokenizers.path("word_bpe_49k.json")
    packing.pack_documents(table(spark, sf_dir, "documents"), path, tokenizer, END_ID)
    return packing.read_pieces(spark, path, tokenizer)


#: Every tenth document (by checksum of its id) becomes periodic from word ``a`` on, with period ``p``.
_MADE_PERIODIC = r"""
CASE WHEN crc32(CAST(doc_id AS STRING)) % 10 = 0 THEN
  transform(array(filter(split(text, r'[\x20\x09-\x0D]+'), w -> w <> '')), words ->
    transform(array(crc32(CAST(doc_id AS STRING)) div 10), g ->
      transform(array(g % size(words)), a ->
        transform(array(1 + (size(words) - a) div (3 + g % 8)), p ->
          array_join(transform(words, (w, i) -> if(i < a, w, get(words, CAST(a + (i - a) % p AS INT)))), ' ')
        )[0])[0])[0])[0]
ELSE text END
"""


def periodic_documents(docs: DataFrame) -> DataFrame:
    """Documents of the contract of ``op12``: some texts replaced by periodic ones."""
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    return docs.select("doc_id", F.when(~blank, F.expr(_MADE_PERIODIC)).alias("text"))


@query("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, and digests of the runs and of the words outside of repetitions."""
    best = F.expr(
        f"aggregate(runs, CAST(NULL AS {runs.RUN}), (b, r) -> "
        "if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = runs.find_runs(periodic_documents(table(spark, sf_dir, "documents"))).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
grps AS (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT r, lang, source, unnest(found) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counted AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, v.v,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term)::HUGEINT AS n_lang,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang)::HUGEINT AS total_lang
  FROM grps g JOIN kept k ON g.lang = k.lang JOIN vocabulary v ON v.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS p,
    1 + (1000000000 * (n_lang + 2)) // (total_lang + 2 * v) AS q FROM cells),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op13_divergence", _OP13_SQL)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between all sources of every language, and the terms that stand out in each."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))
