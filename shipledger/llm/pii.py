"""Personal data by patterns, and terms that give protected entities away.

Base spans are matches of fixed patterns. The values found are the protected entities. A term
reveals an entity when the corpus shows that it comes with it: over the lines of all documents,
the share of an entity's information that a term discloses is

    disclosure(e, t) = PMI(e, t) / IC(e) = log(N * n(e, t) / (n(e) * n(t))) / log(N / n(e))

with N lines, n(e) and n(t) of them with the entity and with the term, and n(e, t) with the entity that have
the term in them or in a line next to them. It is 1 for a term that only occurs there. A term with a disclosure
of at least ``threshold``, seen with the entity in at least ``support`` different places, is generalised to its
class, or removed from ``removal`` on, in every line of each text that holds the entity. Places differ by the line if the
term is in it, else by two lines to either side; a copied line or block is no further support.

Everything is Column code; a text's added spans depend on the text and the corpus, so they are
joined by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.llm.work import written

KINDS = ["email", "ip", "card", "phone"]

# The patterns of the contract, in a form that Java matches without recursion or retries: a possessive
# quantifier where giving back characters never helps, and a start only where a run begins or the
# match before ended.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

_LUHN = """
transform(array(translate(m, ' -', '')), d -> length(d) BETWEEN 14 AND 19 AND aggregate(
  sequence(1, length(d)), 0, (total, i) -> total + transform(array(CAST(substring(d, i, 1) AS INT)),
    x -> IF((length(d) - i) % 2 = 1, 2 * x - IF(x > 4, 9, 0), x))[0]) % 10 = 0)[0]
"""
VALID = {
    "email": "true",
    "ip": rf"m RLIKE r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
    "card": _LUHN,
    "phone": "length(translate(m, '+ ().-', '')) BETWEEN 10 AND 15",
}
TERM = r"[\p{L}\p{N}_]{3,}+"
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _placed(matches: str, between: str, rank: int, kind: str, valid: str = "true") -> str:
    """SQL for the spans of ``matches``, given the text ``between`` them (one part more than matches)."""
    lengths = f"transform({matches}, (m, i) -> length({between}[i]) + length(m))"
    return f"""
    IF(size({matches}) > 0, filter(transform({matches}, (m, i) -> transform(
        array(aggregate(slice({lengths}, 1, i), 0, (a, b) -> a + b) + length({between}[i])),
        s -> named_struct('start', s, 'rank', {rank}, 'kind', '{kind}', 'end', s + length(m), 'value', m))[0]),
      found -> transform(array(found.value), m -> {valid})[0]), CAST(array() AS array<{SPAN}>))"""


def base_spans(docs: DataFrame, into: str = "base") -> DataFrame:
    """Add the base spans of ``text`` (start, rank and name of the kind, end, value), by start and kind.

    Positions are code points, ends exclusive. A null or empty text has none.
    """
    found = docs
    text = F.coalesce(F.col("text"), F.lit(""))
    names = docs.columns
    for kind in KINDS:
        matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        if kind in NEEDS:
            matches = F.when(F.contains(text, F.lit(NEEDS[kind])), matches)
        found = found.withColumn(f"_m_{kind}", matches)
    for kind in KINDS:
        parts = F.when(F.size(f"_m_{kind}") > 0, F.split(text, PATTERNS[kind], -1))
        found = found.withColumn(f"_b_{kind}", parts)
    spans = [
        f"coalesce({_placed(f'_m_{kind}', f'_b_{kind}', rank, kind, VALID[kind])}, array())"
        for rank, kind in enumerate(KINDS)
    ]
    return found.select(*names, F.array_sort(F.expr(f"concat({', '.join(spans)})")).alias(into))


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("_hash"), F.length("text").alias("_chars")]


KEY = ["_hash", "_chars"]


def _lines(texts: DataFrame) -> DataFrame:
    """Lines of texts: text key, rows with the text, line, its start, entities in it, and the lines around it."""
    lines = texts.withColumn("lines", F.split("text", "\n", -1)).drop("text").selectExpr("*", "posexplode(lines) AS (at, line)")
    # The start of a line is what stands before it: all earlier lines and their line feeds.
    start = "aggregate(slice(lines, 1, at), 0, (a, b) -> a + length(b) + 1)"
    return (
        lines.withColumn("line_start", F.expr(start))
        .withColumn("line_end", F.col("line_start") + F.length("line"))
        .withColumn("inside", F.expr("filter(base, s -> s.start >= line_start AND s.end <= line_end)"))
    )


def _entity_lines(texts: DataFrame) -> DataFrame:
    """Lines with protected entities: rows with the text, line, entities in it, the lines next to it without
    entities, and hashes of the line (context) and of two lines to either side with it (around)."""
    before, after = "coalesce(get(lines, at - 1), '')", "coalesce(get(lines, at + 1), '')"
    near = f"filter(base, s -> s.end >= line_start - 1 - length({before}) AND s.start <= line_end + 1 + length({after}))"
    found = _lines(texts).where(F.size("inside") > 0).withColumn("near", F.expr(near))
    return found.select(
        "copies",
        "line",
        "inside",
        *[F.expr(f"aggregate(near, {x}, (l, s) -> replace(l, s.value, ' '))").alias(n) for n, x in (("before", before), ("after", after))],
        F.xxhash64("line").alias("context"),
        F.expr("xxhash64(slice(lines, greatest(at - 1, 1), 3 + least(at, 2)))").alias("around"),
    )


def _words(line: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def revealing_terms(
    docs: DataFrame, lines: DataFrame, threshold: float = 0.8, support: int = 2, removal: float = 0.95
) -> DataFrame:
    """(entity, term, disclosure, action): terms that reveal an entity in the lines of ``docs``."""
    # Terms are looked for outside the entities.
    masked = F.expr("aggregate(inside, line, (l, s) -> replace(l, s.value, ' '))")
    # A term of the line counts by the line, one beside it by the surroundings.
    terms = F.expr(
        "concat(transform(own, t -> named_struct('term', t, 'context', context)), "
        "transform(array_except(array_union(first, last), own), t -> named_struct('term', t, 'context', around)))"
    )
    seen = (
        lines.withColumn("entities", F.expr("array_distinct(transform(inside, s -> lower(s.value)))"))
        .withColumn("line", masked)
        .withColumns({"own": _words("line"), "first": _words("before"), "last": _words("after")})
        .select("around", "copies", F.explode("entities").alias("entity"), terms.alias("terms"))
    )
    entities = (
        seen.groupBy("entity")
        .agg(F.sum("copies").alias("n_e"), F.countDistinct("around").alias("lines"))
        .where(F.col("lines") >= support)
    )
    joint = (
        seen.join(entities.select("entity", "n_e"), "entity")
        .select("entity", "n_e", "copies", F.explode("terms").alias("t"))
        .select("entity", "n_e", "copies", "t.term", "t.context")
        .groupBy("entity", "n_e", "term", "context")
        .agg(F.sum("copies").alias("copies"))
        .groupBy("entity", "n_e", "term")
        .agg(F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("lines"))
        .where(F.col("lines") >= support)
    )
    joint = written(joint.withColumn("term_hash", F.xxhash64("term")), "pii-joint")
    # Counts over all documents, combined before they are shuffled.
    every = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    counts = (
        every.select(F.explode(_words("line")).alias("term"))
        .groupBy(F.xxhash64("term").alias("term_hash"))
        .agg(F.count(F.lit(1)).alias("n_t"))
    )
    line_feeds = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))
    total = docs.agg(F.sum(line_feeds + 1).alias("n")).first()["n"] or 0  # one number
    disclosure = F.log2(F.lit(float(max(1, total))) * F.least("n_et", "n_t") / (F.col("n_e") * F.col("n_t"))) / F.log2(
        F.lit(float(max(1, total))) / F.col("n_e")
    )
    return (
        joint.join(counts, "term_hash")
        .where(F.col("n_e") < total)
        .withColumn("disclosure", disclosure)
        .where(F.col("disclosure") >= threshold)
        .select(
            "entity", "term", "disclosure", F.when(F.col("disclosure") >= removal, "remove").otherwise("generalise").alias("action")
        )
    )


def find_personal_data(docs: DataFrame, threshold: float = 0.8, support: int = 2, removal: float = 0.95) -> DataFrame:
    """doc_id, base, added: the spans of all rows of ``docs`` (doc_id, text).

    ``added`` has start, rank, kind ('term'), end, value and action. A null text is an empty one; repeated rows and texts
    all get their spans; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Texts are kept only where something was found.
    base = base_spans(docs).select(
        "doc_id", *_text_key(), "base", F.when(F.size("base") > 0, F.col("text")).alias("text")
    )
    base = written(base, "pii-base")
    texts = written(
        base.where(F.col("text").isNotNull())
        .groupBy(*KEY)
        .agg(F.first("base").alias("base"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")),
        "pii-texts",
    )
    lines = written(_entity_lines(texts), "pii-lines")
    terms = revealing_terms(docs, lines, threshold, support, removal)
    # The revealing terms of a text are those of all its entities; they are marked in all its lines.
    risky = (
        texts.select(*KEY, F.explode(F.expr("array_distinct(transform(base, s -> lower(s.value)))")).alias("entity"))
        .join(terms, "entity")
        .groupBy(*KEY, "term")
        .agg(F.max("action").alias("action"))  # remove before generalise
        .groupBy(*KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("risky"))
    )
    placed = (
        _lines(texts.join(risky, KEY))
        .withColumn("_words", F.regexp_extract_all("line", F.lit(TERM), F.lit(0)))
        .where(F.expr("exists(_words, w -> map_contains_key(risky, lower(w)))"))
        .withColumn("_gaps", F.split("line", TERM, -1))
        .withColumn("_spans", F.expr(_placed("_words", "_gaps", len(KINDS), "term")))
    )
    added = """
    filter(transform(_spans, s -> named_struct('start', s.start + line_start, 'rank', s.rank, 'kind', s.kind,
        'end', s.end + line_start, 'value', s.value, 'action', risky[lower(s.value)])),
      s -> s.action IS NOT NULL AND NOT exists(inside, b -> b.start < s.end AND s.start < b.end))"""
    by_text = placed.select(*KEY, F.explode(F.expr(added)).alias("span")).groupBy(*KEY).agg(
        F.array_sort(F.collect_set("span")).alias("added")
    )
    return base.drop("text").join(by_text, KEY, "left").select("doc_id", "base", "added")


def sanitised(text: str, base: str, added: str) -> Column:
    """``text`` without its spans: entities and generalised terms become their class, others go."""
    spans = f"""array_sort(concat(transform({base}, s -> named_struct('start', s.start, 'end', s.end, 'by', concat('[', upper(s.kind), ']'))),
      transform(coalesce({added}, array()), s -> named_struct('start', s.start, 'end', s.end, 'by',
        CASE WHEN s.action = 'remove' THEN '' WHEN s.value RLIKE '^[0-9]+$' THEN '[NUMBER]' ELSE '[TERM]' END))))"""
    return F.expr(f"""
    aggregate({spans}, named_struct('out', CAST('' AS string), 'at', 0),
      (a, s) -> IF(s.start >= a.at,
        named_struct('out', concat(a.out, substring({text}, a.at + 1, s.start - a.at), s.by), 'at', s.end),
        named_struct('out', a.out, 'at', greatest(a.at, s.end))),
      a -> concat(a.out, substring({text}, a.at + 1)))""")


def joined(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
