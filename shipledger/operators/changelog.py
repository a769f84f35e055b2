"""Sections of change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.fixed import CHANGE_DROPPED, CHANGE_SECTIONS
from shipledger.operators.found import explode_struct
from shipledger.session import constant_table

FULL_LINK = "**Full Changelog**:"
SPACE = r"\s+"
#: Characters of ``\s``.
BLANKS = " \t\n\x0b\f\r"


def _after(text: Column, n: int | Column) -> Column:
    """``text`` without its first ``n`` characters and the white space behind them."""
    return F.ltrim(F.substring(text, F.lit(n) + 1, F.length(text)), F.lit(BLANKS))


def _full_link(text: Column) -> Column:
    """The address of a change-log line; null for other lines."""
    address = F.get(F.split(_after(text, len(FULL_LINK)), SPACE, 2), F.lit(0))
    is_address = (address.startswith("http://") & (F.length(address) > 7)) | (
        address.startswith("https://") & (F.length(address) > 8)
    )
    return F.when(text.startswith(FULL_LINK) & is_address, address)


def _bullet(text: Column) -> Column:
    """What stands behind the star of a bullet; null for other lines."""
    is_bullet = text.startswith("*") & F.substring(text, 2, 1).rlike(r"\s")
    return F.when(is_bullet, F.nullif(_after(text, 1), F.lit("")))


def _without_credits(text: Column) -> Column:
    """Text without the address it ends with, then without the author before that."""
    unlinked = F.regexp_replace(text, r"\s+in\s+https?://\S+$", "")
    return F.regexp_replace(unlinked, r"\s+by\s+@[\w-]+$", "")


def classify_change_lines(lines: DataFrame) -> DataFrame:
    """Bullet lines with their section, and change-log links.

    ``lines`` has doc_id, ord and line. Result: doc_id, ord, section, section_rank and text;
    order by (section_rank, ord) within a document. Dropped types and other lines give no
    row; the link has the section ``Full Changelog`` after all others.
    """
    keep = ["doc_id", "ord"]
    # Each step reads the columns of the one before; an outer explode keeps the optimizer from writing one into the other.
    trimmed = lines.select(*keep, F.explode_outer(F.array(F.btrim("line", F.lit(BLANKS)))).alias("line"))
    kinds = explode_struct(trimmed, keep, link=_full_link(F.col("line")), body=_bullet(F.col("line")))
    # A bullet is ``type: text`` or ``type(scope): text``, else it has no type.
    prefixed = explode_struct(
        kinds, [*keep, "link", "body"], prefix=F.regexp_extract("body", r"^[a-z]+(?:\([^)]*\))?:", 0)
    )
    behind = explode_struct(prefixed, [*keep, "link", "body", "prefix"], rest=_after(F.col("body"), F.length("prefix")))
    typed = (F.col("prefix") != "") & (F.col("rest") != "")
    parsed = explode_struct(
        behind,
        [*keep, "link"],
        type=F.when(typed, F.regexp_extract("prefix", "^[a-z]+", 0)).otherwise(""),
        text=_without_credits(F.when(typed, F.col("rest")).otherwise(F.col("body"))),
    )
    sections = constant_table(
        lines.sparkSession,
        [(kind, name, rank) for rank, (kind, name) in enumerate(CHANGE_SECTIONS.items())],
        "type string, section string, section_rank int",
    )
    link = F.col("link").isNotNull()
    kept = parsed.where(link | (F.col("text").isNotNull() & ~F.col("type").isin(CHANGE_DROPPED)))
    after = len(CHANGE_SECTIONS)
    return kept.join(sections, "type", "left").select(
        "doc_id",
        "ord",
        F.when(link, "Full Changelog").otherwise(F.coalesce("section", F.lit("Other"))).alias("section"),
        F.when(link, after + 1)
        .otherwise(F.coalesce("section_rank", F.lit(after)))
        .alias("section_rank"),
        F.when(link, F.col("link")).otherwise(F.col("text")).alias("text"),
    )


def section_lists(classified: DataFrame) -> DataFrame:
    """Entries per document and section in input order, sections in their fixed order.

    A document is one change log, so its lists are as long as one text.
    """
    grouped = classified.groupBy("doc_id", "section_rank", "section").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda e: e["text"]
        ).alias("entries")
    )
    return grouped.orderBy("doc_id", "section_rank")
