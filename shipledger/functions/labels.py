"""Names, slugs and other labels of releases and components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shipledger.functions.versions import _col
from shipledger.fixed import OS_RELEASE_NAMES


def release_name_by_major(major: Column | str) -> Column:
    """Release name of a major OS version; an unknown one is named by its number."""
    number = _col(major)
    name = F.concat(F.lit("macOS "), number.cast("string"))
    for value, text in OS_RELEASE_NAMES.items():
        name = F.when(number == value, text).otherwise(name)
    return name


def release_slug() -> Column:
    """``version-build``."""
    return F.concat_ws("-", "os_version", "build_number")


def component_slug(name: Column | str = "name") -> Column:
    """Lower-case name without its parenthetical part (first to last parenthesis of a line)."""
    bare = F.regexp_replace(_col(name), r"(?s)^(.*?)\s*\((?-s:.*)\)(.*)$", "$1$2")
    return F.lower(F.regexp_replace(bare, r"^\s+|\s+$", ""))


def display_name(include_release_name: bool = True) -> Column:
    """Site form: OS releases may carry their name, betas and candidates their number."""
    xcode = F.col("product") == "Xcode"
    base = F.concat(
        F.when(xcode, "Xcode ").otherwise("macOS "),
        F.col("os_version"),
    )
    if include_release_name:
        named = ~xcode & (F.coalesce(F.col("release_name"), F.lit("")) != "")
        base = F.when(named, F.concat_ws(" ", base, "release_name")).otherwise(base)
    number = F.col("beta_number").cast("string")
    beta = F.col("is_beta") & (F.coalesce("beta_number", F.lit(0)) != 0)
    revision = F.when(
        F.coalesce("beta_revision", F.lit(0)) != 0,
        F.concat(F.lit(" v."), F.col("beta_revision").cast("string")),
    ).otherwise("")
    candidate = F.when(
        F.coalesce("rc_number", F.lit(0)) != 0,
        F.concat(F.lit(" "), F.col("rc_number").cast("string")),
    ).otherwise("")
    return (
        F.when(beta, F.concat(base, F.lit(" beta "), number, revision))
        .when(F.col("is_rc"), F.concat(base, F.lit(" RC"), candidate))
        .otherwise(base)
    )


def beta_label() -> Column:
    """Command-line form of a beta, e.g. ``Developer Beta 3 v.2``; null for other releases."""
    revision = F.coalesce(
        F.concat(F.lit(" v."), F.col("beta_revision").cast("string")), F.lit("")
    )
    numbered = F.concat(F.lit("Developer Beta "), F.col("beta_number").cast("string"), revision)
    return F.when(F.col("is_beta"), F.coalesce(numbered, F.lit("Beta")))


def cli_display_name() -> Column:
    """Command-line form: version, name for OS releases, and the beta label."""
    prefix = F.when(
        F.col("product") == "Xcode", F.concat_ws(" ", F.lit("Xcode"), "os_version")
    ).otherwise(F.concat_ws(" ", F.lit("macOS"), "os_version", "release_name"))
    return F.concat_ws(" ", prefix, beta_label())


def format_date(date: Column | str, style: str = "short") -> Column:
    """``Sep 16, 2024`` or, in the long style, ``September 16, 2024``."""
    pattern = {"short": "MMM d, yyyy", "long": "MMMM d, yyyy"}[style]
    return F.date_format(_col(date), pattern)


def display_version(version: Column | str = "version") -> Column:
    """Version, or ``unknown``."""
    return F.coalesce(_col(version), F.lit("unknown"))


def resolved_product_type(value: Column | str) -> Column:
    """Product of a text in any case; missing means macOS, an unknown product gives null."""
    text = F.lower(_col(value))
    return (
        F.when(text.isNull() | (text == "macos"), "macOS").when(text == "xcode", "Xcode")
    )


def file_from_url(url: Column | str) -> Column:
    """File name of a download link; a ``path`` query parameter is preferred."""
    link = _col(url)
    wrapped = F.try_parse_url(link, F.lit("QUERY"), F.lit("path"))
    path = F.rtrim(F.try_parse_url(link, F.lit("PATH")), F.lit("/"))
    last = F.substring_index(path, "/", -1)
    inner = F.substring_index(F.rtrim(F.try_url_decode(wrapped), F.lit("/")), "/", -1)
    return F.when(F.coalesce(wrapped, F.lit("")) != "", inner).otherwise(F.nullif(last, F.lit("")))


def safe_link(url: Column | str) -> Column:
    """The link if it is https, else null."""
    return F.when(_col(url).startswith("https://"), _col(url))
