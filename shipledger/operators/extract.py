"""Component versions out of binary and text artifacts.

An artifact is one row, so everything about it is computed in that row: runs, matches and
versions are array expressions, and extraction needs no shuffle however large one source
is. Rules are rows of a small table in code; each gives one constant pattern, which the
engine compiles once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger import fixed
from shipledger.functions.labels import file_from_url, release_name_by_major
from shipledger.functions.normalizers import decode_integer, normalize
from shipledger.functions.versions import beta_build_flag, major
from shipledger.operators.found import explode_found, keep_found
from shipledger.operators.hardware import devices_from_filename
from shipledger.session import constant_table


@dataclass(frozen=True)
class BinaryRule:
    """How to find one component in a binary artifact."""

    name: str
    path: str
    fallback_path: str | None
    source: str
    pattern: str
    normalizer: str = "identity"
    arguments: list[str] = field(default_factory=list)
    min_length: int = fixed.MIN_RUN


@dataclass(frozen=True)
class TextRule:
    """How to find one component in a header or stub text."""

    name: str
    path: str
    pattern: str | None
    normalizer: str = "identity"
    arguments: list[str] = field(default_factory=list)


def binary_rules() -> list[BinaryRule]:
    """The fixed rules for binary artifacts."""
    return [BinaryRule(*row) for row in fixed.BINARY_RULES]


def text_rules() -> list[TextRule]:
    """The fixed rules for header and stub texts."""
    return [TextRule(*row) for row in fixed.TEXT_RULES]


PIECE_BYTES = 8 * 1024 * 1024
#: Bytes behind a piece that are looked at for the rest of a run that leaves it, before all others are.
TAIL_BYTES = 64 * 1024


def _text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def _run_pattern(min_len: int) -> str:
    return r"[\x20-\x7E]{%d,}" % min_len


def _text_runs(text: Column, run_pattern: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(run_pattern), F.lit(0))


def _last_piece(content: Column, size: int) -> Column:
    return F.floor(F.greatest(F.length(content) - 1, F.lit(0)) / size).cast("int")


def _own(content: Column, n: Column, size: int) -> Column:
    """Text of piece ``n`` of a content, without a run that began before it."""
    part = _text(F.substring(content, n * size + 1, F.lit(size)))
    behind = (n > 0) & _text(F.substring(content, n * size, F.lit(1))).between(" ", "~")
    return F.when(behind, F.regexp_replace(part, r"^[\x20-\x7E]+", "")).otherwise(part)


def _whole(own: Column, content: Column, n: Column, size: int) -> Column:
    """The text of :func:`_own` with the rest of a run that leaves the piece, so that every run is whole where it starts."""

    def rest(length: Column) -> Column:
        return F.regexp_extract(_text(F.substring(content, (n + 1) * size + 1, length)), r"^[\x20-\x7E]*", 0)

    tail = rest(F.lit(TAIL_BYTES))
    tail = F.when(F.length(tail) < TAIL_BYTES, tail).otherwise(rest(F.length(content)))
    return F.when(F.right(own, F.lit(1)).between(" ", "~"), F.concat(own, tail)).otherwise(own)


def _over_pieces(content: Column, size: int, start: Column, step) -> Column:
    """``start`` taken through ``step(state, text)`` over the pieces of a content, one piece at a time."""

    def piece(n: Column) -> Column:
        own = F.array(_own(content, n, size))
        return F.get(F.transform(own, lambda text: _whole(text, content, n, size)), F.lit(0))

    places = F.sequence(F.lit(0), _last_piece(content, size))
    return F.when(F.length(content) <= size, step(start, _text(content))).otherwise(
        F.aggregate(places, start, lambda state, n: step(state, piece(n)))
    )


def printable_runs(
    artifacts: DataFrame,
    min_len: int = fixed.MIN_RUN,
    max_len: int | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Runs of printable ASCII, whole; with ``max_len`` an over-long run keeps its first bytes.

    ``run_ord`` orders the runs of an artifact. A large content is searched in pieces, so the
    matcher never works on one text of its whole size.
    """
    keep = [c for c in artifacts.columns if c != "content"]
    content, n = F.col("content"), F.col("_piece_ord")
    # An outer explode of numbers; the content stays where it is, and one piece of it at a time becomes a text.
    places = F.sequence(F.lit(0), _last_piece(content, piece_bytes))
    numbered = artifacts.where(content.isNotNull()).select(*keep, "content", F.explode_outer(places).alias("_piece_ord"))
    own = numbered.select(*keep, "content", "_piece_ord", _own(content, n, piece_bytes).alias("_own"))
    pieces = own.select(*keep, "_piece_ord", _whole(F.col("_own"), content, n, piece_bytes).alias("_piece"))
    found = F.regexp_extract_all("_piece", F.lit(r"[\x20-\x7E]{%d,}" % min_len), F.lit(0))
    if max_len is not None:
        found = F.transform(found, lambda run: F.substring(run, 1, max_len))
    split = pieces.select(*keep, "_piece_ord", found.alias("runs"))
    rows = explode_found(split, "runs", [*keep, "_piece_ord"], "run", "at")
    place = F.shiftleft(F.col("_piece_ord").cast("bigint"), 32) + F.col("at")
    return rows.select(*keep, place.alias("run_ord"), "run")


def find_all(runs: DataFrame, pattern: str, min_len: int = fixed.MIN_RUN) -> DataFrame:
    """Every match of a pattern in run order."""
    keep = [c for c in runs.columns if c != "run"]
    matched = runs.where(F.length("run") >= min_len).select(
        *keep, F.regexp_extract_all("run", F.lit(pattern), F.lit(0)).alias("matches")
    )
    return explode_found(matched, "matches", keep, "match", "match_ord")


def first_match(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The first match of each group of ``keys``."""
    first = matches.groupBy(*keys).agg(
        F.min_by("match", F.struct("run_ord", "match_ord")).alias("match")
    )
    return first.select(*keys, "match")


def integer_version_decode(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The numerically highest match of each group, decoded as major*10000 + minor*100 + patch."""
    highest = matches.groupBy(*keys).agg(F.max(F.col("match").try_cast("bigint")).alias("value"))
    return highest.where("value is not null").select(
        *keys, decode_integer(F.col("value")).alias("version")
    )


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _candidates(artifacts: DataFrame, rules: list[BinaryRule]) -> DataFrame:
    """Artifacts at the path or fallback path of a rule: ``rule`` (position), ``rule_path``, for a fallback the
    ``primary_path`` that has priority, and how the rule searches."""
    how = [(r.pattern, _run_pattern(r.min_length), r.normalizer == "integer_version") for r in rules]
    rows = [(i, r.path.lstrip("/"), None, *how[i]) for i, r in enumerate(rules)]
    rows += [
        (i, r.fallback_path.lstrip("/"), r.path.lstrip("/"), *how[i])
        for i, r in enumerate(rules)
        if r.fallback_path
    ]
    table = constant_table(
        artifacts.sparkSession,
        rows,
        "rule int, rule_path string, primary_path string, pattern string, run_pattern string, is_integer boolean",
    )
    return artifacts.withColumn("rule_path", F.regexp_replace("path", "^/+", "")).join(
        table, "rule_path"
    )


def _without_overruled(
    candidates: DataFrame, artifacts: DataFrame, rules: list[BinaryRule], keys: list[str]
) -> DataFrame:
    """Drop fallbacks of releases (``keys``) that have an artifact at the primary path."""
    primary = [r.path.lstrip("/") for r in rules if r.fallback_path]
    if not primary:
        return candidates
    path = F.regexp_replace("path", "^/+", "")
    present = artifacts.where(path.isin(primary)).select(*keys, path.alias("primary_path"))
    return candidates.join(present.distinct(), [*keys, "primary_path"], "left_anti")


def match_rules(artifacts: DataFrame, rules: list[BinaryRule], keys: list[str]) -> DataFrame:
    """Artifacts with the rule that reads them, in ``rule`` (position) and ``rule_path``.

    A rule reads its fallback path only where the release (``keys``) has no artifact at its
    primary path.
    """
    matched = _without_overruled(_candidates(artifacts, rules), artifacts, rules, keys)
    return matched.select(*artifacts.columns, "rule", "rule_path")


def _first_hit(seen: Column, runs: Column, pattern: str | Column, group: int = 0) -> Column:
    """``seen``, or else the first match in some run; runs are not searched once there is one."""
    wanted = F.lit(pattern)
    hits = F.filter(
        F.transform(runs, lambda run: F.call_function("regexp_extract", run, wanted, F.lit(group))), lambda text: text != ""
    )
    return F.coalesce(seen, F.get(hits, F.lit(0)))


def _raw_version(content: Column, piece_bytes: int) -> Column:
    """What the rule of a row finds in a content: its first match, or for integers the highest, as text."""
    pattern, run_pattern = F.col("pattern"), F.col("run_pattern")

    def highest(seen: Column, text: Column) -> Column:
        found = F.flatten(F.transform(_text_runs(text, run_pattern), lambda run: F.regexp_extract_all(run, pattern, F.lit(0))))
        return F.greatest(seen, F.array_max(F.transform(found, lambda number: number.try_cast("bigint"))))

    def first(seen: Column, text: Column) -> Column:
        return _first_hit(seen, _text_runs(text, run_pattern), pattern)

    return F.when(
        F.col("is_integer"), _over_pieces(content, piece_bytes, F.lit(None).cast("bigint"), highest).cast("string")
    ).otherwise(_over_pieces(content, piece_bytes, F.lit(None).cast("string"), first))


def _normalized(raw: Column, rule: BinaryRule) -> Column:
    if rule.normalizer == "integer_version":
        return decode_integer(raw.cast("bigint"))
    return normalize(raw, rule.normalizer, rule.arguments)


def extract_components(
    artifacts: DataFrame,
    rules: list[BinaryRule] | None = None,
    keys: list[str] | None = None,
    release_keys: list[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Components of artifacts (``keys``, path, content): name, version, path, source.

    A content is searched piece by piece up to the first match; an artifact no pattern matches gives no
    row. ``release_keys`` name the release when ``keys`` say more than that. Contents are read
    once and never shuffled: fallbacks are extracted too, and dropped as short rows where the
    release has the primary artifact. With a column ``piece`` (see ``scan_artifact_pieces``) a row is a piece of an artifact, which ``keys``
    and path tell from others; what its pieces give meets as short rows.
    """
    rules = binary_rules() if rules is None else rules
    keys = keys or ["product", "build_number"]
    release_keys = release_keys or keys
    carried = list(dict.fromkeys([*keys, *release_keys]))
    matched = _candidates(artifacts, rules)
    def by_rule(value) -> Column:
        chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for i, rule in enumerate(rules):
            chosen = chosen.when(F.col("rule") == i, value(rule))
        return chosen

    raw = matched.select(
        *carried,
        "rule",
        "rule_path",
        "primary_path",
        *[c for c in ("piece",) if c in artifacts.columns],
        "is_integer",
        _raw_version(F.col("content"), piece_bytes).alias("raw"),
    )
    raw = keep_found(raw, "raw")
    if "piece" in artifacts.columns:
        raw = raw.groupBy(*carried, "rule", "rule_path", "primary_path", "is_integer").agg(
            F.when(F.col("is_integer"), F.max(F.col("raw").try_cast("bigint")).cast("string"))
            .otherwise(F.min_by("raw", "piece"))
            .alias("raw")
        )
    versions = raw.withColumn("version", by_rule(lambda r: _normalized(F.col("raw"), r))).drop("raw")
    found = keep_found(versions, "version")
    return _without_overruled(found, artifacts, rules, release_keys).select(
        *keys,
        by_rule(lambda r: F.lit(r.name)).alias("name"),
        "version",
        _rooted(F.col("rule_path")).alias("path"),
        by_rule(lambda r: F.lit(r.source)).alias("source"),
    )


def define_value(text: Column, name: str) -> Column:
    """Value of the first ``#define NAME value``; null without one."""
    pattern = r"#\s*define\s+" + re.escape(name) + r"\s+(\S+)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def multi_define(text: Column, names: list[str]) -> Column:
    """Values of several defines joined by dots; null unless all are present."""
    values = F.array(*[define_value(text, name) for name in names])
    return F.when(~F.exists(values, lambda v: v.isNull()), F.array_join(values, "."))


def text_components(
    texts: DataFrame, rules: list[TextRule] | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Components of whole header and stub texts (``keys``, path, value)."""
    rules = text_rules() if rules is None else rules
    keys = keys or ["product", "build_number"]
    value = F.col("value")
    version = F.when(F.lit(False), F.lit(None).cast("string"))
    name = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        here = F.col("path") == rule.path
        if rule.normalizer == "multi_define":
            found = multi_define(value, rule.arguments)
        else:
            raw = F.nullif(F.regexp_extract(value, rule.pattern, 0), F.lit(""))
            found = normalize(raw, rule.normalizer, rule.arguments)
        version = version.when(here, found)
        name = name.when(here, F.lit(rule.name))
    versions = texts.where(F.col("path").isin([r.path for r in rules])).select(
        *keys, "path", version.alias("version")
    )
    return keep_found(versions, "version").select(
        *keys,
        name.alias("name"),
        "version",
        _rooted(F.col("path")).alias("path"),
        F.lit("sdk").alias("source"),
    )


def kernel_fields(
    artifacts: DataFrame,
    archs: DataFrame,
    keys: list[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Darwin and XNU version, architecture, chip and devices of kernel files.

    Each field is its first match over all runs. A content is searched piece by piece, and no further once all fields are
    found. With a column ``piece`` (see ``scan_artifact_pieces``) a row is a piece of a kernel; of kernels by path, read only as far
    as needed, see :func:`kernel_heads`. Kernels without a Darwin version give no row.
    """
    keys = keys or ["product", "build_number"]
    patterns = {"darwin_version": fixed.KERNEL_DARWIN, "xnu_version": fixed.KERNEL_XNU, "suffix": fixed.KERNEL_ARCH}
    nothing = F.struct(*[F.lit(None).cast("string").alias(name) for name in patterns])

    def search(seen: Column, text: Column) -> Column:
        found = F.transform(
            F.array(_text_runs(text, _run_pattern(fixed.MIN_RUN))),
            lambda runs: F.struct(*[_first_hit(seen[name], runs, pattern, 1).alias(name) for name, pattern in patterns.items()]),
        )
        complete = seen["darwin_version"].isNotNull() & seen["xnu_version"].isNotNull() & seen["suffix"].isNotNull()
        return F.when(complete, seen).otherwise(F.get(found, F.lit(0)))

    if "content" in artifacts.columns:
        pieces = [c for c in ("piece",) if c in artifacts.columns]
        fields = artifacts.select(*keys, "file", *pieces, _over_pieces(F.col("content"), piece_bytes, nothing, search).alias("k"))
        fields = keep_found(fields, "k").select(*keys, "file", *pieces, "k.*")
        if pieces:
            # min_by passes over null orders: the first piece that has the field.
            fields = fields.groupBy(*keys, "file").agg(
                *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("piece"))).alias(n) for n in patterns]
            )
    else:
        fields = artifacts.select(*keys, "file", *patterns)
    return keep_found(fields, "darwin_version").join(archs, "suffix", "left").select(
        *keys,
        "file",
        "darwin_version",
        "xnu_version",
        F.concat_ws("_", F.lit("ARM64"), "suffix").alias("arch"),
        F.coalesce("family", "suffix", F.lit("Unknown")).alias("chip"),
        devices_from_filename("file").alias("devices"),
    )


def resolve_versioned_path(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """Actual path of each wanted library (``wanted``) among ``paths`` (path, ord).

    The exact path, else the first path of the same directory and base name. The base of a
    path is a key, so paths shrink to one row per base before they meet the wanted ones.
    """

    def stem(path: Column) -> Column:
        return F.regexp_extract(path, r"(?s)^(.*/[^./]*\.)[^/]*$", 1)

    candidates = (
        paths.where(F.col("path").endswith(".dylib"))
        .groupBy(stem(F.col("path")).alias("stem"))
        .agg(F.min_by("path", "ord").alias("candidate"))
        .where(F.col("stem") != "")
    )
    exact = paths.select(F.col("path").alias("wanted")).distinct().withColumn("exact", F.col("wanted"))
    return (
        wanted.withColumn("stem", stem(F.col("wanted")))
        .join(exact, "wanted", "left")
        .join(candidates, "stem", "left")
        .select(*wanted.columns, F.coalesce("exact", "candidate").alias("resolved"))
    )


def python_runtime_pick(
    artifacts: DataFrame,
    keys: list[str] | None = None,
    min_len: int = fixed.MIN_RUN,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Version of the Python runtime of each release.

    ``artifacts`` has ``keys``, version_dir, path and content. The first library of the
    highest version directory (in text order) that holds a run being a version counts. With a column ``piece`` (see
    ``scan_artifact_pieces``) a row is a piece of a library.
    """
    keys = keys or ["product", "build_number"]
    name, pattern, source = fixed.PYTHON_RULE
    library = F.substring_index("path", "/", -1)
    libraries = artifacts.where(library.startswith("libpython3") & library.endswith(".dylib"))
    piece = F.col("piece") if "piece" in artifacts.columns else F.lit(0)

    def search(seen: Column, text: Column) -> Column:
        return F.coalesce(seen, F.get(F.filter(_text_runs(text, _run_pattern(min_len)), lambda r: r.rlike(pattern)), F.lit(0)))

    hit = _over_pieces(F.col("content"), piece_bytes, F.lit(None).cast("string"), search)
    found = libraries.select(*keys, "version_dir", "path", piece.alias("piece"), hit.alias("version"))
    place = F.struct("path", F.col("version").isNull(), "piece")
    per_dir = found.groupBy(*keys, "version_dir").agg(F.min_by(F.struct("path", "version"), place).alias("l"))
    picked = (
        per_dir.where("l.version is not null")
        .groupBy(*keys)
        .agg(F.max_by("l", "version_dir").alias("l"))
    )
    return picked.select(
        *keys,
        F.lit(name).alias("name"),
        F.col("l.version").alias("version"),
        _rooted(F.col("l.path")).alias("path"),
        F.lit(source).alias("source"),
    )


def sdk_rows(settings: DataFrame, system_versions: DataFrame) -> DataFrame:
    """SDKs from settings documents (product, build_number, sdk_dir, ord, version) of
    ``MacOSX*`` directories, with the build from the version file beside them."""
    builds = system_versions.select(
        "product", "build_number", "sdk_dir", F.col("sdk_build").alias("build_version")
    )
    in_mac = F.substring_index("sdk_dir", "/", -1).startswith("MacOSX")
    return (
        settings.where(in_mac & F.col("version").isNotNull())
        .join(builds, ["product", "build_number", "sdk_dir"], "left")
        .select(
            "product", "build_number", "ord", F.col("version").alias("sdk_version"), "build_version"
        )
    )


def artifact_meta_from_name(artifacts: DataFrame) -> DataFrame:
    """Version and build in an archive name, empty texts when it has none."""
    return artifacts.select(
        "*",
        F.regexp_extract("file", fixed.ARCHIVE_NAME, 1).alias("os_version"),
        F.regexp_extract("file", fixed.ARCHIVE_NAME, 2).alias("build_number"),
    )


def assemble_release(meta: DataFrame) -> DataFrame:
    """Release rows from scan metadata.

    ``meta`` has product, os_version, build_number, release_name, release_date, url,
    source_file, is_beta (nullable), beta_number, beta_revision, is_rc, rc_number,
    is_device_specific and minimum_os_version. Nested parts join by (product, build_number);
    see :func:`nest_release`.
    """
    xcode = F.col("product") == "Xcode"
    rc = F.coalesce("is_rc", F.lit(False))
    guessed = F.when(xcode, F.lit(False)).otherwise(beta_build_flag("build_number"))
    beta = ~rc & F.coalesce("is_beta", guessed)
    last = F.nullif(
        F.substring_index(
            F.rtrim(F.try_parse_url("url", F.lit("PATH")), F.lit("/")), "/", -1
        ),
        F.lit(""),
    )
    file = F.when(xcode, file_from_url("url")).otherwise(last)
    named = F.when(xcode, F.concat_ws(" ", F.lit("Xcode"), "os_version")).otherwise(
        release_name_by_major(major("os_version"))
    )
    return meta.select(
        "product",
        "os_version",
        "build_number",
        F.coalesce("release_name", named).alias("release_name"),
        "release_date",
        F.coalesce(file, F.col("source_file")).alias("file"),
        "url",
        beta.alias("is_beta"),
        F.when(beta, F.col("beta_number")).alias("beta_number"),
        F.when(beta, F.col("beta_revision")).alias("beta_revision"),
        rc.alias("is_rc"),
        "rc_number",
        (~xcode & F.coalesce("is_device_specific", F.lit(False))).alias("is_device_specific"),
        F.when(xcode, F.col("minimum_os_version")).alias("minimum_os_version"),
    )
