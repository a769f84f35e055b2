"""Data-quality rules for release documents and the index.

Documents are read as raw text, because type rules cannot be checked on typed columns.
Every rule of a document is an expression over its own row, so one scan without a shuffle
finds all of them; only rules about several documents (duplicates, rare names, the index)
group or join. A violation is file_name, build, field, rule, severity and detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger import fixed
from shipledger.functions.versions import build_key
from shipledger.operators.dimension import join_dimension
from shipledger.operators.found import explode_found
from shipledger.operators.index import duplicate_check, index_diff, index_order_check
from shipledger.session import constant_table, settle

COLUMNS = ["file_name", "build", "field", "rule", "severity", "detail"]
VIOLATION = "array<struct<field:string,rule:string,severity:string,detail:string>>"
ERROR, WARNING = "error", "warning"


def _violation(when: Column, field: str | Column, rule: str, severity: str = ERROR, detail: Column | None = None) -> Column:
    text = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))
    name = F.lit(field) if isinstance(field, str) else field
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            name.alias("field"),
            F.lit(rule).alias("rule"),
            F.lit(severity).alias("severity"),
            text.alias("detail"),
        ),
    )


def _collect(checks: list[Column]) -> Column:
    return F.array_compact(F.array(*checks)).cast(VIOLATION)


def _unfold(read: DataFrame, found: Column) -> DataFrame:
    """One row per violation."""
    listed = read.select("file_name", "build", found.alias("found"))
    return explode_found(listed, "found", ["file_name", "build"], "x").select(
        "file_name", "build", "x.*"
    )


def _fields(variant: Column, fields: list[str]) -> Column:
    """Values of an object as a struct of variants, read in one pass; null for anything else. A missing field is null, a JSON null is not."""
    return F.try_variant_get(variant, "$", "struct<" + ",".join(f"`{f}`:variant" for f in fields) + ">")


def _text(value: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def _read(value: Column) -> Column:
    """A JSON value as a struct: whether it is ``present``, and its ``text``, null for other types."""
    return F.struct(value.isNotNull().alias("present"), _text(value, F.schema_of_variant(value)).alias("text"))


def _columns(df: DataFrame, variant: str, fields: list[str]) -> DataFrame:
    """``df`` with ``is_object`` and kind, text and number of several values below a variant as plain columns, looked up once per row.

    ``kind`` is null when the field is missing and VOID for a JSON null; ``text`` and ``number`` are null for other types.
    Structs would not do: the optimizer inlines a struct that is only taken apart again, and with it the look-up into every rule.
    """
    values = df.withColumn("_values", _fields(F.col(variant), fields))
    kinds = values.withColumn("is_object", F.col("_values").isNotNull()).withColumns(
        {f"{f}_kind": F.schema_of_variant(F.col(f"_values.{f}")) for f in fields}
    )

    def number(f: str) -> Column:
        return F.when(F.col(f"{f}_kind").isin("BIGINT", "BOOLEAN"), F.try_variant_get(F.col(f"_values.{f}"), "$", "bigint"))

    return kinds.withColumns(
        {f"{f}_text": _text(F.col(f"_values.{f}"), F.col(f"{f}_kind")) for f in fields} | {f"{f}_number": number(f) for f in fields}
    ).drop("_values")


class _Value:
    """Predicates on a value that has been looked up."""

    def __init__(self, kind: Column, text: Column, number: Column) -> None:
        self.kind = F.coalesce(kind, F.lit("VOID"))
        self.present = kind.isNotNull()
        self.missing = self.kind == "VOID"
        self.is_bool = self.kind == "BOOLEAN"
        self.is_int = self.kind == "BIGINT"
        # The text; null unless it is a non-empty string.
        self.text = F.nullif(text, F.lit(""))
        # The integer; a boolean counts as one, as in languages where it is a subtype.
        self.number = number
        self.flag = F.coalesce(self.is_bool & (number == 1), F.lit(False))

    @classmethod
    def column(cls, field: str) -> _Value:
        """From the columns of :func:`_columns`."""
        return cls(F.col(f"{field}_kind"), F.col(f"{field}_text"), F.col(f"{field}_number"))


def _given(read: Column) -> Column:
    """The text of a struct of :func:`_read`; null unless it is a non-empty string."""
    return F.nullif(read["text"], F.lit(""))


def _list(variant: Column, field: str) -> Column:
    """The elements of an array; null for anything else."""
    return F.try_variant_get(variant, f"$.{field}", "array<variant>")


def _date_columns(read: DataFrame) -> DataFrame:
    """The release date, and whether its text has the form of one; rules read them several times."""
    text = F.nullif("releaseDate_text", F.lit(""))
    return read.withColumns({"release_day": F.try_to_date(text, "yyyy-MM-dd"), "release_form": text.rlike(fixed.DATE_FORM)})


def _url_columns(read: DataFrame, field: str) -> DataFrame:
    """Scheme and host of the link of a document, which rules read several times."""
    url = F.nullif(f"{field}_text", F.lit(""))
    return read.withColumns(
        {
            "url_scheme": F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))),
            "url_host": F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))),
        }
    )


def _date_checks(text: Column, field: str) -> list[Column]:
    day, form = F.col("release_day"), F.col("release_form")
    return [
        _violation(~form, field, "date_format", detail=text),
        _violation(form & day.isNull(), field, "date_invalid", detail=text),
        _violation(form & (day > F.current_date()), field, "date_in_future", WARNING, text),
        _violation(form & (F.year(day) < fixed.OLDEST_YEAR), field, "date_too_old", WARNING, text),
    ]


def _url_checks(url: _Value, field: str) -> list[Column]:
    host = F.col("url_host")
    allowed = host == fixed.DOWNLOAD_HOST
    for suffix in fixed.DOWNLOAD_HOST_SUFFIXES:
        allowed = allowed | host.endswith(suffix)
    secure = F.coalesce(F.col("url_scheme") == "https", F.lit(False))
    return [
        _violation(url.text.isNull(), field, "empty"),
        _violation(url.text.isNotNull() & ~secure, field, "url_not_https", detail=url.text),
        _violation(url.text.isNotNull() & secure & ~allowed, field, "url_host", detail=host),
    ]


def _identity_checks(value: dict[str, _Value], product: str, bools: list[str]) -> list[Column]:
    texts = ["buildNumber", "osVersion", "releaseDate", "releaseName", "productType"]
    version = value["osVersion"].text
    kind = value["productType"].text
    return [
        *[_violation(value[f].text.isNull(), f, "empty") for f in texts],
        _violation(kind != product, "productType", "product_mismatch", detail=kind),
        *[_violation(~value[f].is_bool, f, "not_bool", detail=value[f].kind) for f in bools],
        _violation(~version.rlike(fixed.VERSION_FORM), "osVersion", "version_format", detail=version),
        *_date_checks(value["releaseDate"].text, "releaseDate"),
    ]


def _prerelease_checks(value: dict[str, _Value]) -> list[Column]:
    beta, rc = value["isBeta"].flag, value["isRC"].flag
    known = value["isBeta"].is_bool & value["isRC"].is_bool
    number, revision, candidate = value["betaNumber"], value["betaRevision"], value["rcNumber"]
    set_ = F.when(~number.missing, "betaNumber").when(~revision.missing, "betaRevision")
    return [
        _violation(known & beta & rc, "isBeta", "beta_and_rc"),
        _violation(known & beta & number.missing, "betaNumber", "beta_number_missing", WARNING),
        _violation(
            known & beta & ~number.missing & (number.number.isNull() | (number.number < 1)),
            "betaNumber",
            "not_positive",
        ),
        _violation(
            known & beta & ~revision.missing & number.missing, "betaRevision", "revision_without_number"
        ),
        _violation(
            known & beta & ~revision.missing & (~revision.is_int | (revision.number < 2)),
            "betaRevision",
            "revision_below_two",
        ),
        _violation(known & ~beta & set_.isNotNull(), set_, "set_without_beta"),
        _violation(
            known & rc & ~candidate.missing & (candidate.number.isNull() | (candidate.number < 1)),
            "rcNumber",
            "not_positive",
        ),
        _violation(known & ~rc & ~candidate.missing, "rcNumber", "set_without_rc"),
    ]


def _file_checks(value: dict[str, _Value], product: str) -> list[Column]:
    file_field, url_field = fixed.FILE_FIELDS[product]
    file, url = value[file_field], value[url_field]
    last = F.substring_index(url.text, "/", -1)
    checks = [
        *_url_checks(url, url_field),
        _violation(file.text.isNull(), file_field, "empty"),
        _violation(file.text != last, file_field, "file_not_in_url", detail=last),
    ]
    if product == "macOS":
        version = F.regexp_extract(url.text, fixed.ARCHIVE_URL, 1)
        build = F.regexp_extract(url.text, fixed.ARCHIVE_URL, 2)
        named = url.text.rlike(fixed.ARCHIVE_URL)
        checks += [
            _violation(named & (build != F.col("build")), url_field, "url_build", detail=build),
            _violation(
                named & (version != value["osVersion"].text), url_field, "url_version", detail=version
            ),
        ]
    else:
        checks += [
            _violation(value["minimumOSVersion"].text.isNull(), "minimumOSVersion", "empty"),
            _violation(F.coalesce("sdk_count", F.lit(0)) == 0, "sdks", "no_entries", WARNING),
        ]
    return checks


def _read_elements(elements: Column, fields: list[str], more=None) -> Column:
    """Objects of an array as structs of looked-up fields; null for other elements."""

    def one(element: Column) -> Column:
        parts = [_read(element[f]).alias(f) for f in fields]
        parts += [more(element).alias("more")] if more else []
        return F.when(element.isNotNull(), F.struct(*parts))

    return F.transform(F.transform(elements, lambda element: _fields(element, fields)), one)


def _each(elements: Column, name: str, required: list[str], checks) -> Column:
    """Violations of all elements of an array of objects, flattened."""

    def one(element: Column, position: Column) -> Column:
        label = F.concat(F.lit(f"{name}["), position.cast("string"), F.lit("]"))
        absent = [
            _violation(~element[f]["present"], label, "missing_field", detail=F.lit(f))
            for f in required
        ]
        shape = _collect([_violation(F.lit(True), label, "not_object")])
        return F.when(element.isNull(), shape).otherwise(
            _collect([*absent, *checks(element, position, label)])
        )

    return F.flatten(F.transform(elements, one))


def _component_names(components: Column) -> Column:
    return F.transform(components, lambda e: F.nullif(e["name"]["text"], F.lit("")))


def _component_checks(product: str) -> Column:
    sources = fixed.COMPONENT_SOURCES[product]

    def checks(element: Column, position: Column, label: Column) -> list[Column]:
        name, source = _given(element["name"]), _given(element["source"])
        earlier = F.col("repeated") & (F.array_position("names", name) <= position)
        return [
            _violation(name.isNull(), label, "component_name"),
            _violation(name.isNotNull() & earlier, label, "component_duplicate", detail=name),
            _violation(
                _given(element["version"]).isNull(), label, "component_version", detail=name
            ),
            _violation(_given(element["path"]).isNull(), label, "component_path", detail=name),
            _violation(
                ~F.coalesce(source.isin(sources), F.lit(False)), label, "component_source", detail=source
            ),
        ]

    empty = F.coalesce(F.size("components"), F.lit(0)) <= 0
    return F.when(
        empty, _collect([_violation(F.lit(True), "components", "no_entries", WARNING)])
    ).otherwise(_each(F.col("components"), "components", fixed.COMPONENT_REQUIRED, checks))


def _kernel_devices(element: Column) -> Column:
    devices = F.try_variant_get(element["devices"], "$", "array<variant>")
    return F.struct(
        F.coalesce(F.size(devices), F.lit(0)).alias("count"),
        F.exists(devices, lambda d: F.schema_of_variant(d) != "STRING").alias("mixed"),
    )


def _kernel_checks() -> Column:
    def checks(element: Column, _: Column, label: Column) -> list[Column]:
        none, chip = element["more"]["count"] <= 0, _given(element["chip"])
        exempt = (chip == fixed.NO_DEVICE_CHIP) | (
            (chip == fixed.NO_DEVICE_VM) & F.col("build").isin(fixed.NO_DEVICE_VM_BUILDS)
        )
        return [
            *[
                _violation(_given(element[f]).isNull(), label, "kernel_field", detail=F.lit(f))
                for f in ("arch", "chip", "file")
            ],
            _violation(none & ~F.coalesce(exempt, F.lit(False)), label, "no_devices", WARNING),
            _violation(~none & element["more"]["mixed"], label, "device_not_text"),
        ]

    empty = F.coalesce(F.size("kernels"), F.lit(0)) <= 0
    return F.when(
        empty, _collect([_violation(F.lit(True), "kernels", "no_entries", WARNING)])
    ).otherwise(_each(F.col("kernels"), "kernels", fixed.KERNEL_REQUIRED, checks))


def catalog_documents(raw: DataFrame, product: str) -> DataFrame:
    """Documents of a product by file name: file_name, build, version (from the name), raw, v.

    ``v`` is null for text that is not JSON. Other files are not part of the catalogue.
    """
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    parts = F.split(stem, "-")
    return (
        raw.where((F.size(parts) >= 3) & (parts[0] == product))
        .select(
            "file_name",
            F.element_at(parts, -1).alias("build"),
            F.array_join(F.slice(parts, 2, F.size(parts) - 2), "-").alias("version"),
            "raw",
        )
        .withColumn("v", F.try_parse_json("raw"))
    )


def validate_documents(documents: DataFrame, product: str) -> DataFrame:
    """Violations of single documents; one scan, no shuffle."""
    return _unfold(judge_documents(documents, product), F.col("found"))


def judge_documents(documents: DataFrame, product: str) -> DataFrame:
    """file_name, build, valid, names and found of every document; one scan, no shuffle.

    ``valid`` tells whether it is JSON, ``names`` are its component names if no required field is missing, ``found`` are
    its violations. Every value is looked up once into a plain column before the rules read it.
    """
    required = fixed.REQUIRED_FIELDS[product]
    allowed = required + fixed.OPTIONAL_FIELDS
    lists = {"components", "kernels", "sdks"}
    fields = [f for f in allowed if f not in lists]
    v = F.col("v")
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    looked = _url_columns(_date_columns(_columns(documents, "v", fields)), fixed.FILE_FIELDS[product][1])
    read = looked.select(
        *[c for c in looked.columns if c not in ("raw", "v", "is_object")],
        v.isNull().alias("invalid"),
        F.array_except(F.array(*[F.lit(f) for f in required]), keys).alias("missing"),
        F.array_except(keys, F.array(*[F.lit(f) for f in allowed])).alias("unexpected"),
        _read_elements(_list(v, "components"), fixed.COMPONENT_REQUIRED).alias("components"),
        _read_elements(
            _list(v, "kernels"), [f for f in fixed.KERNEL_REQUIRED], _kernel_devices
        ).alias("kernels"),
        F.size(_list(v, "sdks")).alias("sdk_count"),
    ).withColumn("names", _component_names(F.col("components")))
    known = F.array_compact("names")
    read = read.withColumn(
        "repeated", F.coalesce(F.size(F.array_distinct(known)) < F.size(known), F.lit(False))
    )

    value = {f: _Value.column(f) for f in fields}
    build, version = value["buildNumber"].text, value["osVersion"].text
    single = _collect(
        [
            _violation(
                F.size("unexpected") > 0, "", "unexpected_fields", WARNING,
                F.array_join(F.array_sort("unexpected"), ","),
            ),
            *_identity_checks(value, product, fixed.BOOL_FIELDS[product]),
            _violation(build != F.col("build"), "buildNumber", "file_name_build", detail=build),
            _violation(version != F.col("version"), "osVersion", "file_name_version", detail=version),
            *_prerelease_checks(value),
            *_file_checks(value, product),
        ]
    )
    parts = [single, _component_checks(product)]
    if product == "macOS":
        parts.append(_kernel_checks())
    broken = _collect([_violation(F.lit(True), "", "invalid_json")])
    incomplete = _collect(
        [_violation(F.lit(True), "", "missing_fields", detail=F.array_join("missing", ","))]
    )
    found = (
        F.when(F.col("invalid"), broken)
        .when(F.size("missing") > 0, incomplete)
        .otherwise(F.concat(*parts))
    )
    complete = ~F.col("invalid") & (F.size("missing") == 0)
    return read.select(
        "file_name",
        "build",
        (~F.col("invalid")).alias("valid"),
        F.when(complete, F.array_compact("names")).alias("names"),
        found.alias("found"),
    )


def duplicate_builds(documents: DataFrame) -> DataFrame:
    """Every further valid document of a build (file_name, build, valid), in file order; files of one name count each."""
    valid = documents.where("valid").groupBy("build", "file_name").agg(
        F.count("*").alias("copies")
    )
    first = valid.groupBy("build").agg(
        F.min("file_name").alias("first"), F.sum("copies").alias("n")
    )
    further = F.col("copies") - (F.col("file_name") == F.col("first")).cast("int")
    return (
        valid.join(first.where("n > 1"), "build")
        .where(further > 0)
        .withColumn("again", F.explode(F.sequence(F.lit(1), further)))
        .select(
            "file_name",
            "build",
            F.lit("buildNumber").alias("field"),
            F.lit("duplicate_build").alias("rule"),
            F.lit(ERROR).alias("severity"),
            F.col("first").alias("detail"),
        )
    )


def rare_names(
    components: DataFrame,
    releases: DataFrame,
    min_count: int = fixed.RARE_BELOW,
    min_releases: int = fixed.RARE_MIN_RELEASES,
) -> DataFrame:
    """Component names in fewer than ``min_count`` releases, for products with more than
    ``min_releases`` releases."""
    big = (
        releases.select("product", "build_number").distinct()
        .groupBy("product").count().where(F.col("count") > min_releases).select("product")
    )
    rare = (
        components.select("product", "name", "build_number").distinct()
        .groupBy("product", "name").agg(F.count("*").alias("releases"))
        .where(F.col("releases") < min_count)
    )
    return join_dimension(rare, big, ["product"])


def validate_releases(raw: DataFrame, product: str) -> DataFrame:
    """All violations of the documents (file_name, raw) of a product.

    Documents are parsed and judged once; rules about several documents read the table that gives.
    """
    judged = settle(judge_documents(catalog_documents(raw, product), product))
    releases = judged.where("valid").select(
        F.lit(product).alias("product"), F.col("build").alias("build_number")
    )
    listed = judged.where(F.col("names").isNotNull()).select(
        F.lit(product).alias("product"), F.col("file_name").alias("build_number"), "names"
    )
    components = explode_found(listed, "names", ["product", "build_number"], "name")
    rare = rare_names(components, releases).select(
        F.lit("").alias("file_name"),
        F.lit("").alias("build"),
        F.lit("components").alias("field"),
        F.lit("rare_component").alias("rule"),
        F.lit(WARNING).alias("severity"),
        F.col("name").alias("detail"),
    )
    return (
        _unfold(judged, F.col("found"))
        .unionByName(duplicate_builds(judged))
        .unionByName(rare)
    )


def index_entries(texts: DataFrame) -> DataFrame:
    """Entries (pos, raw) of an index text (value); an array in one document.

    The array is split into the texts of its entries without a VARIANT of the whole, whose size is limited.
    """
    entries = F.from_json("value", "array<string>")
    listed = explode_found(texts.select(entries.alias("entries")), "entries", [], "e", "pos")
    return listed.select(F.col("pos").cast("bigint").alias("pos"), F.col("e").alias("raw"))


#: Texts up to this size can be told from JSON of another kind; VARIANT values end there.
VARIANT_BYTES = 128 * 1024 * 1024


def validate_index_text(
    texts: DataFrame, expected: DataFrame | None = None, variant_bytes: int = VARIANT_BYTES
) -> DataFrame:
    """Violations of index texts as wholes: missing, not JSON, not an array, or neither an array nor
    small enough to tell (``variant_bytes``).

    ``texts`` has value and, for several indexes, file_name; without it, the text is that of ``releases.json``. ``expected`` (file_name) lists
    the indexes that must be there.
    """
    if "file_name" not in texts.columns:
        texts = texts.withColumn("file_name", F.lit("releases.json"))
    if expected is None:
        expected = constant_table(texts.sparkSession, [("releases.json",)], "file_name string")
    is_array = F.json_array_length("value").isNotNull()
    large = F.octet_length("value") > variant_bytes
    parsed = F.when(~is_array & ~large, F.try_parse_json("value"))
    kind = F.schema_of_variant(parsed)
    checks = _collect(
        [
            _violation(~is_array & large, "", "too_large"),
            _violation(~is_array & ~large & parsed.isNull(), "", "invalid_json"),
            _violation(parsed.isNotNull(), "", "not_array", detail=kind),
        ]
    )
    missing = _collect([_violation(F.lit(True), "", "index_missing")])
    absent = expected.join(texts.select("file_name"), "file_name", "left_anti")
    found = texts.select("file_name", checks.alias("xs")).unionByName(absent.select("file_name", missing.alias("xs")))
    return explode_found(found, "xs", ["file_name"], "x").select("file_name", F.lit("").alias("build"), "x.*")


def _lint_key() -> Column:
    """Version order of raw index entries; a version with a bad part counts as zero."""
    parts = F.split("os_version", r"\.")

    def part(position: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(position)), F.lit("0"))

    good = part(0).rlike(r"^\d+$") & part(1).rlike(r"^\d+$") & part(2).rlike(r"^\d+$")

    def number(position: int) -> Column:
        return F.when(good, part(position).try_cast("bigint")).otherwise(0)

    rank = F.when(F.col("is_beta"), 0).when(F.col("is_rc"), 1).otherwise(2)
    return F.struct(number(0), number(1), number(2), rank, build_key("build_number"))


def validate_index(
    entries: DataFrame, raw: DataFrame, files: DataFrame, product: str
) -> DataFrame:
    """All violations of index entries (pos, raw) against the documents (file_name, raw).

    ``files`` has data_file, the paths that exist.
    """
    required = fixed.INDEX_REQUIRED[product]
    parity = fixed.PARITY_FIELDS[product]
    v = F.col("v")
    fields = list(dict.fromkeys([*required, *parity]))
    parsed = _date_columns(_columns(entries.select("pos", F.try_parse_json("raw").alias("v")), "v", fields))
    value = {f: _Value.column(f) for f in fields}
    parsed = parsed.withColumn(
        "missing",
        F.array_compact(F.array(*[F.when(~value[f].present, F.lit(f)) for f in required])),
    )
    label = F.coalesce(
        value["buildNumber"].text, F.concat(F.lit("entry "), F.col("pos").cast("string"))
    )
    checks = (
        F.when(~F.col("is_object"), _collect([_violation(F.lit(True), "", "not_object")]))
        .when(
            F.size("missing") > 0,
            _collect(
                [_violation(F.lit(True), "", "missing_fields", detail=F.array_join("missing", ","))]
            ),
        )
        .otherwise(
            _collect(
                [
                    *_identity_checks(value, product, fixed.BOOL_FIELDS[product]),
                    _violation(value["dataFile"].text.isNull(), "dataFile", "empty"),
                ]
            )
        )
    )
    name = F.lit("releases.json").alias("file_name")
    single = _unfold(parsed.withColumns({"file_name": name, "build": label}), checks)

    def texts(variant: Column) -> Column:
        return F.struct(
            *[
                F.nullif(
                    F.to_json(F.try_variant_get(variant, f"$.{f}", "variant")), F.lit("null")
                ).alias(f)
                for f in parity
            ]
        )

    # The rules below meet entries and documents several times; both are parsed once.
    valid = settle(
        parsed.where(
            F.col("is_object") & (F.size("missing") == 0) & value["buildNumber"].text.isNotNull()
        ).select(
            "pos",
            F.lit(product).alias("product"),
            value["buildNumber"].text.alias("build_number"),
            value["osVersion"].text.alias("os_version"),
            value["isBeta"].flag.alias("is_beta"),
            value["isRC"].flag.alias("is_rc"),
            value["dataFile"].text.alias("data_file"),
            texts(v).alias("parity"),
        )
    )
    documents = settle(
        catalog_documents(raw, product)
        .where("v is not null")
        .select(
            "file_name",
            F.lit(product).alias("product"),
            F.col("build").alias("build_number"),
            texts(v).alias("parity"),
        )
    )

    def rows(df: DataFrame, build: str, field: Column, rule: str, detail: Column) -> DataFrame:
        return df.select(
            name,
            F.col(build).alias("build"),
            field.alias("field"),
            F.lit(rule).alias("rule"),
            F.lit(ERROR).alias("severity"),
            detail.cast("string").alias("detail"),
        )

    repeats = duplicate_check(valid, ["build_number"])
    further = repeats.withColumn("again", F.explode(F.sequence(F.lit(2), F.col("n"))))
    duplicates = rows(further, "build_number", F.lit("buildNumber"), "duplicate_build", F.col("again"))
    absent = valid.where("data_file is not null").join(files, "data_file", "left_anti")
    no_file = rows(absent, "build_number", F.lit("dataFile"), "file_missing", F.col("data_file"))

    sides = rows(index_diff(valid, documents), "build_number", F.lit(""), "index_diff", F.col("side"))
    last_entry = valid.groupBy("build_number").agg(F.max_by("parity", "pos").alias("i"))
    last_document = documents.groupBy("build_number").agg(
        F.max_by("parity", "file_name").alias("c")
    )
    differs = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"i.{f}").eqNullSafe(F.col(f"c.{f}")), F.lit(f))
                for f in parity
            ]
        )
    )
    met = last_entry.join(last_document, "build_number").select(
        "build_number", differs.alias("fields")
    )
    unequal = explode_found(met, "fields", ["build_number"], "field")
    mismatches = rows(unequal, "build_number", F.col("field"), "parity", F.lit(""))

    disorder = rows(
        index_order_check(valid, _lint_key()),
        "actual",
        F.lit(""),
        "index_order",
        F.concat_ws(" ", F.lit("position"), F.col("position"), F.lit("expected"), F.col("expected")),
    )
    found = single
    for part in (duplicates, no_file, sides, mismatches, disorder):
        found = found.unionByName(part)
    return found


def validate_scan_metadata(meta: DataFrame) -> DataFrame:
    """Rules for incoming scan metadata; ``meta`` has file_name, build, update_index,
    release_date (text), beta_number and beta_revision."""
    date, revision = F.col("release_date"), F.col("beta_revision")
    checks = _collect(
        [
            _violation(F.col("update_index") & date.isNull(), "release_date", "date_required"),
            _violation(~date.rlike(fixed.DATE_FORM), "release_date", "date_format", detail=date),
            _violation(
                revision.isNotNull() & F.col("beta_number").isNull(),
                "beta_revision",
                "revision_without_number",
            ),
            _violation(revision < 2, "beta_revision", "revision_below_two", detail=revision),
        ]
    )
    return _unfold(meta, checks)


def valid_identity() -> Column:
    """True for a flat release row with its required fields and a known product."""
    return (
        F.col("os_version").isNotNull()
        & F.col("build_number").isNotNull()
        & F.col("release_name").isNotNull()
        & F.col("product").isin("macOS", "Xcode")
    )


def violation_counts(violations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors and warnings (per ``by``) and whether there are no errors."""
    return (
        violations.groupBy(*(by or []))
        .agg(
            F.count_if(F.col("severity") == ERROR).alias("errors"),
            F.count_if(F.col("severity") == WARNING).alias("warnings"),
        )
        .withColumn("passed", F.col("errors") == 0)
    )
