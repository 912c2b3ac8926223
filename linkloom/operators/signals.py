"""The signal column: five families of fields out of a saved link and its page; what is there, what was used.

A record is a flat row (`RECORD`).  ``signals`` adds one column for each field; later stages read these flat columns, so that
Catalyst computes each once.  ``nested`` makes the struct with its families out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon, text, urls

VERSION = "signal_pack/v2"
#: Columns of a record that are read; ``complete`` adds those that are missing as nulls.
RECORD = {
    "id": "string", "ord": "long", "name": "string", "url": "string", "domain": "string", "fetch_key": "string", "folder_path": "array<string>", "add_date": "string", "icon": "string",
    "description": "string", "notes": "string",
    "fetch_status": "string", "status_code": "int", "error": "string", "reason_code": "string", "reason_label": "string", "access_pattern": "string", "review_required": "boolean",
    "user_action_required": "boolean", "user_action_label": "string", "trusted_override": "boolean", "route": "string", "attempts": "int",
    "title": "string", "meta_description": "string", "meta_keywords": "string", "h1": "string", "content_preview": "string", "canonical_url": "string", "meta_normalized": "string",
    "registrable_domain": "string", "subdomain": "string", "path_segments": "array<string>", "query_keys": "array<string>",
    "page_title": "string", "page_description": "string", "page_keywords": "string", "page_h1": "string", "page_canonical": "string", "page_lang": "string", "page_preview": "string",
    "og_title": "string", "og_description": "string", "og_site_name": "string", "twitter_title": "string", "twitter_description": "string",
    "jsonld_title": "string", "jsonld_description": "string", "jsonld_keywords": "string", "main_text_preview": "string", "page_schema_types": "array<string>", "page_code_languages": "array<string>",
    "page_hints": "array<string>", "page_h1s": "array<string>", "page_h2s": "array<string>", "page_nav": "array<string>", "page_generator": "string",
    "site_given": "string", "site_types": "array<string>", "site_language": "string", "site_brands": "array<string>", "site_fetch_status": "string", "site_source": "string",
}
FAMILIES = {
    "identity": ("saved_title", "normalized_url", "canonical_identity", "domain", "registrable_domain", "subdomain", "path_segments", "query_keys"),
    "content": (
        "preferred_title", "preferred_description", "semantic_text", "main_text", "title_candidates", "description_candidates", "keywords_text", "language", "code_languages",
    ),
    "structure": (
        "page_type_hints", "site_type_candidates", "schema_types", "resource_facets", "source_facets", "site_name", "brand_terms", "generator", "headings_h1", "headings_h2", "nav_text",
        "homepage_fetch_status", "homepage_source",
    ),
    "health_access": ("fetch_status", "link_health", "quality_facets", "fetch_context", "trusted_override", "review_required", "user_action_required", "status_code"),
    "context_time": ("time_bucket", "original_folder_path"),
}


def complete(records: DataFrame) -> DataFrame:
    """Records with every column of `RECORD`, those that are missing as nulls; further columns stay."""
    there = set(records.columns)
    return records.withColumns({name: F.lit(None).cast(kind) for name, kind in RECORD.items() if name not in there})


def page_types(hay: Column) -> Column:
    """Page types whose words are in a lower-case text, which is made once, not for each word."""
    named = lambda t: F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)), F.lit(kind)) for kind, words in lexicon.PAGE_TYPES.items()]))
    return text.let(hay, named)


def facets(hints: Column, schema_types: Column) -> Column:
    """Resource facets of page types, then of schema types (their last path part), each once."""
    schema = F.transform(schema_types, lambda s: F.try_element_at(text.lookup(lexicon.SCHEMA_TYPE_FACETS), F.lower(F.element_at(F.split(s, "/"), -1))))
    return F.array_distinct(F.array_compact(F.concat(F.transform(hints, lambda h: F.try_element_at(text.lookup(lexicon.PAGE_TYPE_FACETS), F.lower(h))), schema)))


def signals(records: DataFrame) -> DataFrame:
    """Records with one column for each signal.

    A saved name that says little gives way to what the page says; every field is the first of its sources that isn't blank.
    """
    c, first, many = F.col, text.first_filled, text.text_list
    rows = complete(records)
    rows = rows.withColumn("main_text", first(c("main_text_preview"), c("content_preview"), c("page_preview")))
    rows = rows.withColumns({
        "saved_title": text.clean(c("name")), "h1": first(c("h1"), c("page_h1")), "title": first(c("title"), c("page_title")),
        "user_description": first(c("description"), c("notes")), "meta_said": first(c("meta_description"), c("page_description")),
        "keywords_text": first(c("meta_keywords"), c("page_keywords"), c("jsonld_keywords")),
        "page_type_hints": many(c("page_hints")), "site_type_candidates": many(c("site_types")), "schema_types": many(c("page_schema_types")), "code_languages": many(c("page_code_languages")),
        "headings_h2": many(c("page_h2s")), "nav_text": many(c("page_nav")), "site_name": first(c("site_given"), c("og_site_name")), "brand_terms": many(c("site_brands")),
        "generator": text.clean(c("page_generator")), "language": first(c("page_lang"), c("site_language")),
        "normalized_url": first(c("meta_normalized"), c("fetch_key"), urls.normalize(c("url"))), "path_segments": many(c("path_segments")), "query_keys": many(c("query_keys")),
        "domain": text.clean(c("domain")), "registrable_domain": text.clean(c("registrable_domain")), "subdomain": text.clean(c("subdomain")), "fetch_status": text.clean(c("fetch_status")),
        "homepage_fetch_status": text.clean(c("site_fetch_status")), "homepage_source": text.clean(c("site_source")), "time_bucket": text.time_bucket(c("add_date")),
        "original_folder_path": F.coalesce(c("folder_path"), F.array().cast("array<string>")), "review_required": F.coalesce(c("review_required"), F.lit(False)),
        "trusted_override": F.coalesce(c("trusted_override"), F.lit(False)), "reason_code": F.coalesce(c("reason_code"), F.lit("")),
    })
    said = [c(x) for x in ("og_title", "twitter_title", "jsonld_title", "h1", "title")]
    described = [c(x) for x in ("user_description", "og_description", "twitter_description", "jsonld_description", "meta_said")]
    action = F.coalesce(c("user_action_required"), c("reason_code").isin(*lexicon.ACTION_LABELS))
    known = F.coalesce(F.try_element_at(text.lookup(lexicon.ACTION_LABELS), c("reason_code")), F.lit(lexicon.ACTION_FALLBACK))
    rows = rows.withColumns({
        "preferred_title": F.when(text.low_signal_title(c("saved_title")), first(*said)).otherwise(first(c("saved_title"), *said)),
        "title_candidates": many(F.array(c("saved_title"), *said)), "preferred_description": F.coalesce(F.nullif(first(*described), F.lit("")), c("main_text")),  # the main text is clean, and may be long
        "description_candidates": F.array_distinct(F.concat(many(F.array(*described)), F.when(c("main_text") != "", F.array(c("main_text"))).otherwise(F.array().cast("array<string>")))),
        "headings_h1": F.when(F.size(many(c("page_h1s"))) > 0, many(c("page_h1s"))).otherwise(many(F.array(c("h1")))),
        "resource_facets": facets(F.concat(c("page_type_hints"), c("site_type_candidates")), c("schema_types")),
        "source_facets": many(F.concat(F.array(c("site_name"), c("registrable_domain"), c("domain")), c("brand_terms"))),
        "canonical_identity": first(c("page_canonical"), c("canonical_url"), c("normalized_url")), "user_action_required": action,
        "user_action_label": F.when(action, F.coalesce(F.nullif(c("user_action_label"), F.lit("")), known)).otherwise(F.coalesce(c("user_action_label"), F.lit(""))),
    })
    words = lambda x: F.array_join(c(x), " ")
    return rows.withColumns({
        "semantic_text": text.joined(
            words("title_candidates"), c("preferred_description"), c("keywords_text"), c("h1"), c("main_text"), words("page_type_hints"), words("site_type_candidates"), words("schema_types"),
            c("generator"), words("code_languages"), c("site_name"), words("brand_terms"), words("headings_h2"),
        ),
        "quality_facets": F.array_compact(F.array(
            F.when(c("fetch_status") == "success", F.lit(lexicon.FETCHED)), F.when(c("user_action_required"), F.lit(lexicon.REVIEW_ROOT)), F.when(c("trusted_override"), F.lit(lexicon.TRUSTED)),
        )),
    })


def link_health() -> Column:
    return F.struct(*[F.col(x) for x in ("reason_code", "reason_label", "access_pattern", "review_required", "user_action_required", "user_action_label", "trusted_override")])


def fetch_context() -> Column:
    """How a link was fetched; null where it was not."""
    return F.when(F.col("route").isNotNull(), F.struct("route", "attempts"))


def nested(rows: DataFrame, *keep: str) -> DataFrame:
    """The struct column of rows with signals, beside ``keep`` columns (id alone, if none is named)."""
    made = {"link_health": link_health(), "fetch_context": fetch_context()}
    parts = [F.struct(*[made.get(f, F.col(f)).alias(f) for f in fields]).alias(family) for family, fields in FAMILIES.items()]
    return rows.select(*(keep or ("id",)), F.struct(F.lit(VERSION).alias("schema_version"), *parts).alias("signal_pack"))


def present(kind: str, value: Column) -> Column:
    """Whether a field says anything: false and 0 do, blank texts and empty lists don't."""
    there = {"string": F.trim(value) != "", "array": F.size(value) > 0, "map": F.size(value) > 0}.get(kind, value.isNotNull())
    return F.coalesce(there, F.lit(False))


def fields(packs: DataFrame) -> DataFrame:
    """(id, family, field) of every field that is there."""
    cells = []
    for family in packs.schema["signal_pack"].dataType.fields:
        if family.name != "schema_version":
            for field in family.dataType.fields:
                value, kind = F.col(f"signal_pack.{family.name}.{field.name}"), field.dataType.typeName()
                there = present(kind, value)
                if field.name == "time_bucket":
                    there = F.coalesce(value["year"] != "", F.lit(False))
                cells.append(F.when(there, F.struct(F.lit(family.name).alias("family"), F.lit(field.name).alias("field"))))
    return packs.select("id", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("id", "c.family", "c.field")


def flattened(packs: DataFrame) -> DataFrame:
    """(id, fields): a map of family.field to the value as JSON text, for the fields that are there."""
    entries = []
    for family in packs.schema["signal_pack"].dataType.fields:
        if family.name != "schema_version":
            for field in family.dataType.fields:
                value, kind = F.col(f"signal_pack.{family.name}.{field.name}"), field.dataType.typeName()
                shown = value if kind == "string" else F.to_json(value) if kind in ("struct", "array", "map") else value.cast("string")
                entries.append(F.when(present(kind, value), F.struct(F.lit(f"{family.name}.{field.name}").alias("key"), shown.alias("value"))))
    return packs.select("id", F.map_from_entries(F.array_compact(F.array(*entries))).alias("fields"))


def audit(there: DataFrame, used: DataFrame, by: str = "field") -> DataFrame:
    """For each field (or family): records that have it, that used it to classify and to cluster, and how many of them it moved.

    ``used`` has id, family, field and kind (classify or cluster); what is used in either way moved the record.
    Impact falls, then collected falls, then names rise.
    """
    names = ["family", "field"] if by == "field" else ["family"]
    rows = there.select("id", *names, F.lit("collected").alias("kind")).unionByName(used.select("id", *names, "kind"))
    rows = rows.unionByName(used.select("id", *names, F.lit("impact").alias("kind"))).distinct()
    kinds = {"collected": "collected", "classify": "classified", "cluster": "clustered", "impact": "impact"}
    counts = rows.groupBy(*names).agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in kinds.items()])
    return counts.orderBy(F.col("impact").desc(), F.col("collected").desc(), *names)


def unused(audited: DataFrame, limit: int = 15) -> DataFrame:
    """Fields that records have and nothing used, most frequent first (a report)."""
    rows = audited.where("collected > 0 and impact = 0").select("field", "family", "collected")
    return rows.orderBy(F.col("collected").desc(), "family", "field").limit(limit)


def require_version(df: DataFrame, expected: str, stage: str, column: str = "signal_pack.schema_version") -> DataFrame:
    """The rows, if all are of the expected version; one row of any other version raises."""
    other = df.where(~F.col(column).eqNullSafe(F.lit(expected))).select(F.col(column).alias("v")).limit(1).collect()
    if other:
        raise ValueError(f"{stage}: rows are {other[0]['v'] or 'missing'!r}, not {expected!r}")
    return df
