"""Declarative column mapping of supplier ledgers with arbitrary headers.

A ledger is ``(site, row_no, raw map<string,string>)``; rules are rows
``(site, field, source, default, pattern, regex_group, regex_all, join_with, value_map, plain)``, ``plain`` marking a
rule given as a bare header name; headers are rows ``(site, header)``. Everything is resolved once per site and then joined to the ledger rows on ``site``; the rule
side holds one row per site, and Spark broadcasts it only while its measured size allows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom import constants as K
from wareloom.functions import numbers as num
from wareloom.functions import status as st
from wareloom.functions import text as tx
from wareloom.functions.skew import join_per_key, salted
from wareloom.functions.text import clean_text, is_blank, let, strip
from wareloom.operators import options as op
from wareloom.operators import programs
from wareloom.session import stored_once

RULE_TYPE = ("struct<source:string,default:string,pattern:string,regex_group:int,regex_all:boolean,"
             "join_with:string,value_map:map<string,string>>")

WARNING_TYPE = "struct<code:string,field:string,message:string,raw_value:string,option_count:int,price_count:int>"


def warning(field, message: str, code=None, raw_value=None, option_count=None, price_count=None) -> Column:
    as_col = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(
        as_col(code, "string").alias("code"), as_col(field, "string").alias("field"), F.lit(message).alias("message"),
        as_col(raw_value, "string").alias("raw_value"), as_col(option_count, "int").alias("option_count"),
        as_col(price_count, "int").alias("price_count"))


def _fallback_hits(headers: DataFrame) -> DataFrame:
    """Headers recognised without a mapping, with the preference of each."""
    known: dict[str, list[tuple[str, int]]] = {}
    for field, names in K.HEADER_FALLBACKS.items():
        for rank, header in enumerate(names):
            known.setdefault(header, []).append((field, rank + 2))
    entry = lambda hits: "array(" + ", ".join(f"named_struct('field', {tx.quoted(f)}, 'rank', {r})" for f, r in hits) + ")"
    table = F.expr(f"map({', '.join(f'{tx.quoted(header)}, {entry(hits)}' for header, hits in known.items())})")
    hits = F.explode(F.try_element_at(table, F.col("header")))
    return headers.select("site", "header", hits.alias("hit")).select("site", "header", "hit.field", "hit.rank")


def resolve_headers(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """One header per (site, field): declared source, else the older key's source, else a recognised header.

    A rule that has a default and no source reads no header at all.
    """
    sourced = rules.filter(~is_blank(F.col("source")))
    declared = sourced.select("site", "field", F.col("source").alias("header"), F.lit(0).alias("rank"))
    current = {old: new for new, old in K.LEGACY_KEYS.items()}
    legacy = (
        sourced.filter(F.col("field").isin(*current))
        .select("site", tx.lookup(F.col("field"), current).alias("field"), F.col("source").alias("header"), F.lit(1).alias("rank"))
        .join(sourced.select("site", "field"), ["site", "field"], "left_anti")
    )
    named = declared.unionByName(legacy).join(headers, ["site", "header"], "left_semi")
    silent = rules.filter(F.col("default").isNotNull() & is_blank(F.col("source"))).select("site", "field")
    hits = named.unionByName(_fallback_hits(headers)).filter(F.col("field").isin(*K.TARGET_FIELDS))
    return (
        hits.join(silent, ["site", "field"], "left_anti")
        .groupBy("site", "field").agg(F.min_by("header", F.struct("rank", "header")).alias("header"))
    )


def missing_required(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """Required fields of each site with neither a non-blank default nor a readable header."""
    required = headers.select("site").distinct().select(
        "site", F.explode(F.array(*[F.lit(f) for f in K.REQUIRED_FIELDS])).alias("field"))
    defaulted = rules.filter(~is_blank(F.col("default"))).select("site", "field")
    covered = defaulted.unionByName(resolve_headers(rules, headers).select("site", "field"))
    return required.join(covered, ["site", "field"], "left_anti")


@F.pandas_udf(T.IntegerType())
def _group_index(patterns: pd.Series, groups: pd.Series) -> pd.Series:
    """Index of the capture group a rule asks for; -1 for a bad pattern, -2 for a bad group (rules only, not data)."""
    def one(pattern, group):
        if pattern is None:
            return None
        try:
            compiled = re.compile(pattern)
        except re.error:
            return -1
        if group is None:
            return 1 if compiled.groups else 0
        if group.lstrip("-").isdigit():
            return int(group) if 0 <= int(group) <= compiled.groups else -2
        return compiled.groupindex.get(group, -2)
    return pd.Series([one(p, g) for p, g in zip(patterns, groups)], dtype="Int32")


def unsafe_pattern(c: Column) -> Column:
    """Back-references, look-behind or nested quantifiers, and patterns beyond the length limit, if there is one."""
    limit = K.RULE_LIMITS["regex"]
    return ((F.char_length(c) > limit if limit else F.lit(False)) | c.rlike(r"\\[1-9]") | c.contains("(?<=") | c.contains("(?<!")
            | c.rlike(r"\([^)]*[+*][^)]*\)[+*{]"))


def sanitize_rules(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """Readable rules with a verdict: ``warnings`` lists what was ignored, ``kept`` says if the rule stays. Values are never shortened."""
    known = headers.select("site", F.col("header").alias("source"), F.lit(True).alias("present"))
    df = rules.join(known, ["site", "source"], "left").withColumns({
        "group_index": _group_index(F.when(~unsafe_pattern(F.col("pattern")), F.col("pattern")), F.col("regex_group")),
        "present": F.coalesce("present", F.lit(False)),
    })
    field, pattern, group = F.col("field"), F.col("pattern"), F.col("group_index")
    unknown = ~field.isin(*K.TARGET_FIELDS, *K.LEGACY_KEYS.values())
    absent = (F.coalesce("source", F.lit("")) != "") & ~F.col("present")
    unsafe, broken, bad_group = unsafe_pattern(pattern), group == -1, group == -2
    limit = K.RULE_LIMITS["value_map_entries"]
    oversized = F.size("value_map") > limit if limit else F.lit(False)
    stays = ~unknown & ~F.coalesce(unsafe | broken | bad_group, F.lit(False)) & (F.col("present") | F.col("default").isNotNull())
    said = F.when(unknown, F.array(F.concat(F.lit("Ignored unknown target field: "), field))).otherwise(F.array_compact(F.array(
        F.when(absent, F.concat(F.lit("Ignored missing source header for "), field, F.lit(": "), F.col("source"))),
        F.when(unsafe, F.concat(F.lit("Ignored invalid or oversized regex for "), field, F.lit("."))),
        F.when(broken, F.concat(F.lit("Ignored invalid regex for "), field, F.lit("."))),
        F.when(bad_group, F.concat(F.lit("Ignored invalid regex_group for "), field, F.lit("."))),
        F.when(~(unsafe | broken | bad_group) & oversized | pattern.isNull() & oversized,
               F.concat(F.lit("Ignored invalid value_map for "), field, F.lit("."))),
        F.when(~F.coalesce(unsafe | broken | bad_group, F.lit(False)) & ~F.col("present") & F.col("default").isNull() & ~F.col("plain"),
               F.concat(F.lit("Ignored rule without a valid source or default for "), field, F.lit("."))),
    )))
    return df.select(
        "site", "field", F.when(F.col("present"), F.col("source")).alias("source"),
        "default",
        F.regexp_replace("pattern", r"\(\?P<", "(?<").alias("pattern"), group.alias("regex_group"),
        F.coalesce("regex_all", F.lit(False)).alias("regex_all"), "join_with",
        F.when(~oversized, F.col("value_map")).alias("value_map"), stays.alias("kept"), said.alias("warnings"))


def apply_rule(value: Column, rule: Column) -> Column:
    """Default for a blank, then the pattern (first match, or all matches joined) over the whole cell, then the value map."""
    def by_pattern(text):
        first = F.call_function("regexp_extract", text, rule["pattern"], rule["regex_group"])
        every = F.call_function("regexp_extract_all", text, rule["pattern"], rule["regex_group"])
        kept = F.filter(F.transform(every, lambda m: tx.strip(m)), lambda m: m != "")
        found = F.when(F.coalesce(rule["regex_all"], F.lit(False)),
                       F.call_function("array_join", kept, F.coalesce(rule["join_with"], F.lit(",")))).otherwise(first)
        return F.when(F.coalesce(rule["pattern"], F.lit("")) == "", text).otherwise(found)

    def by_value(text):
        return clean_text(F.coalesce(F.try_element_at(rule["value_map"], text), text))

    return let(F.coalesce(clean_text(value), clean_text(rule["default"])), lambda text: let(by_pattern(text), by_value))


def site_rules(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """Per site, the resolved rule of every target field as ``map<field, rule>`` (at most one entry per field).

    The rules of a site meet its headers in one row: both are bounded by the columns of a sheet. The headers are those of ``resolve_headers``. A rule
    under an older key applies only where the current key has no rule; of repeated rules of a field, the one with the smallest source.
    """
    parts = "default, pattern, regex_group, regex_all, join_with, value_map"
    kept = sanitize_rules(rules, headers).filter("kept").withColumns({
        "source": clean_source(), "_r": F.expr(f"struct(source, {parts})").cast(RULE_TYPE)})
    single = kept.repartition("site").groupBy("site", "field").agg(F.min_by("_r", F.coalesce("source", F.lit(""))).alias("_r"))
    grouped = single.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("field", "_r"))).alias("_rules"))
    sheets = headers.groupBy("site").agg(F.collect_set("header").alias("_headers"))
    named = [*K.TARGET_FIELDS, *K.LEGACY_KEYS.values()]
    both = grouped.join(sheets, "site", "full_outer").selectExpr("site", "_headers", *[f"try_element_at(_rules, {tx.quoted(n)}) AS r_{n}" for n in named])

    def header(field):
        """Null where a default stands alone; then the source of the rule, of the older key's rule, the first recognised header."""
        older = f"r_{K.LEGACY_KEYS[field]}.source" if field in K.LEGACY_KEYS else "NULL"
        known = ", ".join(tx.quoted(h) for h in K.HEADER_FALLBACKS.get(field, ()))
        recognised = f"get(array_intersect(array({known}), _headers), 0)" if known else "NULL"
        return F.expr(f"CASE WHEN r_{field}.source IS NULL AND r_{field}.default IS NOT NULL THEN NULL ELSE coalesce(r_{field}.source, {older}, {recognised}) END")

    def chosen(field):
        return F.expr(f"coalesce(r_{field}, r_{K.LEGACY_KEYS[field]})" if field in K.LEGACY_KEYS else f"r_{field}")

    resolved = both.select("site", *[header(f).alias(f"h_{f}") for f in K.TARGET_FIELDS], *[chosen(f).alias(f"c_{f}") for f in K.TARGET_FIELDS])
    values = ", ".join(f"c_{{0}}.{p}" for p in parts.split(", "))
    entry = f"CASE WHEN h_{{0}} IS NOT NULL OR c_{{0}} IS NOT NULL THEN struct('{{0}}', CAST(struct(h_{{0}}, {values}) AS {RULE_TYPE})) END"
    return resolved.selectExpr("site", f"map_from_entries(array_compact(array({', '.join(entry.format(f) for f in K.TARGET_FIELDS)}))) AS rules")


def clean_source() -> Column:
    """The source header of a rule as written, null if blank."""
    return F.when(strip(F.col("source")) != "", F.col("source"))


def project_fields(ledger: DataFrame, rules: DataFrame, headers: DataFrame, most_sets: int = programs.MOST_SETS) -> DataFrame:
    """All target fields of every ledger row as text columns; keeps ``site, row_no, raw``.

    Rules are resolved once and the ``most_sets`` most used rule sets are compiled; sites with other sets get theirs from the rule table, with the same result.
    """
    by_site = stored_once(programs.with_digest(site_rules(rules, headers)))
    sets = programs.collect_sets(by_site, most_sets)
    # One row per supplier, which may own a large share of the ledger rows, so these are spread by salt.
    numbered = join_per_key(salted(ledger.select("site", "row_no", "raw"), ["row_no"]), sets.numbers, ["site"], "left")
    if sets.complete:
        return programs.apply_sets(numbered, sets.programs)
    rest = F.coalesce(F.col("_set") == programs.UNCOMPILED, F.lit(False))
    by_row = project_by_row(numbered.filter(rest), by_site)
    return programs.apply_sets(numbered.filter(~rest), sets.programs).unionByName(by_row)


def project_by_row(salted_rows: DataFrame, by_site: DataFrame) -> DataFrame:
    """The same with rules that travel with the rows."""
    joined = join_per_key(salted_rows, by_site.select("site", "rules"), ["site"], "left")
    empty = F.lit(None).cast(RULE_TYPE)

    def field(name):
        rule = F.coalesce(F.try_element_at("rules", name), empty)
        return let(rule, lambda r: apply_rule(F.try_element_at("raw", r["source"]), r))

    values = F.transform(F.array(*[F.lit(f) for f in K.TARGET_FIELDS]), field)
    df = joined.select("site", "row_no", "raw", values.alias("_values"))
    return df.select("site", "row_no", "raw", *[F.get("_values", F.lit(i)).alias(f) for i, f in enumerate(K.TARGET_FIELDS)])


def overlay(site_mapping: Column, request_mapping: Column) -> Column:
    """Site mapping with the request's entries laid over it."""
    kept = F.map_filter(site_mapping, lambda k, v: ~F.array_contains(F.map_keys(request_mapping), k))
    return F.when(request_mapping.isNull(), site_mapping).when(site_mapping.isNull(), request_mapping).otherwise(
        F.map_concat(kept, request_mapping))


def parse_rows(fields: DataFrame) -> DataFrame:
    """Products from projected fields: status, prices, options, images and one warnings array per row."""
    raw_status = clean_text(F.col("wholesale_status"))
    df = fields.withColumns({"raw_status": raw_status, "status": st.ledger_status(raw_status)})
    df = op.pair_variants(df, "option_values_raw", "price_wholesale_raw", "option_price_deltas_raw")
    bad_status = F.col("raw_status").isNotNull() & F.col("status").isNull()
    df = df.withColumn("suppressed", bad_status | (F.size("option_warnings") > 0))
    df = op.standard_options(
        df, code="product_code", status="status", names="option_values_raw", prices="price_wholesale_raw",
        images="option_image_urls_raw", skus="option_skus_raw", deltas="option_price_deltas_raw", suppress="suppressed")
    invalid = F.when(bad_status, warning("wholesale_status", "Unsupported wholesale status.", "invalid_wholesale_status", F.col("raw_status")))
    blanks = [F.when(is_blank(F.col(f)), warning(f, "Required value is blank.")) for f in K.REQUIRED_FIELDS]
    too_large = {f: num.is_price_too_large(F.col(f)) for f in ("price_retail", "price_min_selling")}
    too_large["price_wholesale_raw"] = F.col("price_wholesale").isNull() & num.is_price_too_large(F.col("price_wholesale_raw"))
    prices = [F.when(test, warning(f, "Price is too large.", "price_out_of_range", F.col(f))) for f, test in too_large.items()]
    warnings = F.concat(F.col("option_warnings"), F.array_compact(F.array(invalid, *blanks, *prices)))
    images = F.array_compact(F.array(*[clean_text(F.col(c)) for c in K.IMAGE_SLOTS]))
    text_columns = ("wholesale_product_id", "product_code", "option_values_raw", "price_wholesale_raw", "origin",
                    "image_detail", "wholesale_registered_at")
    return df.select(
        "site", "row_no", F.col("status").alias("wholesale_status"),
        F.coalesce(clean_text(F.col("original_name")), F.lit("")).alias("original_name"),
        *[clean_text(F.col(c)).alias(c) for c in text_columns],
        "price_wholesale", "option_variants", "standard_options",
        num.int_price(F.col("price_retail")).alias("price_retail"),
        num.int_price(F.col("price_min_selling")).alias("price_min_selling"),
        images.alias("images_list"), raw_row(F.col("raw")).alias("raw_metadata"), warnings.alias("warnings"))


def raw_row(raw: Column) -> Column:
    """The ledger row as JSON text, blanks as empty strings."""
    return F.to_json(F.transform_values(raw, lambda k, v: F.coalesce(v, F.lit(""))))


def sample_rows(ledger: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows of every site, in file order."""
    from pyspark.sql import Window
    order = Window.partitionBy("site").orderBy("row_no")
    return ledger.withColumn("sample_no", F.row_number().over(order)).filter(F.col("sample_no") <= n)


def preview(ledger: DataFrame, rules: DataFrame, headers: DataFrame, n: int = 5) -> DataFrame:
    """Parsed first rows of every site, with the row number used in its warnings."""
    numbers = sample_rows(ledger, n)
    parsed = parse_rows(project_fields(numbers.drop("sample_no"), rules, headers)).drop("raw_metadata")
    return parsed.join(numbers.select("site", "row_no", "sample_no"), ["site", "row_no"])
