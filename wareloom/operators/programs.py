"""Rule sets of suppliers compiled to column expressions with constant headers, patterns and value maps.

Many suppliers share one rule set, so sets are told apart by a digest and the most used ones are compiled: every field becomes a choice over set
numbers in a single pass over the ledger. A row carries the number of its set, not the rules, and no pattern is read from a row. Sites whose set is
not among the compiled ones keep ``UNCOMPILED`` and are left to the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.text import strip

# What one plan holds: rule sets, and characters of a set; sets beyond these are applied from rows.
MOST_SETS = 64
LONGEST_SET = 65536
UNCOMPILED = -1

Rule = dict
Case = Callable[[Rule], object]


class RuleSets(NamedTuple):
    """``numbers`` is ``(site, _set)``, one row per site with rules; ``programs`` are the compiled sets, rules by field."""

    numbers: DataFrame
    programs: list[dict[str, Rule]]
    complete: bool


def with_digest(site_rules: DataFrame) -> DataFrame:
    """Add the rule set of a site as text and its digest; ``site_rules`` is ``(site, rules map<field, rule>)``."""
    printed = F.to_json(F.struct(*[F.try_element_at("rules", F.lit(f)).alias(f) for f in K.TARGET_FIELDS]))
    return site_rules.withColumn("printed", printed).withColumn("digest", F.sha2("printed", 256))


def collect_sets(sites: DataFrame, most: int = MOST_SETS) -> RuleSets:
    """The ``most`` sets with the most sites, read to the driver; ``sites`` is a stored table from ``with_digest``."""
    fits = F.char_length("printed") <= LONGEST_SET
    sizes = sites.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(fits, F.col("printed"))).alias("printed"))
    found = sizes.orderBy(F.col("printed").isNull(), F.desc("n"), "digest").limit(most + 1).collect()
    kept = [r for r in found[:most] if r.printed is not None]
    number = F.lit(None).cast("int")
    if kept:
        number = F.try_element_at(F.create_map(*[F.lit(x) for n, r in enumerate(kept) for x in (r.digest, n)]), F.col("digest"))
    numbers = sites.select("site", F.coalesce(number, F.lit(UNCOMPILED)).alias("_set"))
    return RuleSets(numbers, [json.loads(r.printed) for r in kept], len(kept) == len(found))


def _choice(programs: list[dict[str, Rule]], field: str, key: Case, build: Callable[[object], Column]) -> Column | None:
    """CASE over set numbers; sets with an equal key share a branch, None means no branch. None if no set has one."""
    branches: dict[str, tuple[object, list[int]]] = {}
    for n, program in enumerate(programs):
        wanted = key(program[field]) if field in program else None
        if wanted is not None:
            branches.setdefault(json.dumps(wanted, sort_keys=True), (wanted, []))[1].append(n)
    chosen = F
    for wanted, numbers in branches.values():
        chosen = chosen.when(F.col("_set").isin(numbers), build(wanted))
    return chosen if branches else None


def _default(rule: Rule) -> str | None:
    return (rule.get("default") or "").strip(K.WHITESPACE) or None


def _pattern(rule: Rule) -> list | None:
    return [rule["pattern"], rule["regex_group"], rule.get("regex_all", False), rule.get("join_with", ",")] if rule.get("pattern") else None


def _matched(text: Column, pattern: str, group: int, every: bool, join_with: str) -> Column:
    if not every:
        return F.regexp_extract(text, pattern, group)
    stripped = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), strip)
    return F.array_join(F.filter(stripped, lambda m: m != ""), join_with)


def _translated(text: Column, values: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), text)


def apply_sets(rows: DataFrame, programs: list[dict[str, Rule]]) -> DataFrame:
    """All target fields of ledger rows ``(site, row_no, raw, _set)``: cell or default, pattern, value map, each step over all fields at once."""
    kept = ["site", "row_no", "raw"]
    none = F.lit(None).cast("string")

    def step(df: DataFrame, change: Callable[[str], Column | None]) -> DataFrame:
        changed = {f: c for f in K.TARGET_FIELDS if (c := change(f)) is not None}
        return df.withColumns(changed) if changed else df

    def cell(field):
        found = _choice(programs, field, lambda r: r.get("source"), lambda source: F.try_element_at("raw", F.lit(source)))
        return none if found is None else strip(found)

    def filled(field):
        given = F.when(F.col(field) != "", F.col(field))
        default = _choice(programs, field, _default, F.lit)
        return given if default is None else F.coalesce(given, default)

    def matched(field):
        found = _choice(programs, field, _pattern, lambda p: _matched(F.col(field), *p))
        return None if found is None else found.otherwise(F.col(field))

    def translated(field):
        found = _choice(programs, field, lambda r: r.get("value_map") or None, lambda values: _translated(F.col(field), values))
        return None if found is None else found.otherwise(F.col(field))

    def cleaned(field):
        if any(_pattern(p[field]) or p[field].get("value_map") for p in programs if field in p):
            return F.when(strip(F.col(field)) != "", strip(F.col(field)))
        return None

    df = rows.select(*kept, "_set")
    for change in (cell, filled, matched, translated, cleaned):
        df = step(df, change)
    return df.select(*kept, *K.TARGET_FIELDS)
