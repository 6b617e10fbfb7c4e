"""Text columns: cleaning, splitting, labels, titles, tokens."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom import constants as K

def no_texts() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of any kind, not only blanks."""
    return F.trim(c, F.lit(K.WHITESPACE))


def squash(c: Column) -> Column:
    """Collapse whitespace runs to one blank and strip."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def null_if_empty(c: Column) -> Column:
    return let(c, lambda s: F.when(s != "", s))


def clean_text(c: Column) -> Column:
    """Stripped text; null when nothing is left."""
    return null_if_empty(strip(c.cast("string")))


def clean_number_text(c: Column) -> Column:
    """A double as text; NaN counts as blank."""
    return F.when(~F.isnan(c), c.cast("string"))


def iso_timestamp(c: Column) -> Column:
    """ISO text of a timestamp; microseconds only when there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def is_blank(c: Column) -> Column:
    """Whether nothing is left of a text; without a lambda, so that filters and projections using it stay compiled."""
    return F.coalesce(F.ltrim(c.cast("string"), F.lit(K.WHITESPACE)) == "", F.lit(True))


def split_trimmed(c: Column, separator: str) -> Column:
    """Split, trim each part, drop empty parts; null gives an empty array."""
    parts = F.filter(F.transform(F.split(c, separator), lambda x: strip(x)), lambda x: x != "")
    return F.coalesce(parts, no_texts())


def split_csv(c: Column) -> Column:
    return split_trimmed(c, ",")


def split_prices(c: Column) -> Column:
    """Split a price list; a comma between 1-3 digits and exactly 3 digits belongs to the number."""
    tight = F.regexp_replace(c, r"(?U)\s+,", ",")
    return split_trimmed(tight, r",(?!(?<=(?<![0-9])[0-9]{1,3},)\s*[0-9]{3}(?![0-9]))")


def option_display_name(*values: Column) -> Column:
    return F.concat_ws(" / ", *[clean_text(v) for v in values])


def quoted(value) -> str:
    """A string as a SQL literal."""
    return "NULL" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Translate through a small fixed dictionary."""
    table = F.expr(f"map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in mapping.items())})")
    found = F.try_element_at(table, c)
    return found if default is None else F.coalesce(found, default)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(F.lit(w)) for w in words], F.lit(False))


def strip_labels(field: str, value: Column) -> Column:
    """Remove a label caught together with the value of one declared field."""

    def captured(pattern: str) -> Column:
        return F.when(value.rlike(pattern), strip(F.regexp_extract(value, pattern, 1)))

    if field == "origin":
        picked = F.coalesce(captured(K.ORIGIN_LABEL), captured(K.ORIGIN_ANY_LABEL))
    elif field == "supply_price":
        by_label = [captured(label + r"\s*[:：]\s*([0-9][0-9,]*\s*원?)") for label in K.PRICE_LABELS]
        picked = F.when(F.regexp_count(value, F.lit(K.PRICE_LABEL_COUNT)) >= 2, F.coalesce(*by_label))
    elif field in K.LABEL_PATTERNS:
        picked = captured(K.LABEL_PATTERNS[field])
    else:
        return value
    return F.coalesce(F.when(~is_blank(value), picked), value)


def normalize_category_path(c: Column) -> Column:
    """Drop the market prefix, trim the levels, drop empty ones."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(?:네이버|naver)\s*:\s*", "")
    return F.array_join(split_trimmed(bare, ">"), ">")


def redact_credentials(c: Column) -> Column:
    """Replace credential-shaped values by a marker, keeping their quotes.

    The patterns run only over texts in which one of their words occurs at all.
    """
    quoted_marker = "$1$2$3[REDACTED]$2$3"
    redacted = F.regexp_replace(c, K.SECRET_PATTERNS[0], quoted_marker)
    redacted = F.regexp_replace(redacted, K.SECRET_PATTERNS[1], "$1[REDACTED]")
    redacted = F.regexp_replace(redacted, K.SECRET_PATTERNS[2], quoted_marker)
    suspicious = let(F.lower(c), lambda low: contains_any(low, K.SECRET_WORDS))
    return F.when(suspicious, redacted).otherwise(c)


def sanitize_text(c: Column, limit: int | None = None, drop_tags: bool = False) -> Column:
    """Remove back-quotes, control characters and (optionally) tags; collapse whitespace; cut to a length."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), K.UNPRINTABLE, " ")
    if drop_tags:
        c = F.regexp_replace(c, r"<[^>]*>", " ")
    c = squash(c)
    return c if limit is None else F.substring(c, 1, limit)


def detect_platform(html: Column, url: Column) -> Column:
    """First shop platform, in fixed order, one of whose markers occurs in page or address."""
    hay = F.lower(F.concat_ws("\n", F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))))
    hits = [F.when(contains_any(hay, markers), F.lit(name)) for name, markers in K.PLATFORM_MARKERS]
    return F.coalesce(*hits)


def change_lines(fields: Column, old: Column, new: Column) -> Column:
    """One line per changed field: ``label: old → new``, or ``label: 변경됨`` when both are null."""
    def line(field):
        label = lookup(field, K.FIELD_LABELS, field)
        before, after = F.try_element_at(old, field), F.try_element_at(new, field)
        changed = F.concat(label, F.lit(": "), F.coalesce(before, F.lit("null")), F.lit(" → "), F.coalesce(after, F.lit("null")))
        return F.when(before.isNull() & after.isNull(), F.concat(label, F.lit(": 변경됨"))).otherwise(changed)

    return F.transform(fields, line)


def change_tooltip(change_type: Column, fields: Column, lines: Column) -> Column:
    """Badge text by change type."""
    return (
        F.when(change_type == "new", F.lit("새 도매처 상품"))
        .when(change_type == "removed", F.lit("도매처 목록에서 사라진 단종 상품"))
        .when(F.size(lines) > 0, F.array_join(lines, "\n"))
        .when(F.size(fields) > 0, F.concat(F.lit("변경 항목: "), F.array_join(fields, ", ")))
        .otherwise(F.lit("변동"))
    )


def compose_title(brand: Column, refined: Column, keywords: Column) -> Column:
    """Brand, refined name and first keyword, each left out when already contained."""
    parts = F.struct(
        F.coalesce(clean_text(brand), F.lit("")).alias("brand"),
        F.coalesce(clean_text(refined), F.lit("")).alias("refined"),
        F.coalesce(F.try_element_at(F.filter(F.transform(keywords, lambda k: strip(k)), lambda k: k != ""), F.lit(1)),
                   F.lit("")).alias("keyword"))

    def head(p):
        both = (p["brand"] != "") & (p["refined"] != "") & ~p["refined"].contains(p["brand"])
        return (F.when(both, F.concat_ws(" ", p["brand"], p["refined"]))
                .when(p["refined"] != "", p["refined"]).otherwise(p["brand"]))

    def title(p):
        start, keyword = p["head"], p["keyword"]
        return F.when((keyword == "") | start.contains(keyword), start).otherwise(
            F.concat_ws(" ", null_if_empty(start), keyword))

    return let(let(parts, lambda p: F.struct(head(p).alias("head"), p["keyword"].alias("keyword"))), title)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, for which Spark has no built-in."""
    return texts.str.normalize("NFKC")


def tokens_of(c: Column, normalize: bool = True) -> Column:
    """Word tokens: compatibility-normalised, runs of non-word characters and underscores act as blanks."""
    text = nfkc(c) if normalize else c
    spaced = strip(F.regexp_replace(text, r"(?U)[_\W]+", " "))
    return F.array_remove(F.split(F.coalesce(spaced, F.lit("")), " "), "")


def folded(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def tokens_fit(tokens: Column) -> Column:
    """Within the token, length and repetition bounds of a listing name."""
    def repeats_ok(low):
        return F.forall(low, lambda t: F.size(F.filter(low, lambda u: u == t)) <= K.NAME_MAX_REPEATS)

    return (
        (F.size(tokens) > 0)
        & (F.size(tokens) <= K.NAME_MAX_TOKENS)
        & (F.char_length(F.array_join(tokens, " ")) <= K.NAME_MAX_LENGTH)
        & let(folded(tokens), repeats_ok)
    )


def word_set(c: Column) -> Column:
    """Distinct lower-case word tokens (digits, Latin letters, Hangul)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z가-힣]+"), F.lit(0)))
