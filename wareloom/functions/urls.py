"""URL and image-address columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.text import null_if_empty, strip

def before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_site(url: Column) -> Column:
    """Scheme and host part."""
    return F.regexp_extract(url, r"^((?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?)", 1)


def query_pairs(url: Column) -> Column:
    """Non-blank query parameters in order, as structs of name and value."""
    parts = F.filter(F.split(url_query(url), "&"), lambda p: p.rlike("^[^=]*=."))
    return F.transform(parts, lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"),
        F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))


def query_value(url: Column, name: str | Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    hits = F.filter(query_pairs(url), lambda p: p["name"] == name)
    return F.try_element_at(hits, F.lit(1))["value"]


def url_value(url: Column, param: str | None = None, pattern: str | None = None) -> Column:
    """Value of a query parameter if one is named, else group 1 of a pattern."""
    if param:
        return query_value(url, param)
    if pattern:
        return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))
    return F.lit(None).cast("string")


def category_id(url: Column, fallback: Column) -> Column:
    """First non-blank query value, else last path segment, else the fallback, else the address itself."""
    first = F.try_element_at(query_pairs(url), F.lit(1))["value"]
    tail = last_segment(F.regexp_replace(url_path(url), "/+$", ""))
    return F.coalesce(first, null_if_empty(tail), null_if_empty(fallback), url)


def listing_url(category: Column, url: Column, page: Column, template: str | None = None,
                start: int = 1, page_param: str = "page") -> Column:
    """Address of one listing page, from a template or by appending the page parameter."""
    if template:
        filled = F.replace(F.lit(template), F.lit("{category_id}"), category)
        return F.replace(filled, F.lit("{page}"), page.cast("string"))
    base = F.coalesce(null_if_empty(url), category, F.lit(""))
    mark = F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    paged = F.concat(base, mark, F.lit(f"{page_param}="), page.cast("string"))
    return F.when((base != "") & (page > start), paged).otherwise(base)


def _normal_path(path: Column) -> Column:
    """Resolve "." and ".." path segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(p == ".", acc).otherwise(F.array_append(acc, p)))
    joined = F.array_join(kept, "/")
    return F.when(path.rlike(r"/\.\.?$"), F.concat(joined, F.lit("/"))).when(path.contains("/."), joined).otherwise(path)


def url_join(base: Column | str, ref: Column) -> Column:
    """Make ``ref`` absolute against ``base``."""
    base = F.lit(base) if isinstance(base, str) else base
    site = url_site(base)
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    folder = F.when((folder == "") & (site != ""), F.lit("/")).otherwise(folder)
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    return (
        F.when((base == "") | base.isNull(), ref)
        .when(ref == "", base)
        .when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(site, _normal_path(ref_path), tail))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .otherwise(F.concat(site, _normal_path(F.concat(folder, ref_path)), tail))
    )


def is_placeholder_src(c: Column) -> Column:
    """Empty, data: or spacer-style image source."""
    text = strip(F.coalesce(c, F.lit("")))
    return (text == "") | F.lower(text).startswith("data:") | text.rlike(K.JUNK_IMAGE_PATTERN)


def image_url(c: Column, base: Column | str = "") -> Column:
    """Absolute address of an acceptable image: known extension, or no extension at all; junk is refused."""
    text = strip(c)
    path = F.lower(before(before(text, "?"), "#"))
    known = F.lit(False)
    for ext in K.IMAGE_EXTENSIONS:
        known = known | path.endswith(ext)
    return F.when(~is_placeholder_src(c) & (known | ~last_segment(path).contains(".")), url_join(base, text))


def image_key(c: Column, base: Column | str = "") -> Column:
    """Identity of an image across size variants: lower-case file name without size prefix or suffix."""
    absolute = url_join(base, c)
    name = F.lower(last_segment(before(before(absolute, "?"), "#")))
    dotted = name.contains(".")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    stem = F.regexp_replace(stem, "_(?:s|m|l|t|th|small|medium|large|thumb)$", "")
    stem = F.regexp_replace(stem, "^(?:small|thumb|th)_", "")
    keyed = F.when(dotted, F.concat(stem, F.lit("."), F.substring_index(name, ".", -1))).otherwise(stem)
    return F.when(name == "", F.lower(absolute)).otherwise(keyed)


def without_image(images: Column, excluded: Column, base: Column | str = "") -> Column:
    """Drop every size variant of one image from a list."""
    key = image_key(excluded, base)
    others = F.filter(images, lambda i: image_key(i, base) != key)
    return F.when(F.coalesce(excluded, F.lit("")) == "", images).otherwise(others)


def lazy_source(attrs: Column) -> Column:
    """Real source of a lazily loaded image: first non-placeholder attribute, else first srcset entry, else src."""
    names = F.array(*[F.lit(name) for name in K.LAZY_IMAGE_ATTRIBUTES])
    values = F.filter(F.transform(names, lambda name: strip(F.try_element_at(attrs, name))), lambda value: ~is_placeholder_src(value))
    srcset = strip(F.try_element_at(attrs, F.lit("srcset")))
    first = F.substring_index(strip(before(srcset, ",")), " ", 1)
    listed = F.when((first != "") & ~first.rlike(K.JUNK_IMAGE_PATTERN), first)
    return F.coalesce(F.get(values, 0), listed, strip(F.try_element_at(attrs, F.lit("src"))), F.lit(""))


def is_large_enough(attrs: Column, minimum: int = K.DETAIL_IMAGE_MIN_PX) -> Column:
    """False only when both declared sides are known and under the minimum."""
    def side(name):
        digits = F.regexp_extract(F.try_element_at(attrs, F.lit(name)), r"^\s*([0-9]+)", 1).try_cast("int")
        return F.coalesce(digits, F.lit(0))
    w, h = side("width"), side("height")
    return ~((w > 0) & (h > 0) & (w < minimum) & (h < minimum))


def basename(url: Column) -> Column:
    return last_segment(before(url, "?"))
