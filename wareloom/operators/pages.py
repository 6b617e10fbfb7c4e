"""Values read out of stored pages.

Pages are taken apart once into the node table (``nodes.py``); selectors, attributes and fallbacks are then joins and sweeps over it. Selectors
know tag, #id, .class, [attr], [attr=value], [attr*=value], [attr^=value], descendants and comma groups; others are reported as unsupported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import numbers as num
from wareloom.functions import option_text as ot
from wareloom.functions import status as st
from wareloom.functions import text as tx
from wareloom.functions import urls as ur
from wareloom.functions.rows import explode_built
from wareloom.functions.text import let, no_texts, null_if_empty, strip
from wareloom.operators import nodes as nd

_TAG = r'''(?:[^>"']|"[^"]*"|'[^']*')*'''
_VALUE = r'''(?:"([^"]*)"|'([^']*)'|([^\s>"']+))'''


def _unescape(c: Column) -> Column:
    for mark, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(text))
    return c


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?i)\s{name}\s*=\s*{_VALUE}"
    return _unescape(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def detail_images(detail: Column) -> Column:
    """A bare address as it is, else the sources of all images in order."""
    text = strip(detail)
    visible = F.regexp_replace(text, "(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(visible, F.lit(rf"(?i)<img\b{_TAG}>"), F.lit(0))
    sources = F.filter(F.transform(tags, lambda t: _attribute(t, "src")), lambda s: s != "")
    return F.when(text.rlike(r'^https?://[^\s<>"]+$'), F.array(text)).otherwise(F.coalesce(sources, no_texts()))


def _meta(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, rf"""(?i)<meta\b{_TAG}\sproperty\s*=\s*["']?{name}["'\s>]{_TAG}>?""", 0)
    return null_if_empty(_attribute(tag, "content"))


def structured_data(html: Column) -> Column:
    """``struct<og_title, og_image, og_price, ld_name, ld_image, ld_price>`` from page metadata and the first product entries."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?si)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    as_list = lambda text: F.from_json(text, "array<string>")
    def listed(block):
        graph = F.get_json_object(block, "$['@graph']")
        return F.coalesce(F.when(strip(block).startswith("["), as_list(block)).when(graph.isNotNull(), as_list(graph)).otherwise(F.array(block)), no_texts())
    def is_product(node):
        kind = F.get_json_object(node, "$['@type']")
        return (kind == "Product") | (kind.startswith("[") & kind.contains('"Product"'))
    nodes = F.filter(F.flatten(F.transform(blocks, listed)), lambda n: F.coalesce(is_product(n), F.lit(False)))
    def first_of(nodes, value):
        return F.try_element_at(F.filter(F.transform(nodes, value), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(1))
    def image(n):
        found = F.get_json_object(n, "$.image")
        one = F.when(found.startswith("["), F.get_json_object(n, "$.image[0]")).otherwise(found)
        return F.when(one.startswith("{"), F.get_json_object(one, "$.url")).otherwise(one)
    price = lambda n: F.coalesce(F.get_json_object(n, "$.offers.price"), F.get_json_object(n, "$.offers[0].price"))
    parts = let(nodes, lambda found: F.struct(
        first_of(found, lambda n: F.get_json_object(n, "$.name")).alias("ld_name"), first_of(found, image).alias("ld_image"), first_of(found, price).alias("ld_price")))
    return F.struct(_meta(html, "og:title").alias("og_title"), _meta(html, "og:image").alias("og_image"), _meta(html, "product:price:amount").alias("og_price"),
                    parts["ld_name"].alias("ld_name"), parts["ld_image"].alias("ld_image"), parts["ld_price"].alias("ld_price"))


def _attribute_of(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def evidence(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, options, images): a choice list with two or more real options that is no quantity; two or more images."""
    quantity = tx.contains_any(F.lower(F.concat_ws(" ", _attribute_of("name"), _attribute_of("id"))), K.QUANTITY_SELECT_MARKERS)
    lists = nodes.filter((F.col("tag") == "select") & ~quantity).select(F.col("page_id").alias("_page"), F.col("ord").alias("_list"), "last")
    choices = nd.with_text(nd.select(nodes, {"option": "option"}), nodes).filter(~ot.is_placeholder(F.col("text"))).select("page_id", "ord")
    within = (F.col("page_id") == F.col("_page")) & (F.col("ord") > F.col("_list")) & (F.col("ord") <= F.col("last"))
    real = choices.join(lists, within).groupBy("page_id", "_list").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("page_id").distinct()
    shown = nodes.filter((F.col("tag") == "img") & ((_attribute_of("src") != "") | (_attribute_of("data-src") != "")))
    many = shown.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("page_id")
    out = pages.select("page_id").join(real.withColumn("options", F.lit(True)), "page_id", "left").join(many.withColumn("images", F.lit(True)), "page_id", "left")
    return out.select("page_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("options", "images")])


def _in_order(rows: DataFrame, value: Column) -> DataFrame:
    """(page_id, name, values): the filled values of each page and name, by document order."""
    filled = rows.withColumn("value", value).filter(F.coalesce("value", F.lit("")) != "")
    listed = filled.groupBy("page_id", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    return listed.select("page_id", "name", F.col("v.value").alias("values"))


def _real_images(chosen: DataFrame, minimum: int) -> DataFrame:
    large = chosen.filter(ur.is_large_enough(F.col("attrs"), minimum))
    large = explode_built(large, F.array(ur.lazy_source(F.col("attrs"))), "page_id", "name", "ord", name="_source")  # chosen once, not per test on it
    listed = _in_order(large.filter(~F.col("_source").rlike(K.SKIP_IMAGE_PATTERN)), F.col("_source"))
    return listed.withColumn("values", F.array_distinct("values"))


def collect_images(nodes: DataFrame, pages: DataFrame, selector: str, minimum: int = K.DETAIL_IMAGE_MIN_PX) -> DataFrame:
    """(page_id, images): real image addresses at or below the selected elements, without icons, buttons and clearly small ones."""
    found = _real_images(nd.select(nodes, {"images": selector}, images=["images"]), minimum)
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("values", no_texts()).alias("images"))


_MAXQ, _BUTTON = " maxq", " button"  # names beside those of the fields


def _selector(extractor: dict) -> str:
    selector = (extractor.get("selector") or "").strip()
    return selector if selector and nd.supported(selector) else ""


def _many_images(extractor: dict) -> bool:
    return bool(extractor.get("multiple")) and extractor.get("attribute") in ("src", "data-src")


def _choose(options: dict[str, Column], otherwise: Column) -> Column:
    """The expression of the row's ``name``."""
    out = None
    for name, value in options.items():
        test = F.col("name") == name
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def _selected_values(nodes: DataFrame, pages: DataFrame, chosen: DataFrame, extractors: dict[str, dict]) -> DataFrame:
    """(page_id, name, values) that the selectors yield."""
    images = [f for f, x in extractors.items() if _many_images(x)]
    single = [f for f, x in extractors.items() if not x.get("multiple")]
    listed = [f for f, x in extractors.items() if x.get("multiple") and f not in images]
    parts = []
    if images:
        parts.append(_real_images(chosen.filter(F.col("name").isin(images)), K.DETAIL_IMAGE_MIN_PX))
    if single or listed:
        rest = [c for c in chosen.columns if c not in ("page_id", "name")]
        firsts = chosen.filter(F.col("name").isin(single)).groupBy("page_id", "name").agg(F.min_by(F.struct(*rest), F.col("ord")).alias("n")).select("page_id", "name", "n.*")
        rows = firsts.unionByName(chosen.filter(F.col("name").isin(listed)))
        source = {f: "html" if x.get("html") else "attribute" if x.get("attribute") else "text" for f, x in extractors.items() if f not in images}
        read = []
        of = lambda kind: [f for f, s in source.items() if s == kind]
        if of("html"):
            marked = rows.filter(F.col("name").isin(of("html"))).join(pages.select("page_id", "html"), "page_id")
            read.append(marked.withColumn("raw", F.substr("html", F.col("start") + 1, F.col("end") - F.col("start"))))
        if of("attribute"):
            get = lambda name: null_if_empty(F.try_element_at("attrs", F.lit(name)))

            def value(x):
                if x["attribute"] in ("src", "data-src"):
                    return null_if_empty(ur.lazy_source(F.col("attrs")))
                return F.coalesce(get(x["attribute"]), get(x["fallback_attribute"])) if x.get("fallback_attribute") else get(x["attribute"])

            read.append(rows.filter(F.col("name").isin(of("attribute"))).withColumn("raw", _choose({f: value(extractors[f]) for f in of("attribute")}, F.lit(None).cast("string"))))
        if of("text"):
            read.append(nd.with_text(rows.filter(F.col("name").isin(of("text"))), nodes).withColumn("raw", F.col("text")))
        together = None
        for df in read:
            df = df.select("page_id", "name", "ord", "raw")
            together = df if together is None else together.unionByName(df)
        ready = {f: num.transformed(tx.strip_labels(f, F.col("raw")), extractors[f].get("transform", "strip")) for f in single}
        parts.append(_in_order(together, _choose(ready, F.col("raw"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    skips = {f: F.slice("values", F.lit(x["skip_first"] + 1), F.greatest(F.size("values") - x["skip_first"], F.lit(0))) for f, x in extractors.items() if x.get("multiple") and x.get("skip_first")}
    return out.withColumn("values", _choose(skips, F.col("values")))


def _sold_out_pages(nodes: DataFrame) -> DataFrame:
    """(page_id) of pages with an element whose text says that the product is sold out.

    Pages whose whole text could say so are found first; only their elements' texts are put together.
    """
    shown = nodes.filter((F.col("tag") == nd.TEXT) & F.col("text").isNotNull())
    whole = shown.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "").alias("t"))
    suspects = nodes.join(whole.filter(F.col("t").rlike(K.SOLD_OUT_HINT)).select("page_id"), "page_id", "left_semi")
    elements = suspects.filter(F.col("tag") != nd.TEXT).select("page_id", "ord", "last")
    return nd.with_text(elements, suspects).filter(st.is_sold_out_text(F.col("text"))).select("page_id").distinct()


def extract_fields(nodes: DataFrame, pages: DataFrame, extractors: dict[str, dict]) -> DataFrame:
    """Rows ``page_id, field, values, problem`` for all declared fields of every page; pages need ``page_id, url, html``.

    A field is read by its selector, then by its declared fallback, then as its literal. ``extractors`` keys: selector, attribute,
    fallback_attribute, transform, html, multiple, skip_first, fallback, fallback_from (url, maxq, cart_button), url_param, url_pattern.
    A field whose selector is not supported is read by its fallbacks only, and ``problem`` says so.
    """
    selectors = {f: _selector(x) for f, x in extractors.items() if _selector(x)}
    source = {f: x.get("fallback_from", "none") for f, x in extractors.items()}
    helpers = {}
    if "maxq" in source.values():
        helpers[_MAXQ] = "input[name=maxq]"
    if any(source[f] == "cart_button" and f not in selectors for f in extractors):
        helpers[_BUTTON] = "button, a"
    images = [f for f in selectors if _many_images(extractors[f])]
    buttons = {f: f + _BUTTON for f in selectors if source[f] == "cart_button"}
    chosen = nd.select(nodes, {**selectors, **helpers, **{buttons[f]: selectors[f] for f in buttons}}, images)
    frame = pages.select("page_id", "url").withColumn("name", F.explode(F.array(*[F.lit(f) for f in extractors])))
    if selectors:
        found = _selected_values(nodes, pages, chosen.filter(F.col("name").isin(list(selectors))), {f: extractors[f] for f in selectors})
        frame = frame.join(found, ["page_id", "name"], "left").withColumnRenamed("values", "_selected")
    else:
        frame = frame.withColumn("_selected", F.lit(None).cast("array<string>"))
    if _MAXQ in helpers:
        limits = chosen.filter(F.col("name") == _MAXQ).groupBy("page_id").agg(F.min_by(F.struct(F.try_element_at("attrs", F.lit("value")).alias("v")), F.col("ord"))["v"].alias("_limit"))
        frame = frame.join(limits, "page_id", "left")
    if "cart_button" in source.values():
        frame = frame.join(_sold_out_pages(nodes).withColumn("_sold_out", F.lit(True)), "page_id", "left")
        present = chosen.filter(F.col("name").isin(list(buttons.values()))) if buttons else chosen.limit(0)
        if _BUTTON in helpers:
            inviting = nd.with_text(chosen.filter(F.col("name") == _BUTTON), nodes).filter(F.col("text").rlike(K.CART_BUTTON_PATTERN))
            present = present.select("page_id", "name").unionByName(inviting.select("page_id", "name"))
        flags = present.groupBy("page_id").agg(F.collect_set("name").alias("_buttons"))
        frame = frame.join(flags, "page_id", "left")
    keep = lambda items: F.filter(items, lambda v: F.coalesce(v, F.lit("")) != "")

    def fallbacks(field: str) -> Column:
        x = extractors[field]
        ready = lambda v: num.transformed(v, x.get("transform", "strip"))
        steps = []
        if source[field] == "url":
            steps.append(keep(F.array(ready(ur.url_value(F.col("url"), x.get("url_param"), x.get("url_pattern"))))))
        elif source[field] == "maxq":
            steps.append(keep(F.array(st.limit_status(F.col("_limit")))))
        elif source[field] == "cart_button":
            button = F.coalesce(F.array_contains("_buttons", buttons.get(field, _BUTTON)), F.lit(False))
            missing = F.lit("sold_out") if field in selectors else F.lit(None).cast("string")
            steps.append(keep(F.array(F.when(F.col("_sold_out"), F.lit("sold_out")).when(button, F.lit("available")).otherwise(missing))))
        if x.get("fallback"):
            steps.append(keep(F.array(ready(F.lit(x["fallback"])))))
        result = no_texts()
        for step in reversed(steps):
            result = (lambda s, r: let(s, lambda v: F.when(F.size(v) > 0, v).otherwise(r)))(step, result)
        return result

    def problem(extractor):
        selector = (extractor.get("selector") or "").strip()
        return F.lit(f"unsupported selector: {selector}" if selector and not nd.supported(selector) else None).cast("string")

    values = F.when(F.size(F.coalesce("_selected", no_texts())) > 0, F.col("_selected")).otherwise(_choose({f: fallbacks(f) for f in extractors}, no_texts()))
    return frame.select("page_id", F.col("name").alias("field"), values.alias("values"), _choose({f: problem(x) for f, x in extractors.items()}, F.lit(None).cast("string")).alias("problem"))


def product_links(nodes: DataFrame, pages: DataFrame, selector: str, attribute: str = "href", base: Column | None = None) -> DataFrame:
    """Absolute addresses of the selected links, ``page_id, ord, url``."""
    links = nd.select(nodes, {"link": selector}).withColumn("href", F.try_element_at("attrs", F.lit(attribute))).filter(F.coalesce("href", F.lit("")) != "")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    placed = links.select("page_id", place.alias("ord"), "href")
    addressed = placed.join(pages.select("page_id", (F.col("url") if base is None else base).alias("_base")), "page_id")
    return addressed.select("page_id", "ord", ur.url_join(F.col("_base"), F.col("href")).alias("url"))


def audit_extractors(nodes: DataFrame, pages: DataFrame, extractors: dict[str, dict], link_selector: str | None = None) -> DataFrame:
    """Per declared field: pages checked and pages where its selector yields a value, over stored sample pages.

    Fields without selector, with an automatic fallback or with an unsupported selector cannot be checked and are left
    out. ``product_link`` counts pages with at least one matching link.
    """
    checkable = {f: {**x, "fallback": None} for f, x in extractors.items() if _selector(x) and x.get("fallback_from", "none") == "none"}
    parts = []
    if checkable:
        parts.append(extract_fields(nodes, pages, checkable).select("field", (F.size("values") > 0).alias("ok")))
    if link_selector and nd.supported(link_selector):
        linked = nd.select(nodes, {"product_link": link_selector}).select("page_id").distinct().withColumn("ok", F.lit(True))
        parts.append(pages.select("page_id").join(linked, "page_id", "left").select(F.lit("product_link").alias("field"), F.coalesce("ok", F.lit(False)).alias("ok")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("pages"), F.count_if("ok").alias("ok_pages"))
