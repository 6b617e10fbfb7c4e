"""Quality audits: export checks, extraction checks, link and selector choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import numbers as num
from wareloom.functions import text as tx
from wareloom.functions import urls as ur
from wareloom.functions.rows import explode_built
from wareloom.functions.skew import join_per_key, salted
from wareloom.functions.text import clean_text

BLOCKING = ("raw_product_name", "supplier_product_code", "supplier_status")
ADVISORY = ("origin", "supply_price", "main_image_url")


def _missing(field: str) -> Column:
    column = F.col(field)
    return column.isNull() | (column.cast("string") == "")


def export_summary(products: DataFrame, options: DataFrame, supplier_id=None) -> DataFrame:
    """One row: products, options, missing required and advisory values, latest sighting. No supplier means all."""
    if supplier_id is not None:
        products = products.filter(F.col("supplier_id") == supplier_id)
    counts = [F.count_if(_missing(f)).alias(f"missing_{f}") for f in BLOCKING + ADVISORY]
    facts = products.agg(F.count(F.lit(1)).alias("product_count"), *counts, F.max("last_seen_on").alias("last_seen"))
    scoped = options if supplier_id is None else options.join(products.select("product_id"), "product_id", "left_semi")
    option_count = scoped.agg(F.count(F.lit(1)).alias("option_count"))
    total = lambda fields: sum((F.col(f"missing_{f}") for f in fields), F.lit(0)).cast("bigint")
    return facts.withColumns({"option_count": option_count.scalar(), "blocking_count": total(BLOCKING), "warning_count": total(ADVISORY)})


def all_issues(products: DataFrame, supplier_id=None) -> DataFrame:
    """One row per missing value."""
    if supplier_id is not None:
        products = products.filter(F.col("supplier_id") == supplier_id)
    issue = lambda f, severity: F.when(_missing(f), F.struct(F.lit(severity).alias("severity"), F.lit(f"missing_{f}").alias("code")))
    found = F.array_compact(F.array(*[issue(f, "error") for f in BLOCKING], *[issue(f, "warning") for f in ADVISORY]))
    rows = explode_built(products, found, F.col("product_id"), F.coalesce("supplier_product_code", F.lit("")).alias("product_code"), name="i")
    return rows.select("i.severity", "i.code", "product_id", "product_code")


def issue_list(products: DataFrame, options: DataFrame, supplier_id=None, limit: int = 50) -> DataFrame:
    """The report: first ``limit`` issues, errors first, and one closing row telling how many more there are.

    An empty scope gives one blocking row.
    """
    first = all_issues(products, supplier_id).orderBy(F.col("severity") != "error", "product_code", "code", "product_id").limit(limit)
    totals = export_summary(products, options, supplier_id)
    count = F.col("blocking_count") + F.col("warning_count")
    more = F.struct(F.when(F.col("blocking_count") > limit, F.lit("error")).otherwise(F.lit("warning")).alias("severity"),
                    F.lit("more_issues").alias("code"), (count - limit).alias("hidden"))
    empty = F.struct(F.lit("error").alias("severity"), F.lit("empty_scope").alias("code"), F.lit(0).cast("bigint").alias("hidden"))
    closing = totals.select(F.when(F.col("product_count") == 0, empty).when(count > limit, more).alias("r")).filter("r is not null")
    return first.withColumn("hidden", F.lit(0).cast("bigint")).unionByName(
        closing.select("r.severity", "r.code", F.lit(None).cast("bigint").alias("product_id"), F.lit("").alias("product_code"), "r.hidden"))


def scope_fingerprint(products: DataFrame, options: DataFrame, supplier_id=None) -> DataFrame:
    """Hash that changes when the scope, its counts or any issue changes.

    Issues enter as a sum of per-issue hashes, which needs no ordering and no collecting of all issues in one place.
    """
    identity = F.concat_ws("~", "severity", "code", F.col("product_id").cast("string"), "product_code")
    per_issue = F.conv(F.substring(F.md5(identity), 1, 15), 16, 10).cast("decimal(38,0)")
    digest = all_issues(products, supplier_id).agg(F.coalesce(F.sum(per_issue), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))
    joined = export_summary(products, options, supplier_id).withColumn("digest", digest.scalar())
    parts = ["product_count", "option_count", *[f"missing_{f}" for f in BLOCKING + ADVISORY], "last_seen", "digest"]
    scope = F.lit("all" if supplier_id is None else str(supplier_id))
    text = F.concat_ws("~", scope, *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return joined.select(F.sha2(text, 256).alias("fingerprint"))


def value_ok(field: Column, value: Column, url: Column, images: Column) -> Column:
    """Whether an extracted value is plausible for its field. ``images`` counts images, null where not applicable."""
    value = tx.strip(F.coalesce(value, F.lit("")))
    compact = tx.squash(value)
    origin = (value != "") & (F.char_length(compact) <= 30) & ~compact.rlike(K.ORIGIN_NOISE)
    code = (value != "") & (value != tx.strip(F.coalesce(url, F.lit("")))) & ~value.rlike("^https?://")
    counted = field.isin("detail_content", "extra_image_urls") & images.isNotNull()
    return (
        F.when(field == "raw_product_name", (value != "") & (value != "이름 없음"))
        .when(field == "supply_price", value.rlike("[0-9]"))
        .when(field == "main_image_url", (value != "") & (value.contains("/") | value.contains(".") | value.startswith("data:")))
        .when(counted, images > 0)
        .when(field == "origin", origin)
        .when(field.isin("supplier_product_code", "supplier_product_id"), code)
        .otherwise(value != ""))


def _checked(results: DataFrame) -> DataFrame:
    return results.withColumn("passes", value_ok(F.col("field"), F.col("value"), F.col("url"), F.col("images")))


def pass_threshold(total: Column) -> Column:
    return F.when(total <= 1, 1).when(total <= 3, 2).otherwise(
        F.greatest(F.lit(1), F.floor(total.cast("double") * F.lit(0.67) + F.lit(0.999)).cast("int")))


def field_summary(results: DataFrame) -> DataFrame:
    """Per source and field: passed, total, ok, and what a failure means there (``blocks``, ``warns`` or nothing)."""
    facts = _checked(results).groupBy("source", "field").agg(F.count_if("passes").alias("passed"), F.count(F.lit(1)).alias("total"))
    required = facts.select("source").distinct().select("source", F.explode(F.array(*[F.lit(f) for f in K.KEY_FIELDS])).alias("field"))
    both = facts.join(required.withColumn("key", F.lit(True)), ["source", "field"], "full_outer")
    ok = F.coalesce((F.col("total") > 0) & (F.col("passed") >= pass_threshold(F.col("total"))), F.lit(False))
    role = F.when(~F.col("ok") & F.col("key"), F.lit("blocks")).when(~F.col("ok") & F.col("field").isin(*K.WARNING_FIELDS), F.lit("warns"))
    zero = F.lit(0).cast("bigint")
    return both.withColumns({"passed": F.coalesce("passed", zero), "total": F.coalesce("total", zero), "ok": ok}).select(
        "source", "field", "passed", "total", "ok", role.alias("role"))


def save_gate(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Per source: may its extractor be saved without a warning? ``sources`` has ``source, stale``."""
    failed = field_summary(results).groupBy("source").agg(F.count_if(F.col("role") == "blocks").alias("failed"))
    joined = sources.join(failed, "source", "left")
    reason = (F.when(F.col("failed").isNull(), F.lit("missing")).when(F.col("stale"), F.lit("stale"))
              .when(F.col("failed") > 0, F.lit("failed")).otherwise(F.lit("none")))
    return joined.select("source", reason.alias("reason"), (reason != "none").alias("should_warn"))


def majority(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / 2))


def sample_failures(results: DataFrame) -> DataFrame:
    """Per source and field: ``majority`` when fewer than half of the samples pass, ``constant`` when a field that must
    differ between products has one value everywhere."""
    value = tx.strip(F.coalesce("value", F.lit("")))
    filled = F.when(value != "", value)
    facts = _checked(results).groupBy("source", "field").agg(
        F.count_if("passes").alias("passed"), F.count(F.lit(1)).alias("n"), F.count(filled).alias("filled"),
        F.min(filled).alias("low"), F.max(filled).alias("high"))
    constant = F.col("field").isin(*K.DISTINCT_FIELDS) & (F.col("filled") >= 3) & (F.col("low") == F.col("high"))
    return facts.select("source", "field", F.when(F.col("passed") < majority(F.col("n")), F.lit("majority")).when(constant, F.lit("constant")).alias("failure"))


def code_equals_name(results: DataFrame) -> DataFrame:
    """Per source: whether code and name coincide on at least half of the pages that have both."""
    pick = lambda f: F.max(F.when(F.col("field") == f, tx.strip("value")))
    pages = results.filter(F.col("field").isin("supplier_product_code", "raw_product_name")).groupBy("source", "url").agg(
        pick("supplier_product_code").alias("code"), pick("raw_product_name").alias("name"))
    both = (F.col("code") != "") & (F.col("name") != "")
    facts = pages.groupBy("source").agg(F.count_if(both).alias("n"), F.count_if(both & (F.col("code") == F.col("name"))).alias("same"))
    return facts.select("source", ((F.col("n") > 0) & (F.col("same") >= majority(F.col("n")))).alias("code_is_name"))


def structured_check(results: DataFrame, structured: DataFrame) -> DataFrame:
    """Extracted values against page metadata: a name must share a word, a price must be equal; an equal image file confirms.

    ``structured``: ``url, og_title, og_image, og_price, ld_name, ld_image, ld_price``.
    """
    joined = results.filter(F.col("field").isin("raw_product_name", "supply_price", "main_image_url")).join(structured, "url")
    value = tx.strip(F.coalesce("value", F.lit("")))
    first = lambda *names: F.coalesce(*[clean_text(F.col(n)) for n in names])
    title, price, image = first("og_title", "ld_name"), first("ld_price", "og_price"), first("og_image", "ld_image")
    name_fails = (F.col("field") == "raw_product_name") & title.isNotNull() & ~F.arrays_overlap(tx.word_set(value), tx.word_set(title))
    price_fails = (F.col("field") == "supply_price") & (num.price_number(price) != num.price_number(value))
    same_file = (F.col("field") == "main_image_url") & (ur.basename(image) != "") & (ur.basename(image) == ur.basename(value))
    filled = value != ""
    return joined.select("source", "url", "field", F.coalesce(filled & (name_fails | price_fails), F.lit(False)).alias("fails"),
                         F.coalesce(filled & same_file, F.lit(False)).alias("confirmed"))


def code_parameter(urls: DataFrame) -> DataFrame:
    """Per source the query parameter that most likely carries the product code; ``urls`` has ``source, ord, url``."""
    n = urls.filter(F.col("url") != "").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.transform(ur.query_pairs(F.col("url")), lambda p, i: F.struct(p["name"].alias("name"), p["value"].alias("value"), i.alias("i")))
    rows = explode_built(urls, pairs, "source", "ord", "url", name="p")
    # A repeated parameter counts with its first value.
    once = rows.groupBy("source", "ord", "url", F.col("p.name").alias("name")).agg(F.min(F.struct("p.i", "p.value")).alias("p"))
    facts = once.groupBy("source", "name").agg(
        F.count(F.lit(1)).alias("seen"), F.min("p.value").alias("low"), F.max("p.value").alias("high"),
        F.bool_and(F.col("p.value").rlike("^[0-9]+$")).alias("digits"), F.min(F.struct("ord", "p.i")).alias("first"))
    pool = facts.join(n, "source").filter((F.col("seen") >= majority(F.col("n"))) & (F.col("low") != F.col("high")))
    rank = F.array_position(F.array(*[F.lit(p) for p in K.CODE_PARAMETERS]), F.lower("name"))
    preference = F.struct(F.when(rank > 0, rank).otherwise(999).alias("known"), F.when(F.col("digits"), 0).otherwise(1).alias("plain"), "first")
    return pool.groupBy("source").agg(F.min_by("name", preference).alias("param"))


def _code_names(url: Column) -> Column:
    """Parameters of an address that may carry a code: known names, else the only parameter."""
    names = F.array_distinct(F.transform(ur.query_pairs(url), lambda p: p["name"]))
    known = F.filter(names, lambda n: F.lower(n).isin(*K.CODE_PARAMETERS))
    return F.when(F.size(known) > 0, known).when(F.size(names) == 1, names).otherwise(tx.no_texts())


def candidate_links(links: DataFrame, references: DataFrame, limit: int = 15) -> DataFrame:
    """Best sample product links per source.

    ``links``: ``source, ord, url, image_url, name`` (addresses absolute); ``references``: ``source, reference_url``.
    With a reference, links of its path count (at least two), else those sharing a code parameter too; without one, the
    largest path group if it holds half of the links. Group sizes come from aggregates joined back per source; the
    links of one source are spread by salt, as one source may hold many of them.
    """
    path_query = lambda u: F.lower(F.concat(ur.url_path(u), F.lit("?"), ur.url_query(u)))
    norm = lambda u: F.lower(F.regexp_replace(ur.url_path(u), "/+$", ""))
    ref = F.col("reference_url")
    words = F.array(*[F.lit(w) for w in K.NON_PRODUCT_FRAGMENTS])
    rows = join_per_key(salted(links, ["url", "ord"]), references, ["source"], "left").withColumns({
        "_pq": path_query(F.col("url")), "_ref": F.coalesce(path_query(ref), F.lit("")), "_path": norm(F.col("url"))})
    rows = rows.filter(~F.exists(words, lambda w: F.col("_pq").contains(w) & ~F.col("_ref").contains(w)))
    shares = F.arrays_overlap(_code_names(F.col("url")), _code_names(ref))
    rows = rows.withColumns({"_same": F.coalesce(F.col("_path") == norm(ref), F.lit(False)), "_shared": F.coalesce(shares, F.lit(False))})
    paths = rows.groupBy("source", "_path").agg(
        F.count(F.lit(1)).alias("k"), F.count_if("_same").alias("same"), F.count_if(F.col("_same") | F.col("_shared")).alias("near"), F.min("ord").alias("o"))
    facts = paths.groupBy("source").agg(
        F.sum("k").alias("_n"), F.sum("same").alias("_n_same"), F.sum("near").alias("_n_near"),
        F.max(F.struct("k", (-F.col("o")).alias("o"), F.col("_path").alias("path"))).alias("_top"))
    rows = join_per_key(rows, facts, ["source"])
    with_ref = (F.when(F.col("_n_same") >= 2, F.col("_same")).when(F.col("_n_near") > 0, F.col("_same") | F.col("_shared")).otherwise(F.lit(True)))
    without = (F.col("_top.k") * 2 < F.col("_n")) | (F.col("_path") == F.col("_top.path"))
    name = tx.strip(F.coalesce("name", F.lit("")))
    rows = rows.filter(F.when(ref.isNotNull(), with_ref).otherwise(without) & ~name.rlike(K.NON_PRODUCT_NAMES))
    score = F.when(F.coalesce("image_url", F.lit("")) != "", 2).otherwise(0) + F.when((name != "") & (name != K.UNNAMED), 1).otherwise(0)
    rows = rows.withColumns({"score": score, "shown_name": F.when(name == "", F.lit(K.UNNAMED)).otherwise(name)})
    once = rows.groupBy("source", "url").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "shown_name")).alias("b"))
    order = Window.partitionBy("source").orderBy("b.s", "b.ord")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("source", "rank", "url", F.col("b.shown_name").alias("name"), (-F.col("b.s")).alias("score"))


_SRC = r"""src=["']([^"']+)"""


def button_signature(html: Column, text: Column) -> Column:
    """Identity of a button across pages: image file, else text, else a hash of its whole markup."""
    file = F.lower(ur.basename(F.regexp_extract(html, _SRC, 1)))
    low = F.lower(tx.strip(F.coalesce(text, F.lit(""))))
    return (F.when(html.rlike(_SRC), F.concat(F.lit("img:"), file)).when(low != "", F.concat(F.lit("text:"), low))
            .otherwise(F.concat(F.lit("html:"), F.sha2(html, 256))))


def button_selector(html: Column, text: Column) -> Column:
    file = ur.basename(F.regexp_extract(html, _SRC, 1))
    label = tx.strip(F.coalesce(text, F.lit("")))
    return (F.when(html.rlike(_SRC) & (file != ""), F.concat(F.lit("img[src*='"), file, F.lit("']")))
            .when(label != "", F.concat(F.lit("button:has-text('"), label, F.lit("')"))).otherwise(F.lit("")))


def status_rule(pages: DataFrame, buttons: DataFrame) -> DataFrame:
    """How to tell sold-out pages of a source apart: by order limit, else by a button only the available page has.

    ``pages``: ``source, available_limit, soldout_limit``; ``buttons``: ``source, side, ord, html, text``.
    """
    signed = buttons.withColumn("signature", button_signature(F.col("html"), F.col("text")))
    sold = signed.filter("side = 'soldout'").select("source", "signature")
    only = signed.filter("side = 'available'").join(sold, ["source", "signature"], "left_anti")
    blob = F.lower(F.concat("html", F.coalesce("text", F.lit(""))))
    hits = sum((blob.contains(w).cast("int") for w in K.BUY_WORDS), F.lit(0))
    best = only.groupBy("source").agg(F.max_by(F.struct("html", "text"), F.struct(hits.alias("hits"), (-F.col("ord")).alias("o"))).alias("b"))
    limit = lambda c: tx.strip(F.coalesce(c, F.lit("")))
    by_limit = (limit("soldout_limit") == "0") & ~limit("available_limit").isin("", "0")
    joined = pages.join(best, "source", "left").withColumn("selector", F.when(by_limit, F.lit("")).otherwise(
        button_selector(F.col("b.html"), F.col("b.text"))))
    rule = F.when(by_limit, F.lit("limit")).when(F.col("b").isNotNull(), F.lit("button"))
    return joined.select("source", rule.alias("rule"), F.when(rule.isNotNull(), F.col("selector")).alias("selector"),
                         F.when(by_limit | (F.col("selector") != ""), F.lit("high")).when(F.col("b").isNotNull(), F.lit("medium")).alias("confidence"))


def bad_sample_urls(verdicts: DataFrame, results: DataFrame) -> DataFrame:
    """Addresses of rejected samples; ``verdicts`` has 1-based ``bad_samples`` per (source, field), ``results`` an ``ord``."""
    bad = verdicts.select("source", "field", F.explode("bad_samples").alias("ord"))
    return results.filter(F.col("url") != "").join(bad, ["source", "field", "ord"], "left_semi").select("source", "url").distinct()


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def choose_selector(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Per source the first candidate matching exactly one element, else the first with two to five, else the first."""
    joined = candidates.join(counts, ["source", "selector"], "left")
    rank = F.when(F.col("matches") == 1, 0).when(F.col("matches").between(1, 5), 1).otherwise(2)
    return joined.groupBy("source").agg(F.min_by("selector", F.struct(rank.alias("rank"), "ord")).alias("selector"))
