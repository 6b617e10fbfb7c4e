"""Listing drafts per market account: composing, validating, guarded writing, editing, submitting.

A product row carries ``product_id, user_id, version, brand_name, refined_name, keywords, origin, cost_price,
images_list, detail_content, standard_options, category_id, market_name, attributes`` (JSON) of one market, and the
priced columns of ``pricing.price_listings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import documents as docs
from wareloom.functions import text as tx
from wareloom.functions.text import clean_text, no_texts
from wareloom.operators import options as op

MESSAGES = (
    ("MISSING_CATEGORY", "category_id is required."), ("MISSING_TITLE", "title is required."), ("MISSING_PRIMARY_IMAGE", "primary image is required."),
    ("MISSING_SALE_PRICE", "sale price is required."), ("MISSING_ORIGIN", "origin is required."), ("MISSING_DETAIL_CONTENT", "detail content is required."),
)


def extract_common(df: DataFrame) -> DataFrame:
    """Cleaned draft inputs: category, positive cost, origin, detail, image addresses in order, usable options."""
    images = F.filter(F.transform(F.coalesce("images_list", no_texts()), lambda i: clean_text(i)), lambda i: i.isNotNull())
    return df.withColumns({
        "category_id": clean_text(F.col("category_id")), "origin": clean_text(F.col("origin")), "detail_content": clean_text(F.col("detail_content")),
        "cost_price": F.when(F.col("cost_price") > 0, F.col("cost_price")), "image_urls": images,
        "options_used": op.usable_options(F.col("standard_options"))})


def verdict(errors: Column, warnings: Column | None = None) -> Column:
    """Errors block, warnings warn, otherwise the draft is valid."""
    warned = F.size(warnings) > 0 if warnings is not None else F.lit(False)
    return F.when(F.size(errors) > 0, F.lit("blocked")).when(warned, F.lit("warning")).otherwise(F.lit("valid"))


def policy_error(df: DataFrame) -> Column:
    """Missing when there is no policy to use, invalid when there is one that cannot price the product."""
    missing = F.col("policy_json").isNull() & ~F.coalesce("policy_invalid", F.lit(False))
    return F.when(missing, F.lit("MISSING_PRICING_POLICY")).when(F.col("price_error").isNotNull(), F.lit("INVALID_PRICING_POLICY"))


def _errors(df: DataFrame, market: str) -> Column:
    prefix = market.upper()
    absent = (F.col("category_id").isNull(), F.col("title") == "", F.col("primary_image_url").isNull(), F.col("sale_price").isNull(),
              F.col("origin").isNull(), F.col("detail_content").isNull())
    entry = lambda code, message: F.struct(code.alias("code"), F.lit(f"{market.capitalize()} {message}").alias("message"))
    found = [F.when(a, entry(F.lit(f"{prefix}_{code}"), message)) for a, (code, message) in zip(absent, MESSAGES)]
    policy = policy_error(df)
    found.append(F.when(policy.isNotNull(), entry(F.concat(F.lit(f"{prefix}_"), policy), "pricing policy is missing or invalid.")))
    return F.array_compact(F.array(*found))


def _pricing() -> Column:
    shown = F.struct(F.col("policy.version").alias("policyVersion"), F.col("cost_price").alias("costPrice"), F.col("sale_price").alias("proposedSalePrice"),
                     F.col("policy.shipping").alias("shippingCost"), F.col("marketplace_fee").alias("marketplaceFee"),
                     F.col("advertising_cost").alias("advertisingCost"), F.col("other_cost").alias("otherCost"),
                     F.col("expected_profit").alias("expectedProfit"), F.col("expected_margin_rate").alias("expectedMarginRate"))
    return F.when(F.col("sale_price").isNotNull(), shown)


def _attribute_list(path: str) -> Column:
    """Stored attributes, whether kept bare or under their own key."""
    text = F.col("attributes")
    return F.when(text.startswith("["), text).otherwise(F.get_json_object(text, path))


def _variants(df: DataFrame) -> Column | None:
    """Plain option variants, where the products carry them."""
    return F.col("option_variants") if "option_variants" in df.columns else None


def _finish(df: DataFrame, market: str, payload: Column, recipe: str) -> DataFrame:
    df = df.withColumns({"generated_payload": payload, "errors": _errors(df, market)})
    df = df.withColumns({"validation_status": verdict(F.col("errors")), "adapter_version": F.lit(f"{market}-adapter:v1"), "recipe_version": F.lit(recipe)})
    keep = [c for c in ("product_id", "account_id", "user_id", "version") if c in df.columns]
    return df.select(*keep, F.lit(market).alias("market_code"), tx.null_if_empty(F.col("title")).alias("display_title"), "category_id", "sale_price",
                     "cost_price", "expected_profit", "expected_margin_rate", "primary_image_url", "generated_payload", "errors", "validation_status",
                     "adapter_version", "recipe_version")


def market_a_drafts(df: DataFrame) -> DataFrame:
    """Drafts of the first market; a stored market name wins over the composed title."""
    df = extract_common(df)
    composed = tx.compose_title(F.col("brand_name"), F.col("refined_name"), F.coalesce("keywords", no_texts()))
    df = df.withColumns({"title": F.coalesce(clean_text(F.col("market_name")), composed), "primary_image_url": F.try_element_at("image_urls", F.lit(1))})
    optional = F.transform(F.slice(F.col("image_urls"), F.lit(2), F.greatest(F.size("image_urls"), F.lit(1))), lambda u: F.struct(u.alias("url")))
    attributes = F.from_json(_attribute_list("$.naver_attributes"), "array<map<string,string>>")
    detail = F.struct(F.struct(F.col("origin").alias("rawOrigin")).alias("originAreaInfo"), op.market_a_options(F.col("options_used"), _variants(df)).alias("optionInfo"),
                      F.when(F.size(attributes) > 0, attributes).alias("productAttributes"))
    product = F.struct(
        F.col("title").alias("name"), F.col("category_id").alias("leafCategoryId"), F.col("sale_price").alias("salePrice"),
        F.struct(F.struct(F.col("primary_image_url").alias("url")).alias("representativeImage"), optional.alias("optionalImages")).alias("images"),
        F.col("detail_content").alias("detailContent"), detail.alias("detailAttribute"))
    payload = F.to_json(F.struct(product.alias("originProduct"), F.from_json("listing_defaults", "map<string,string>").alias("smartstoreChannelProduct"), _pricing().alias("pricing")))
    return _finish(df, "smartstore", payload, "smartstore-title:v2")


def market_b_drafts(df: DataFrame) -> DataFrame:
    """Drafts of the second market: one item per usable option, exposed attributes added to every item."""
    df = extract_common(df)
    composed = tx.compose_title(F.col("brand_name"), F.col("refined_name"), F.coalesce("keywords", no_texts()))
    df = df.withColumns({"title": composed, "primary_image_url": F.try_element_at("image_urls", F.lit(1))})
    pair = "array<struct<attributeTypeName:string,attributeValueName:string>>"
    stored = lambda key: F.coalesce(F.from_json(F.coalesce(F.get_json_object("attributes", f"$.{key}"), F.get_json_object("attributes", f"$.coupang_attributes.{key}")), pair), F.array().cast(pair))
    df = df.withColumns({"_product_attributes": stored("product_attributes"), "_item_attributes": stored("item_attributes")})
    made = op.market_b_items(F.col("options_used"), F.col("title"), F.col("sale_price"), F.col("image_urls"), F.col("detail_content"), F.col("origin"), _variants(df))
    items = F.transform(made, lambda i: i.withField("attributes", F.concat(i["attributes"], F.col("_item_attributes"))))
    payload = F.to_json(F.struct(
        F.col("category_id").alias("displayCategoryCode"), F.col("title").alias("displayProductName"), F.col("title").alias("sellerProductName"), items.alias("items"),
        F.from_json("listing_defaults", "map<string,string>").alias("coupangProduct"), _pricing().alias("pricing"),
        F.when(F.size("_product_attributes") > 0, F.col("_product_attributes")).alias("attributes")))
    return _finish(df, "coupang", payload, "coupang-title:v1")


def draft_targets(products: DataFrame, accounts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Products with the connected, supported accounts of their owner, less pairs that are being submitted."""
    ready = accounts.filter((F.col("connection_status") == "connected") & F.col("market_code").isin(*K.SUPPORTED_MARKETS))
    busy = drafts.filter((F.col("status") == K.SUBMITTING) & (F.col("draft_kind") == "create")).select("product_id", "account_id")
    return products.join(ready, "user_id").join(busy, ["product_id", "account_id"], "left_anti")


def upsert_drafts(drafts: DataFrame, results: DataFrame) -> DataFrame:
    """Next drafts: a changeable active draft takes a result of a newer version, a missing one is inserted, the rest stays.

    ``action`` tells which. A person's override patch survives an update. Versions compare as values of their type.
    """
    keys = ["product_id", "account_id", "draft_kind"]
    active = F.col("status").isin(*K.ACTIVE_DRAFT_STATUSES)
    fresh = results.withColumn("draft_kind", F.lit("create"))
    values = [c for c in fresh.columns if c in drafts.columns and c not in keys and c not in ("status", "draft_id")]
    incoming = fresh.select(*keys, F.struct(*values).alias("n"))
    open_drafts, closed = drafts.filter(active), drafts.filter(~active)
    joined = open_drafts.withColumn("_stored", F.lit(True)).join(incoming, keys, "full_outer")
    newer = F.col("_stored") & F.col("n").isNotNull() & F.col("status").isin(*K.MUTABLE_DRAFT_STATUSES) & (F.col("version") < F.col("n.version"))
    action = F.when(F.col("_stored").isNull(), F.lit("insert")).when(newer, F.lit("update")).otherwise(F.lit("keep"))
    joined = joined.withColumn("action", action)
    takes = F.col("action") != "keep"
    cells = {c: F.when(takes, F.col(f"n.{c}")).otherwise(F.col(c)) for c in values}
    cells["status"] = F.when(takes, F.lit("needs_review")).otherwise(F.col("status"))
    out = joined.select(*keys, *[v.alias(c) for c, v in cells.items()], *[c for c in drafts.columns if c not in keys and c not in cells], "action")
    return out.unionByName(closed.withColumn("action", F.lit("keep")), allowMissingColumns=True)


def job_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after their run: completed, or failed with type and message; the generated version stays known either way."""
    joined = jobs.join(outcomes.select("job_id", F.struct("generated_version", "error_type", "error_message").alias("o")), "job_id", "left")
    failed = F.col("o.error_type").isNotNull()
    return joined.withColumns({
        "status": F.when(F.col("o").isNull(), F.col("status")).when(failed, F.lit("failed")).otherwise(F.lit("completed")),
        "generated_version": F.coalesce("o.generated_version", "generated_version"),
        "error": F.when(failed, F.to_json(F.struct(F.col("o.error_type").alias("type"), F.col("o.error_message").alias("message"))))}).drop("o")


def edit_drafts(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply requested statuses; ``verdict`` is ok, unsupported_status or blocked, and only ok edits take effect."""
    joined = drafts.join(edits.select("draft_id", F.col("status").alias("wanted")), "draft_id", "left")
    wanted = F.col("wanted")
    verdict = (F.when(~wanted.isin(*K.MUTABLE_DRAFT_STATUSES), F.lit("unsupported_status"))
               .when((wanted == "ready") & (F.col("validation_status") == "blocked"), F.lit("blocked")).when(wanted.isNotNull(), F.lit("ok")))
    return joined.withColumn("verdict", verdict).withColumn("status", F.when(F.col("verdict") == "ok", wanted).otherwise(F.col("status"))).drop("wanted")


def submission_gate(drafts: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request why it cannot go through: a draft not found in the account, blocked, or in a wrong status; null if it can.

    ``requests``: ``job_id, account_id, draft_id`` rows.
    """
    asked = requests.dropDuplicates(["job_id", "draft_id"])
    found = asked.join(drafts.select("draft_id", "account_id", "status", "validation_status"), ["draft_id", "account_id"], "left")
    facts = found.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("draft_count"), F.count_if(F.col("status").isNull()).alias("absent"), F.count_if(F.col("validation_status") == "blocked").alias("blocked"),
        F.count_if(~F.col("status").isin(*K.SUBMITTABLE_DRAFT_STATUSES)).alias("wrong"))
    reason = (F.when(F.col("absent") > 0, F.lit("drafts not found")).when(F.col("blocked") > 0, F.lit("blocked drafts")).when(F.col("wrong") > 0, F.lit("draft status")))
    return facts.select("job_id", "draft_count", reason.alias("refused"))


def submission_attempts(drafts: DataFrame, requests: DataFrame) -> DataFrame:
    """First attempts of all accepted requests, with the payload after the override patch."""
    accepted = submission_gate(drafts, requests).filter("refused IS NULL").select("job_id")
    asked = requests.dropDuplicates(["job_id", "draft_id"]).join(accepted, "job_id", "left_semi")
    rows = asked.join(drafts, ["draft_id", "account_id"])
    return rows.select("job_id", "draft_id", F.lit("queued").alias("status"), F.lit(1).alias("attempt_number"),
                       docs.json_merge(F.col("generated_payload"), F.col("override_patch")).alias("submitted_payload"))


def mark_submitting(drafts: DataFrame, attempts: DataFrame) -> DataFrame:
    hit = attempts.select("draft_id").distinct().withColumn("_hit", F.lit(True))
    joined = drafts.join(hit, "draft_id", "left")
    return joined.withColumn("status", F.when(F.col("_hit"), F.lit(K.SUBMITTING)).otherwise(F.col("status"))).drop("_hit")
