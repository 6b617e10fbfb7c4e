"""Product options: pairing names with prices, standard option rows, market option payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import numbers as num
from wareloom.functions import option_text as ot
from wareloom.functions import status as st
from wareloom.functions import text as tx
from wareloom.functions.text import clean_text, let, null_if_empty, strip

STANDARD_OPTION = (
    "struct<supplier_product_code:string,option_sku:string,option_type:string,option_group_1:string,"
    "option_value_1:string,option_group_2:string,option_value_2:string,option_group_3:string,option_value_3:string,"
    "option_display_name:string,option_supply_price:bigint,option_sale_price:bigint,option_price_delta:bigint,"
    "option_stock_quantity:int,option_status:string,option_main_image_url:string,"
    "option_extra_image_urls:array<string>,option_position:int,option_usable:boolean,raw_option_text:string,"
    "raw_option_metadata:string>"
)
VARIANTS = "array<struct<name:string,price_wholesale:bigint,position:int>>"
OPTION_WARNINGS = "array<struct<code:string,field:string,message:string,raw_value:string,option_count:int,price_count:int>>"


def price_tokens(names: Column, prices: Column) -> Column:
    """Price list tokens; plain comma splitting only when that alone gives one price per name."""
    return let(F.struct(tx.split_prices(prices).alias("smart"), tx.split_csv(prices).alias("plain")), lambda t: F.when(
        (F.size(t["smart"]) != F.size(names)) & (F.size(t["plain"]) == F.size(names)), t["plain"]).otherwise(t["smart"]))


def pair_variants(df: DataFrame, names: str, prices: str, deltas: str | None = None) -> DataFrame:
    """Add ``price_wholesale``, ``option_variants`` and ``option_warnings`` from option names and prices.

    Differences, when given, are added to the row price; otherwise the price list is split. One price serves all
    names. A count mismatch or an unreadable price leaves no variants and one warning.
    """
    row_price = num.int_price(F.col(prices)).cast("bigint")
    delta_text = F.col(deltas) if deltas else F.lit(None).cast("string")
    df = df.withColumns({"_names": tx.split_csv(F.col(names)), "_row_price": row_price, "_deltas": tx.split_csv(delta_text)})
    has_names = F.size("_names") > 0
    by_delta = has_names & (F.size("_deltas") > 0)
    tokens = (F.when(by_delta, F.col("_deltas")).when(has_names, price_tokens(F.col("_names"), F.col(prices)))
              .otherwise(tx.no_texts()))
    df = df.withColumns({"_tokens": tokens, "_by_delta": by_delta})
    parsed = F.when(F.col("_by_delta"), F.transform("_tokens", lambda t: F.col("_row_price") + num.signed_int(t))).otherwise(
        F.transform("_tokens", lambda t: num.int_price(t).cast("bigint")))
    df = df.withColumn("_parsed", parsed)
    single = ~F.col("_by_delta") & (F.size("_parsed") == 1) & F.try_element_at("_parsed", F.lit(1)).isNotNull()
    df = df.withColumn("_amounts", F.when(single, F.array_repeat(F.try_element_at("_parsed", F.lit(1)), F.size("_names")))
                       .otherwise(F.col("_parsed")))
    price = F.when(~F.col("_by_delta") & (F.size("_amounts") > 0), F.try_element_at("_amounts", F.lit(1))).otherwise(F.col("_row_price"))
    counts_differ = (F.size("_names") > 0) & (F.size("_names") != F.size("_amounts"))
    unreadable = F.when(F.size("_names") > 0, F.exists("_amounts", lambda a: a.isNull())).otherwise(
        clean_text(F.col(prices)).isNotNull() & F.col("_row_price").isNull())
    none = F.lit(None)
    count_warning = F.struct(
        none.alias("code"), F.lit("option_variants").alias("field"), F.lit("Option count and price count differ.").alias("message"),
        none.alias("raw_value"), F.size("_names").alias("option_count"), F.size("_amounts").alias("price_count"))
    price_warning = F.struct(
        none.alias("code"), F.lit("price_wholesale_raw").alias("field"),
        F.lit("One or more option prices could not be parsed.").alias("message"),
        F.coalesce(clean_text(F.col(prices)), F.lit("")).alias("raw_value"), none.alias("option_count"), none.alias("price_count"))
    warnings = (F.when(counts_differ, F.array(count_warning).cast(OPTION_WARNINGS))
                .when(unreadable, F.array(price_warning).cast(OPTION_WARNINGS)).otherwise(F.array().cast(OPTION_WARNINGS)))
    paired = F.transform("_names", lambda n, i: F.struct(
        n.alias("name"), F.get(F.col("_amounts"), i).alias("price_wholesale"), (i + 1).alias("position"))).cast(VARIANTS)
    df = df.withColumns({"price_wholesale": price, "option_warnings": warnings})
    df = df.withColumn("option_variants", F.when((F.size("option_warnings") == 0) & (F.size("_names") > 0), paired)
                       .otherwise(F.array().cast(VARIANTS)))
    return df.drop("_names", "_row_price", "_deltas", "_tokens", "_by_delta", "_parsed", "_amounts")


def standard_options(df: DataFrame, *, code: str, status: str, names: str, prices: str, images: str,
                     skus: str | None = None, deltas: str | None = None, suppress: str | None = None) -> DataFrame:
    """Add ``standard_options``: one record per option name of a row that has gone through ``pair_variants``."""
    maybe = lambda c: F.col(c) if c else F.lit(None).cast("string")
    df = df.withColumns({
        "_n": tx.split_csv(F.col(names)), "_i": tx.split_csv(F.col(images)), "_s": tx.split_csv(maybe(skus)),
        "_code": F.coalesce(clean_text(F.col(code)), F.lit("")), "_status": F.coalesce(clean_text(F.col(status)), F.lit("")),
        "_meta": F.to_json(F.struct(
            clean_text(F.col(names)).alias("option_values_raw"), clean_text(F.col(prices)).alias("price_wholesale_raw"),
            clean_text(F.col(images)).alias("option_image_urls_raw"),
            clean_text(maybe(deltas)).alias("option_price_deltas_raw"), clean_text(maybe(skus)).alias("option_skus_raw"))),
    })
    listed = F.transform(price_tokens(F.col("_n"), F.col(prices)), lambda t: num.int_price(t).cast("bigint"))
    df = df.withColumn("_p", F.when(F.size("option_variants") > 0, F.transform("option_variants", lambda v: v["price_wholesale"])).otherwise(listed))

    def option(name, i):
        supply = F.get(F.col("_p"), i)
        return standard_option(
            code=F.col("_code"), sku=F.coalesce(F.get(F.col("_s"), i), F.concat_ws("-", "_code", (i + 1).cast("string"))),
            groups=[F.lit(K.OPTION_GROUP_NAME)], values=[name], supply=supply, delta=supply - F.col("price_wholesale"),
            status=null_if_empty(F.col("_status")), usable=st.is_available(F.col("_status")), image=F.get(F.col("_i"), i),
            position=i + 1, raw_text=name, metadata=F.col("_meta"))

    made = F.transform("_n", option)
    hidden = F.col(suppress) if suppress else F.lit(False)
    df = df.withColumn("standard_options", F.when(hidden, F.array().cast(f"array<{STANDARD_OPTION}>")).otherwise(made))
    return df.drop("_n", "_i", "_s", "_code", "_status", "_meta", "_p")


def standard_option(*, code, sku, groups, values, supply, delta, status, usable, image, position, raw_text, metadata,
                    stock=None, kind="combination") -> Column:
    """One option record."""
    none = F.lit(None).cast("string")
    pad = lambda items: (list(items) + [none] * 3)[:3]
    g, v = pad(groups), pad(values)
    return F.struct(
        code.alias("supplier_product_code"), sku.alias("option_sku"), F.lit(kind).alias("option_type"),
        g[0].alias("option_group_1"), v[0].alias("option_value_1"), g[1].alias("option_group_2"), v[1].alias("option_value_2"),
        g[2].alias("option_group_3"), v[2].alias("option_value_3"), tx.option_display_name(*v).alias("option_display_name"),
        supply.cast("bigint").alias("option_supply_price"), F.lit(None).cast("bigint").alias("option_sale_price"),
        delta.cast("bigint").alias("option_price_delta"),
        (F.lit(None) if stock is None else stock).cast("int").alias("option_stock_quantity"), status.alias("option_status"),
        image.alias("option_main_image_url"), tx.no_texts().alias("option_extra_image_urls"),
        position.cast("int").alias("option_position"), usable.alias("option_usable"), raw_text.alias("raw_option_text"),
        metadata.alias("raw_option_metadata"))


def aligned_price(prices: Column, total: Column, raw_index: Column, accepted_index: Column) -> Column:
    """Price of one option: by raw position when every element has a price, else by accepted position (both from 0)."""
    index = F.when(F.size(prices) == total, raw_index).otherwise(accepted_index)
    return F.get(prices, index)


def inline_options(options: DataFrame) -> DataFrame:
    """Per product three aligned comma lists (names, prices, images) in position order; nameless options are skipped.

    The result is one text cell per product, as the ledger format wants it.
    """
    name = F.coalesce(null_if_empty(F.col("option_display_name")), null_if_empty(F.col("option_value_1")))
    rows = options.withColumn("name", name).filter(F.col("name").isNotNull()).select("product_id", F.struct(
        "option_position", "name", F.coalesce(F.col("option_supply_price").cast("string"), F.lit("")).alias("price"),
        F.coalesce("option_main_image_url", F.lit("")).alias("image")).alias("o"))
    grouped = rows.groupBy("product_id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    csv = lambda part: F.array_join(F.transform("o", lambda o: o[part]), ",")
    return grouped.select("product_id", csv("name").alias("names"), csv("price").alias("prices"), csv("image").alias("images"))


def flat_options(texts: Column, code: Column, base: Column, group: str, *, parser: dict | None = None,
                 prices: Column | None = None, disabled: Column | None = None, classes: Column | None = None) -> Column:
    """Option records of one page's option texts, in order, placeholders left out.

    ``prices`` is a declared price list over all elements; without one the price mark inside the text counts.
    ``disabled`` and ``classes`` are arrays parallel to ``texts``.
    """
    parsed = F.transform(texts, lambda x, i: F.struct(
        i.alias("raw_index"), x.alias("text"), ot.parse_option(x, base, parser).alias("p")))

    def record(o, i):
        listed = aligned_price(prices, F.size(texts), o["raw_index"], i) if prices is not None else F.lit(None).cast("bigint")
        use_list = F.size(prices) > 0 if prices is not None else F.lit(False)
        supply = F.when(use_list, listed).otherwise(o["p"]["supply"])
        delta = F.when(use_list, listed - base).otherwise(o["p"]["delta"])
        sold = st.is_sold_out_text(o["text"])
        if disabled is not None:
            sold = sold | F.coalesce(F.get(disabled, o["raw_index"]), F.lit(False))
        if classes is not None:
            sold = sold | F.coalesce(F.lower(F.get(classes, o["raw_index"])).rlike("soldout|sold_out|품절"), F.lit(False))
        return standard_option(
            code=code, sku=F.when(code != "", F.concat(code, F.lit("-"), (i + 1).cast("string"))), groups=[F.lit(group)],
            values=[o["p"]["value"]], supply=supply, delta=delta, status=F.when(sold, F.lit("sold_out")), usable=~sold,
            image=F.lit(None).cast("string"), position=i + 1, raw_text=o["text"],
            metadata=F.to_json(F.struct(F.lit(group).alias("group"), o["p"]["value"].alias("value"))))

    return F.transform(F.filter(parsed, lambda o: o["p"]["value"].isNotNull()), record)


def combined_options(levels: Column, code: Column, base: Column, group_1: str, group_2: str) -> Column:
    """Option records for two dependent levels: ``levels`` is ``array<struct<value, children array<string>>>`` in page order.

    Placeholders drop out on both levels; position and sku run over all combinations.
    """
    real = lambda v: (strip(v) != "") & ~ot.is_placeholder(v)
    pairs = F.flatten(F.transform(F.filter(levels, lambda l: real(l["value"])), lambda l: F.transform(
        F.filter(l["children"], real), lambda c: F.struct(strip(l["value"]).alias("a"), strip(c).alias("b")))))

    def record(p, i):
        sold = st.is_sold_out_text(p["b"])
        return standard_option(
            code=code, sku=F.when(code != "", F.concat(code, F.lit("-"), (i + 1).cast("string"))),
            groups=[F.lit(group_1), F.lit(group_2)], values=[p["a"], p["b"]], supply=base, delta=base - base,
            status=F.when(sold, F.lit("sold_out")), usable=~sold, image=F.lit(None).cast("string"), position=i + 1,
            raw_text=F.concat_ws(" / ", p["a"], p["b"]),
            metadata=F.to_json(F.struct(p["a"].alias("level1"), p["b"].alias("level2"))))

    return F.transform(pairs, record)


def _level(o: Column, i: int) -> Column:
    group, value = clean_text(o[f"option_group_{i}"]), clean_text(o[f"option_value_{i}"])
    return F.when(group.isNotNull() & value.isNotNull(), F.struct(group.alias("group"), value.alias("value")))


def option_levels(o: Column) -> Column:
    """Filled (group, value) pairs of one option, in order."""
    return F.array_compact(F.array(_level(o, 1), _level(o, 2), _level(o, 3)))


def usable_options(options: Column) -> Column:
    return F.filter(F.coalesce(options, F.array().cast(f"array<{STANDARD_OPTION}>")), lambda o: F.coalesce(o["option_usable"], F.lit(True)))


COMBINATION = ("struct<optionName1:string,optionName2:string,optionName3:string,stockQuantity:int,price:bigint,usable:boolean,"
               "sellerManagerCode:string,name:string,price_wholesale:bigint,position:int>")


def market_a_options(options: Column, variants: Column | None = None) -> Column:
    """``struct<optionCombinationGroupNames, optionCombinations>``: group names in order of first use, one record per option.

    Without standard options the plain variants (name, price, position) are passed on as they are.
    """
    groups = F.array_distinct(F.flatten(F.transform(options, lambda o: F.transform(option_levels(o), lambda l: l["group"]))))
    none = F.lit(None)
    combos = F.transform(options, lambda o: F.struct(
        clean_text(o["option_value_1"]).alias("optionName1"), clean_text(o["option_value_2"]).alias("optionName2"),
        clean_text(o["option_value_3"]).alias("optionName3"), o["option_stock_quantity"].alias("stockQuantity"),
        o["option_price_delta"].alias("price"), F.coalesce(o["option_usable"], F.lit(True)).alias("usable"),
        clean_text(o["option_sku"]).alias("sellerManagerCode"), none.alias("name"), none.alias("price_wholesale"),
        none.alias("position"))).cast(f"array<{COMBINATION}>")
    if variants is not None:
        plain = F.transform(F.coalesce(variants, F.array().cast(VARIANTS)), lambda v: F.struct(
            *[none.alias(n) for n in ("optionName1", "optionName2", "optionName3", "stockQuantity", "price", "usable", "sellerManagerCode")],
            v["name"].alias("name"), v["price_wholesale"].alias("price_wholesale"), v["position"].alias("position"))).cast(f"array<{COMBINATION}>")
        combos = F.when(F.size(options) > 0, combos).otherwise(plain)
    return F.struct(F.when(F.size(groups) > 0, groups).alias("optionCombinationGroupNames"), combos.alias("optionCombinations"))


def _image(kind: str, path: Column, order: Column) -> Column:
    return F.struct(F.lit(kind).alias("imageType"), path.alias("vendorPath"), order.cast("int").alias("imageOrder"))


def market_b_images(urls: Column) -> Column:
    """First image represents the product, the others show details."""
    return F.transform(urls, lambda u, i: F.when(i == 0, _image("REPRESENTATION", u, i)).otherwise(_image("DETAIL", u, i)))


def market_b_items(options: Column, title: Column, sale_price: Column, images: Column, content: Column, origin: Column,
                   variants: Column | None = None) -> Column:
    """One item per usable option, else one per plain variant; a product without either gives one item named by its title."""
    contents = F.array(F.struct(F.lit("HTML").alias("contentsType"), F.array(F.struct(
        F.lit("TEXT").alias("detailType"), content.alias("content"))).alias("contentDetails")))
    attribute = "array<struct<attributeTypeName:string,attributeValueName:string>>"

    def own_images(o):
        main = clean_text(o["option_main_image_url"])
        head = F.array_compact(F.array(F.when(main.isNotNull(), _image("REPRESENTATION", main, F.lit(0)))))
        shift = F.when(main.isNotNull(), 1).otherwise(0)
        tail = F.filter(F.transform(F.coalesce(o["option_extra_image_urls"], tx.no_texts()), lambda u, i: F.when(
            clean_text(u).isNotNull(), _image("DETAIL", clean_text(u), i + shift))), lambda x: x.isNotNull())
        return F.concat(head, tail)

    def item(o):
        name = F.coalesce(clean_text(o["option_display_name"]), clean_text(o["option_sku"]), title)
        price = F.when(o["option_sale_price"] > 0, o["option_sale_price"]).otherwise(sale_price.cast("bigint"))
        pictures = let(own_images(o), lambda own: F.when(F.size(own) > 0, own).otherwise(market_b_images(images)))
        attributes = F.transform(option_levels(o), lambda l: F.struct(
            l["group"].alias("attributeTypeName"), l["value"].alias("attributeValueName"))).cast(attribute)
        return _item(name, price, pictures, attributes, contents, origin, clean_text(o["option_sku"]), o["option_stock_quantity"])

    def bare(name, attributes):
        none = F.lit(None)
        return _item(name, sale_price.cast("bigint"), market_b_images(images), attributes.cast(attribute), contents, origin, none.cast("string"), none.cast("int"))

    def variant(v):
        name = F.coalesce(clean_text(v["name"]), title)
        return bare(name, F.array(F.struct(F.lit(K.OPTION_GROUP_NAME).alias("attributeTypeName"), name.alias("attributeValueName"))))

    single = F.array(bare(title, F.array()))
    if variants is not None:
        single = F.when(F.size(variants) > 0, F.transform(variants, variant)).otherwise(single)
    return F.when(F.size(options) > 0, F.transform(options, item)).otherwise(single)


def _item(name, price, images, attributes, contents, origin, sku, stock) -> Column:
    return F.struct(
        name.alias("itemName"), price.alias("salePrice"), images.alias("images"), attributes.alias("attributes"),
        contents.alias("contents"), origin.alias("origin"), sku.alias("externalVendorSku"), stock.alias("maximumBuyCount"))
