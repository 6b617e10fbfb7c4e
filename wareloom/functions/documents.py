"""JSON document columns: warnings, structured data fallbacks, deep merge."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.functions.numbers import first_number
from wareloom.functions.text import clean_text, is_blank, let, no_texts

def _as_list(doc: Column, path: str) -> Column:
    """Entry of a parsed document as a list of JSON texts; a single value becomes a list of one."""
    def listed(item):
        text = F.to_json(item)
        filled = text.isNotNull() & ~text.isin("null", "[]", "{}", '""', "0", "false")
        many = F.transform(item.cast("array<variant>"), lambda x: F.to_json(x))
        return F.when(filled, F.when(F.schema_of_variant(item).startswith("ARRAY"), many).otherwise(F.array(text)))

    return F.coalesce(let(F.try_variant_get(doc, path, "variant"), listed), no_texts())


def merge_warnings(existing: Column, added: Column) -> Column:
    """Supplier warnings, earlier processing warnings and new ones in one document; null when there are none.

    ``existing`` is JSON (an object, or a bare list from older rows), ``added`` an array of JSON texts.
    """
    def part(name, items):
        return F.when(F.size(items) > 0, F.concat(F.lit(f'"{name}":['), F.array_join(items, ","), F.lit("]")))

    def split(doc):
        bare = ~F.coalesce(F.schema_of_variant(doc), F.lit("OBJECT")).startswith("OBJECT")
        named = _as_list(doc, "$.supplier_warnings")
        supplier = F.when(bare, _as_list(doc, "$")).when(F.size(named) > 0, named).otherwise(_as_list(doc, "$.warnings"))
        earlier = F.when(bare, no_texts()).otherwise(_as_list(doc, "$.processing_warnings"))
        return F.struct(supplier.alias("supplier"), F.concat(earlier, F.coalesce(added, no_texts())).alias("processing"))

    def merged(w):
        total = F.concat(w["supplier"], w["processing"])
        body = F.concat_ws(",", part("warnings", total), part("supplier_warnings", w["supplier"]),
                           part("processing_warnings", w["processing"]))
        return F.when(F.size(total) > 0, F.concat(F.lit("{"), body, F.lit("}")))

    return let(let(F.try_parse_json(existing), split), merged)


def fill_from_structured(name: Column, image: Column, price: Column, data: Column) -> Column:
    """Fill missing name, image and price from page metadata (``struct<og_title, og_image, og_price, ld_*>``)."""
    filled_name = F.when(is_blank(name), F.coalesce(clean_text(data["og_title"]), clean_text(data["ld_name"]), name)).otherwise(name)
    filled_image = F.when(is_blank(image), F.coalesce(clean_text(data["og_image"]), clean_text(data["ld_image"]), image)).otherwise(image)
    filled_price = F.coalesce(price.cast("bigint"), first_number(data["ld_price"]), first_number(data["og_price"]))
    return F.struct(filled_name.alias("name"), filled_image.alias("image"), filled_price.alias("price"))


def _merged(base, patch):
    out = dict(base)
    for key, value in patch.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = _merged(out[key], value) if both else value
    return out


_NUMBER = "\ue000number\ue001"  # private-use characters: marks a number's own digits while a document is taken apart
_NUMBER_TEXT = re.compile(f'"{_NUMBER}([^"]*)"')
_MERGED = T.StructType([T.StructField("document", T.StringType()), T.StructField("error", T.StringType())])


def _parse(text):
    keep = lambda digits: _NUMBER + digits
    return json.loads(text, parse_float=keep, parse_int=keep)


@F.pandas_udf(_MERGED)
def json_merge_checked(base: pd.Series, patch: pd.Series) -> pd.DataFrame:
    """``struct<document, error>``: a patch laid over a JSON object; objects merge, anything else (null too) replaces.

    Numbers keep their digits. A text that is no JSON, or a base that is no object, gives no document but an error.
    Free-form documents have no fixed schema, so this is an Arrow batch function.
    """
    def one(doc, over):
        try:
            doc = _parse(doc) if doc else {}
            over = _parse(over) if over else None
            if not isinstance(doc, dict):
                return None, "document is not an object"
            merged = _merged(doc, over) if isinstance(over, dict) else doc
            return _NUMBER_TEXT.sub(r"\1", json.dumps(merged, ensure_ascii=False, separators=(",", ":"))), None
        except (ValueError, RecursionError) as problem:
            return None, f"unreadable JSON: {problem}"
    return pd.DataFrame([one(b, p) for b, p in zip(base, patch)], columns=["document", "error"])


def json_merge(base: Column, patch: Column) -> Column:
    """The merged document; null where base or patch cannot be read, see :func:`json_merge_checked`."""
    return json_merge_checked(base, patch)["document"]
