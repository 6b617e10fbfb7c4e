"""Column-mapping queries over supplier sheets in three header layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.text import quoted
from wareloom.operators import mapping as mp
from wareloom.plans.registry import query
from wareloom.session import stored_once
from wareloom.plans.scalars import INT_PRICE_SQL, case_map

# Header of each cell column per layout; None where the sheet lacks the column.
CELLS = ("c_status", "c_pid", "c_code", "c_name", "c_opts", "c_price", "c_retail", "c_min", "c_origin", "c_img1", "c_img2", "c_detail", "c_date")
LAYOUTS = {
    0: ("상태", "제품번호", "상품코드", "상품명", "옵션값", "가격", "소비자가", "판매준수가", "원산지", "목록이미지1", "목록이미지2", "상세이미지", "등록일"),
    1: ("Status", "ItemNo", "Code", "Title", "Options", "Cost", "Retail", "Min", None, "Pic1", "Pic2", "Detail", "Reg"),
    2: ("품절상태", "제품ID", "도매코드", "제품명", "선택", "단가", "소매가", "최저가", "제조국", "사진", "목록이미지2", None, "상품등록일"),
}
# Mapping rules per layout: field, source, default, pattern, regex_group, regex_all, join_with, value_map, plain.
RULES = {
    0: [("mystery", "상태", None, None, None, None, None, None, True),
        ("origin", None, None, r"(a+)+", None, None, None, None, False)],
    1: [("wholesale_status", "Status", "판매중", None, None, None, None, {"on": "판매중", "off": "품절"}, False),
        ("wholesale_product_id", "ItemNo", None, None, None, None, None, None, True),
        ("product_code", "Code", None, r"code=(\w+)", None, None, None, None, False),
        ("original_name", "Title", None, r"^(?P<words>[a-z ]+[a-z])", "words", None, None, None, False),
        ("option_values_raw", "Options", None, r"\(([^)]*)\)", None, True, ",", None, False),
        ("price_wholesale_raw", "Cost", None, None, None, None, None, None, True),
        ("price_retail", "Retail", None, None, None, None, None, None, True),
        ("price_min_selling", "Min", None, None, None, None, None, None, True),
        ("origin", None, "Korea", None, None, None, None, None, False),
        ("image_list_1", "Pic1", None, None, None, None, None, None, True),
        ("image_list_2", "Pic2", None, None, None, None, None, None, True),
        ("image_detail", "Detail", None, None, None, None, None, None, True),
        ("wholesale_registered_at", "Reg", None, None, None, None, None, None, True),
        ("image_list_3", "Nowhere", None, None, None, None, None, None, True),
        ("image_list_4", "Pic2", None, r"(x)\1", None, None, None, None, False),
        ("image_list_5", "Pic2", None, r"(x", None, None, None, None, False)],
    2: [("price_wholesale", "단가", None, None, None, None, None, None, True),
        ("options", "선택", None, None, None, None, None, None, True),
        ("images_list", "사진", None, None, None, None, None, None, True),
        ("option_skus_raw", "선택", None, r"(a)(b)", "5", None, None, None, False)],
}


def by_layout(values):
    """A column picking one of three values by the sheet's layout."""
    column = F
    for layout, value in values.items():
        column = column.when(F.col("layout") == layout, value)
    return column


def _text(v):
    return F.lit(v).cast("string")


def _rule(r):
    field, source, default, pattern, group, every, join, values, plain = r
    table = f"map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in values.items())})" if values else "CAST(NULL AS map<string,string>)"
    texts = {"field": field, "source": source, "default": default, "pattern": pattern, "regex_group": group, "join_with": join}
    cells = [f"'{n}', CAST({quoted(v)} AS STRING)" for n, v in texts.items()]
    cells += [f"'regex_all', CAST({'NULL' if every is None else every} AS BOOLEAN)", f"'value_map', {table}", f"'plain', {plain}"]
    return f"named_struct({', '.join(cells)})"


def sheets(t):
    """(ledger, rules, headers) of all suppliers."""
    rows = t.sheet_rows
    raw = {n: F.create_map(*[x for h, c in zip(heads, CELLS) if h for x in (F.lit(h), F.col(c))]) for n, heads in LAYOUTS.items()}
    ledger = rows.select("site", "row_no", by_layout(raw).alias("raw"))
    sites = stored_once(rows.select("site", "layout").distinct().coalesce(1))  # one row per supplier; read for rules and headers
    heads = {n: F.array(*[F.lit(h) for h in hs if h]) for n, hs in LAYOUTS.items()}
    rules = {n: F.expr(f"array({', '.join(_rule(r) for r in rs)})") for n, rs in RULES.items()}
    headers = sites.select("site", F.explode(by_layout(heads)).alias("header"))
    return ledger, sites.select("site", F.explode(by_layout(rules)).alias("r")).select("site", "r.*"), headers


def _q(v):
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


HEADERS_SQL = "(VALUES " + ", ".join(f"({n}, {_q(h)})" for n, hs in LAYOUTS.items() for h in hs if h) + ") h(layout, header)"
_LEGACY = {old: new for new, old in K.LEGACY_KEYS.items()}
_KEPT = {n: [r for r in rs if r[0] in K.TARGET_FIELDS + tuple(_LEGACY)] for n, rs in RULES.items()}
CANDIDATES_SQL = "(VALUES " + ", ".join(
    [f"({n}, {_q(_LEGACY.get(r[0], r[0]))}, {_q(r[1])}, {1 if r[0] in _LEGACY else 0})" for n, rs in _KEPT.items() for r in rs if r[1]]
    + [f"({n}, {_q(f)}, {_q(h)}, {i + 2})" for n in LAYOUTS for f, hs in K.HEADER_FALLBACKS.items() for i, h in enumerate(hs)]
) + ") c(layout, field, header, rank)"
RESOLVED_SQL = f"""SELECT layout, field, arg_min(header, rank) AS header FROM {CANDIDATES_SQL} JOIN {HEADERS_SQL} USING (layout, header)
  WHERE NOT (layout = 1 AND field = 'origin') GROUP BY layout, field"""


@query("MAP1", f"""
WITH s AS (SELECT DISTINCT site, layout FROM sheet_rows), r AS ({RESOLVED_SQL})
SELECT site, field, header FROM s JOIN r USING (layout)""")
def map1(t):
    _, rules, headers = sheets(t)
    return mp.resolve_headers(rules, headers)


@query("MAP2", f"""
WITH s AS (SELECT DISTINCT site, layout FROM sheet_rows), r AS ({RESOLVED_SQL}),
  q AS (SELECT * FROM (VALUES {", ".join(f"('{f}')" for f in K.REQUIRED_FIELDS)}) v(field))
SELECT site, field FROM s CROSS JOIN q WHERE NOT (layout = 1 AND field IN ('origin', 'wholesale_status'))
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.layout = s.layout AND r.field = q.field)""")
def map2(t):
    _, rules, headers = sheets(t)
    return mp.missing_required(rules, headers)


def _verdict(n, r):
    """Expected verdict of one declared rule, from the rule's own bounds."""
    field, source, default, pattern = r[:4]
    notes = []
    if field not in K.TARGET_FIELDS + tuple(_LEGACY):
        return False, f"Ignored unknown target field: {field}"
    present = source in LAYOUTS[n]
    if source and not present:
        notes.append(f"Ignored missing source header for {field}: {source}")
    reason = {r"(a+)+": "invalid or oversized regex", r"(x)\1": "invalid or oversized regex", r"(x": "invalid regex"}.get(pattern)
    if r[4] == "5":
        reason = "invalid regex_group"
    if reason:
        notes.append(f"Ignored {reason} for {field}.")
    return not reason and (present or default is not None), "; ".join(notes)


VERDICTS_SQL = "(VALUES " + ", ".join(
    f"({n}, {_q(r[0])}, {_q(r[3])}, {_verdict(n, r)[0]}, {_q(_verdict(n, r)[1])})" for n, rs in RULES.items() for r in rs) + ") v(layout, field, pattern, kept, notes)"


@query("MAP3", f"""
WITH s AS (SELECT DISTINCT site, layout FROM sheet_rows)
SELECT site, field, kept, notes, replace(pattern, '(?P<', '(?<') AS pattern FROM s JOIN {VERDICTS_SQL} USING (layout)""")
def map3(t):
    _, rules, headers = sheets(t)
    return mp.sanitize_rules(rules, headers).select("site", "field", "kept", F.array_join("warnings", "; ").alias("notes"), "pattern")


@query("MAP4", """
SELECT doc_id, nullif(trim(regexp_extract(text, '([A-Za-z]+)ing')), '') AS first_match,
  nullif(array_to_string(list_filter(list_transform(regexp_extract_all(text, '([A-Za-z]+)ing', 1), lambda m: trim(m)), lambda m: m <> ''), '/'), '') AS all_matches,
  CASE lang WHEN 'en' THEN 'English' ELSE lang END AS mapped, coalesce(CASE WHEN lang = 'en' THEN NULL ELSE source END, 'none') AS filled
FROM documents""")
def map4(t):
    def rule(default=None, pattern=None, group=None, every=None, join=None, values=None):
        table = F.create_map(*[F.lit(x) for x in values]) if values else F.lit(None).cast("map<string,string>")
        return F.struct(F.lit(None).cast("string").alias("source"), _text(default).alias("default"), _text(pattern).alias("pattern"),
                        F.lit(group).cast("int").alias("regex_group"), F.lit(every).cast("boolean").alias("regex_all"), _text(join).alias("join_with"), table.alias("value_map"))
    blanked = F.when(F.col("lang") == "en", F.lit("  ")).otherwise(F.col("source"))
    return t.documents.select(
        "doc_id", mp.apply_rule(F.col("text"), rule(pattern="([A-Za-z]+)ing", group=0)).alias("first_match"),
        mp.apply_rule(F.col("text"), rule(pattern="([A-Za-z]+)ing", group=1, every=True, join="/")).alias("all_matches"),
        mp.apply_rule(F.col("lang"), rule(values=("en", "English"))).alias("mapped"),
        mp.apply_rule(blanked, rule(default="none")).alias("filled"))


PROJECTED_SQL = """SELECT site, row_no, layout, p_size,
  CASE WHEN layout = 1 THEN CASE c_status WHEN 'on' THEN '판매중' WHEN 'off' THEN '품절' ELSE '판매중' END ELSE trim(c_status) END AS wholesale_status,
  c_pid AS wholesale_product_id, CASE WHEN layout = 1 THEN regexp_extract(c_code, 'code=(\\w+)', 1) ELSE c_code END AS product_code,
  CASE WHEN layout = 1 THEN regexp_extract(c_name, '^([a-z ]+[a-z])', 1) ELSE c_name END AS original_name,
  CASE WHEN layout = 1 AND c_opts IS NOT NULL THEN 'S,M' ELSE c_opts END AS option_values_raw,
  c_price AS price_wholesale_raw, c_retail AS price_retail, c_min AS price_min_selling,
  CASE WHEN layout = 1 THEN 'Korea' ELSE c_origin END AS origin, c_img1 AS image_list_1, nullif(trim(c_img2), '') AS image_list_2,
  CASE WHEN layout = 2 THEN NULL ELSE c_detail END AS image_detail, c_date AS wholesale_registered_at
FROM sheet_rows"""
PROJECTED_FIELDS = ("wholesale_status", "wholesale_product_id", "product_code", "original_name", "option_values_raw", "price_wholesale_raw",
                    "price_retail", "price_min_selling", "origin", "image_list_1", "image_list_2", "image_detail", "wholesale_registered_at")


@query("MAP5", f"WITH f AS ({PROJECTED_SQL}) SELECT site, row_no, {', '.join(PROJECTED_FIELDS)} FROM f")
def map5(t):
    return mp.project_fields(*sheets(t)).select("site", "row_no", *PROJECTED_FIELDS)


@query("MAP6", """
SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'request' ELSE p_brand END AS origin, CASE WHEN p_size % 2 = 0 THEN 'extra' END AS note
FROM part""")
def map6(t):
    site = F.create_map(F.lit("title"), F.col("p_name"), F.lit("origin"), F.col("p_brand"))
    request = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("origin"), F.lit("request"), F.lit("note"), F.lit("extra")))
    merged = t.part.select("p_partkey", mp.overlay(site, request).alias("m"))
    return merged.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("title", "origin", "note")])


STATUS_SQL = case_map("wholesale_status", K.STATUS_SPELLINGS)
PARSED_SQL = f"""SELECT site, row_no, {STATUS_SQL} AS wholesale_status, product_code, original_name,
  CASE WHEN option_values_raw IS NULL THEN CAST({INT_PRICE_SQL.format('price_wholesale_raw')} AS BIGINT)
       WHEN p_size % 3 = 2 THEN NULL ELSE 2640 END AS price_wholesale,
  CASE WHEN option_values_raw IS NULL OR p_size % 3 = 2 THEN '' WHEN layout = 1 THEN 'S:2640|M:' ELSE 'Red:2640|Blue:' END
    || CASE WHEN option_values_raw IS NULL OR p_size % 3 = 2 THEN '' WHEN p_size % 3 = 0 THEN '2820' ELSE '2640' END AS variants,
  CASE WHEN option_values_raw IS NULL OR p_size % 3 = 2 OR ({STATUS_SQL} IS NULL AND wholesale_status IS NOT NULL) THEN ''
       ELSE concat(product_code, '-1=0|', product_code, '-2=', CASE WHEN p_size % 3 = 0 THEN '180' ELSE '0' END) END AS options,
  CAST(5000 AS INT) AS price_retail, p_size * 100 AS price_min_selling, origin,
  concat_ws('|', image_list_1, image_list_2) AS images, image_detail,
  concat_ws(';', CASE WHEN option_values_raw IS NOT NULL AND p_size % 3 = 2 THEN ':price_wholesale_raw' END,
    CASE WHEN {STATUS_SQL} IS NULL AND wholesale_status IS NOT NULL THEN 'invalid_wholesale_status:wholesale_status' END,
    CASE WHEN wholesale_status IS NULL THEN ':wholesale_status' END, CASE WHEN image_detail IS NULL THEN ':image_detail' END) AS warnings
FROM f"""


def parsed_columns(df, *first):
    show = lambda c, fn: F.array_join(F.transform(c, fn), "|")
    return df.select(
        *first, "site", "row_no", "wholesale_status", "product_code", "original_name", "price_wholesale",
        show("option_variants", lambda v: F.concat_ws(":", v["name"], v["price_wholesale"].cast("string"))).alias("variants"),
        show("standard_options", lambda o: F.concat_ws("=", o["option_sku"], o["option_price_delta"].cast("string"))).alias("options"),
        "price_retail", "price_min_selling", "origin", F.array_join("images_list", "|").alias("images"), "image_detail",
        F.array_join(F.transform("warnings", lambda w: F.concat(F.coalesce(w["code"], F.lit("")), F.lit(":"), w["field"])), ";").alias("warnings"))


@query("MAP7", f"WITH f AS ({PROJECTED_SQL}) {PARSED_SQL}")
def map7(t):
    return parsed_columns(mp.parse_rows(mp.project_fields(*sheets(t))))


@query("MAP8", f"""
WITH f AS ({PROJECTED_SQL}), n AS (SELECT site, row_no, row_number() OVER (PARTITION BY site ORDER BY row_no) AS k FROM f), p AS ({PARSED_SQL})
SELECT CAST(k AS INT) AS sample_no, p.* FROM p JOIN n USING (site, row_no) WHERE k <= 5""")
def map8(t):
    return parsed_columns(mp.preview(*sheets(t)), "sample_no")
