"""Source and sink queries; written files go to a fresh folder below the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.operators import ledger as lg
from wareloom.plans import ledger as lp
from wareloom.plans.mapping import sheets
from wareloom.plans.reads import catalogue
from wareloom.plans.registry import query
from wareloom.session import data_folder
from wareloom.sources import ledger_files as rd_files
from wareloom.sources import readers as rd
from wareloom.sources import writers as wr


def fresh_folder(t, name):
    return data_folder(t.spark, f"{name}-{uuid.uuid4().hex}")


LEDGER_COLUMNS = {"상품코드": "c_code", "상품명": "c_name", "옵션값": "c_opts", "가격": "c_price", "상세이미지": "c_detail"}


@query("SRC1", """
SELECT CAST(row_no AS VARCHAR) AS row_no, c_code AS code, concat(c_name, ', "x"', chr(10), 'y') AS name, c_opts AS options, c_price AS price, c_detail AS detail FROM sheet_rows""")
def src1(t):
    path = fresh_folder(t, "ledger-csv")
    rows = t.sheet_rows.withColumn("c_name", F.concat("c_name", F.lit(', "x"\ny')))
    cells = rows.select(F.col("row_no").alias("번호"), *[F.col(c).alias(h) for h, c in LEDGER_COLUMNS.items()])
    cells.write.options(header="true", quote='"', escape='"').csv(path)
    read = rd.read_ledger(t.spark, path, multi_line=True)
    return read.select(F.col("번호").alias("row_no"), F.col("상품코드").alias("code"), F.col("상품명").alias("name"), F.col("옵션값").alias("options"),
                       F.col("가격").alias("price"), F.col("상세이미지").alias("detail"))


#: headers of three suppliers' files, in their own order and spelling
SHUFFLED = {0: {"상품코드": "c_code", "상품명": "c_name", "가격": "c_price"}, 1: {"Price": "c_price", "Name, full": "c_name", "Code": "c_code", "Options": "c_opts"},
            2: {"품명": "c_name", "코드": "c_code", "상세": "c_detail", "금액": "c_price", "품명.1": "c_origin"}}


def ledger_folder(t):
    """One folder with the files of three suppliers, one without content, one without rows and one with a row that is too long."""
    folder = fresh_folder(t, "ledgers")
    for n, cells in SHUFFLED.items():
        rows = t.sheet_rows.filter(f"layout = {n}").repartition(4, "row_no")
        shown = rows.select(*[F.col(c).alias(h) for h, c in cells.items()])
        shown.toDF(*[h.removesuffix(".1") for h in cells]).write.options(header="true", quote='"', escape='"').csv(f"{folder}/supplier-{n}")
    for name, lines in (("empty", []), ("bare", ["a,b"]), ("long", ["a,b", "1,2,3", "4,5"])):
        t.spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return folder


@query("SRC1_many", """
SELECT layout, c_code AS code, c_name AS name, c_price AS price, CASE WHEN layout = 2 THEN c_origin END AS twice, CASE WHEN layout = 1 THEN c_opts END AS options FROM sheet_rows
UNION ALL SELECT 9, '1', '2', NULL, NULL, NULL UNION ALL SELECT 9, '4', '5', NULL, NULL, NULL""")
def src1_many(t):
    """Every file of the folder by its own header, in one job."""
    files = rd_files.read_ledgers(t.spark, ledger_folder(t))
    layout = F.coalesce(F.regexp_extract("file", "/supplier-([0-9])/", 1).try_cast("int"), F.lit(9))
    cell = lambda *names: F.coalesce(*[F.try_element_at("raw", F.lit(n)) for n in names])
    return files.rows.select(layout.alias("layout"), cell("상품코드", "Code", "코드", "a").alias("code"), cell("상품명", "Name, full", "품명", "b").alias("name"),
                             cell("가격", "Price", "금액").alias("price"), cell("품명.1").alias("twice"), cell("Options").alias("options"))


@query("SRC1_files", """
SELECT concat('supplier-', CAST(layout AS VARCHAR)) AS part, CASE layout WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 5 END AS n_columns, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS long_rows, NULL AS problem FROM sheet_rows GROUP BY layout
UNION ALL SELECT 'bare', 2, 0, 0, 'no rows' UNION ALL SELECT 'empty', 0, 0, 0, 'no header' UNION ALL SELECT 'long', 2, 2, 1, 'cells beyond the header'""")
def src1_files(t):
    """What the files of the folder held, and what is wrong with some of them."""
    report = rd_files.read_ledgers(t.spark, ledger_folder(t)).report
    part = F.regexp_extract("file", "/(supplier-[0-9]|bare|long|empty)/", 1).alias("part")
    by = report.groupBy(part, "n_columns", "problem").agg(F.sum("n_rows").alias("n_rows"), F.sum("long_rows").alias("long_rows"))
    return by.select("part", F.col("n_columns").cast("int").alias("n_columns"), "n_rows", "long_rows", "problem")


@query("SRC2", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY row_no) AS n FROM sheet_rows)
SELECT site, row_no, CAST(n AS INT) AS sample_no, CASE WHEN layout = 2 THEN '' ELSE c_detail END AS detail, coalesce(c_opts, '') AS options FROM k WHERE n <= 5""")
def src2(t):
    ledger, _, _ = sheets(t)
    cell = lambda *names: F.coalesce(*[F.try_element_at("raw", F.lit(n)) for n in names], F.lit(""))
    return rd.ledger_sample(ledger).select("site", "row_no", "sample_no", cell("상세이미지", "Detail").alias("detail"), cell("옵션값", "Options", "선택").alias("options"))


@query("SRC3", """
SELECT replace(replace(path, '네이버: ', ''), ' > ', '>') AS path, CAST(category_id AS VARCHAR) AS category_id, ord FROM categories""")
def src3(t):
    return rd.read_category_dictionary(t.categories)


@query("SRC4", """
SELECT 'site' AS scope, product_id, status FROM catalogue WHERE user_id = 3 AND site_id = 1 UNION ALL SELECT 'none', product_id, status FROM catalogue WHERE user_id = 3 AND site_id IS NULL
UNION ALL SELECT 'any', product_id, status FROM catalogue WHERE user_id = 3""")
def src4(t):
    part = lambda name, df: df.select(F.lit(name).alias("scope"), "product_id", "status")
    c = t.catalogue
    return part("site", rd.scan_state(c, 3, 1)).unionByName(part("none", rd.scan_state(c, 3))).unionByName(part("any", rd.scan_state(c, 3, any_site=True)))


@query("SRC5", """
SELECT p_partkey AS product_id, CASE WHEN p_size > 40 THEN p_name ELSE concat(p_name, ' fine') END AS refined_name, CASE WHEN p_size > 40 THEN '' ELSE concat(p_type, '|', p_brand) END AS related,
  p_size > 40 AS call_failed FROM part""")
def src5(t):
    path = fresh_folder(t, "enrichment-json")
    t.part.filter("p_size <= 40").select(F.col("p_partkey").alias("product_id"), F.concat("p_name", F.lit(" fine")).alias("refined_name"),
                                            F.array("p_type", "p_brand").alias("related")).write.json(path)
    products = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("original_name"))
    return rd.with_enrichment(products, rd.read_enrichment(t.spark, path)).select("product_id", "refined_name", F.array_join("related", "|").alias("related"), "call_failed")


OPTIONS_SQL = """n AS (SELECT *, coalesce(nullif(option_display_name, ''), nullif(option_value_1, '')) AS name FROM crawled_options),
o AS (SELECT product_id, string_agg(name, ',' ORDER BY option_position) AS names, string_agg(coalesce(CAST(option_supply_price AS VARCHAR), ''), ',' ORDER BY option_position) AS prices,
  string_agg(coalesce(option_main_image_url, ''), ',' ORDER BY option_position) AS images FROM n WHERE name IS NOT NULL GROUP BY product_id)"""


@query("SNK1", f"""
WITH {OPTIONS_SQL}
SELECT CASE supplier_status WHEN 'sold_out' THEN '품절' WHEN 'stopped' THEN '판매중지' ELSE '판매중' END AS "상태", supplier_product_id AS "제품번호", supplier_product_code AS "상품코드", coalesce(raw_product_name, '') AS "상품명",
  CASE WHEN coalesce(names, '') <> '' AND coalesce(prices, '') <> '' THEN prices ELSE coalesce(CAST(supply_price AS VARCHAR), '') END AS "가격", coalesce(origin, '') AS "원산지", main_image_url AS "목록이미지1", detail_content AS "상세이미지",
  coalesce(names, '') AS "옵션값", coalesce(images, '') AS "옵션이미지", CASE WHEN product_id % 2 = 0 THEN 'e1.jpg' ELSE '' END AS "목록이미지2", CASE WHEN product_id % 2 = 0 THEN 'e2.jpg' ELSE '' END AS "목록이미지3",
  '' AS "목록이미지4", '' AS "목록이미지5", CAST(first_seen_on AS VARCHAR) AS "등록일" FROM crawled_products LEFT JOIN o USING (product_id)""")
def snk1(t):
    extras = F.when(F.col("product_id") % 2 == 0, F.array(F.lit("e1.jpg"), F.lit("e2.jpg")))
    ledger = wr.supplier_ledger(t.crawled_products.withColumn("extra_image_urls", extras), t.crawled_options)
    path = fresh_folder(t, "supplier-ledger")
    wr.write_ledger(ledger, path)
    read = rd.read_ledger(t.spark, path)
    return read.select(*[F.coalesce(F.col(h), F.lit("")).alias(h) for h in K.EXPORT_HEADERS])


@query("SNK2", """
WITH m AS (SELECT product_id, max(CASE WHEN platform_name = 'naver' THEN coalesce(category_id, category_path, '') END) AS a, max(CASE WHEN platform_name = 'coupang' THEN coalesce(category_id, '') END) AS b FROM platform_mappings GROUP BY 1)
SELECT CAST(product_id AS VARCHAR) AS "상품고유ID", original_name AS "원래상품명", coalesce(refined_name, '') AS "정제상품명", coalesce(replace(keyword_list, ',', ', '), '') AS "키워드",
  coalesce(a, '') AS "네이버카테고리", coalesce(b, '') AS "쿠팡카테고리", status AS "가공상태", strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "등록일" FROM catalogue LEFT JOIN m USING (product_id) WHERE status = 'completed'""")
def snk2(t):
    return wr.processed_export(catalogue(t), t.platform_mappings)


@query("SNK3", f"""
WITH {lp.DIFF_SQL}, g AS (SELECT kind FROM x WHERE kind IN ('new', 'updated', 'removed'))
SELECT r.import_id, kind AS change_type, count(*) AS n FROM g CROSS JOIN (VALUES ('run-1'), ('run-2')) r(import_id) GROUP BY 1, 2
UNION ALL SELECT 'stock', change_type, count(*) FROM stock_changes GROUP BY 2""")
def snk3(t):
    """A change log partitioned by run, of which the second run is written twice, and a plain history in two parts."""
    path = fresh_folder(t, "change-log")
    changes = t.spark.read.parquet(wr.write_version(lp.changes(t), f"{path}/changes", "1"))
    for run in ("run-1", "run-2", "run-2"):
        wr.append(lg.change_log(changes, run), f"{path}/log", partition="import_id")
    for part in (0, 1):
        wr.append(t.stock_changes.filter(F.col("change_id") % 2 == part), f"{path}/stock")
    counted = lambda df, *first: df.groupBy(*first, "change_type").agg(F.count(F.lit(1)).alias("n"))
    stock = counted(t.spark.read.parquet(f"{path}/stock")).select(F.lit("stock").alias("import_id"), "change_type", "n")
    return counted(t.spark.read.parquet(f"{path}/log"), "import_id").unionByName(stock)


@query("SNK4", f"""
WITH o AS ({lp.OUTCOMES_SQL}), s AS (SELECT o.*, unnest([1, 2, 3]) AS pos FROM o WHERE success)
SELECT s.product_id, original_name AS name, CAST(pos AS INT) AS position, CASE pos WHEN 1 THEN 'refining' WHEN 2 THEN 'keywords' ELSE 'categorizing' END AS stage,
  CAST(CASE pos WHEN 1 THEN p_size WHEN 2 THEN p_size * 2 ELSE 0 END AS INT) AS ms, CAST(p_size * 3 AS BIGINT) AS total_ms, NULL AS error FROM s JOIN catalogue USING (product_id)
UNION ALL SELECT o.product_id, original_name, NULL, NULL, NULL, CAST(p_size * 3 AS BIGINT), 'call failed' FROM o JOIN catalogue USING (product_id) WHERE NOT success""")
def snk4(t):
    outcomes = lp.outcomes(t).withColumn("error", F.when(~F.col("success"), F.lit("call failed"))).select("product_id", "success", "stages", "error")
    trace = wr.stage_trace(t.catalogue.select("product_id", "original_name"), outcomes)
    rows = trace.select("product_id", "name", "total_ms", "error", F.posexplode_outer("stages").alias("pos", "s"))
    return rows.select("product_id", "name", (F.col("pos") + 1).alias("position"), F.col("s.stage").alias("stage"), F.col("s.ms").alias("ms"), "total_ms", "error")
