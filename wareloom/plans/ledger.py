"""Change-ledger queries: ledger_v2 uploaded over the catalogue of ledger_v1."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.operators import ledger as lg
from wareloom.operators import mapping as mp
from wareloom.operators.catalogue import Catalogue
from wareloom.operators.runs import apply_uploads
from wareloom.plans.mapping import PROJECTED_SQL, STATUS_SQL, sheets
from wareloom.plans.registry import query
from wareloom.session import data_folder
from wareloom.sources.readers import as_raw_rows, read_ledger
from wareloom.sources.writers import write_version

# Product fields and the fixture columns they come from, in reporting order; the nested ones are built from one text each.
COLUMNS = {f: {"option_variants": "variant_1", "standard_options": "standard_1", "images_list": "image_1"}.get(f, f) for f in K.IMPORT_FIELDS}
LISTS = ("option_variants", "standard_options", "images_list")


def nested(df):
    return df.withColumns({f: F.array(COLUMNS[f]) for f in LISTS}).drop(*[COLUMNS[f] for f in LISTS])


def upload(t):
    return nested(t.ledger_v2)


def state(t):
    return nested(t.ledger_v1)


def changes(t):
    return lg.diff(upload(t), state(t), runs=t.runs_v2)


def _differs(f):
    return f"n.{COLUMNS[f]} IS DISTINCT FROM o.{COLUMNS[f]}"


ANY = " OR ".join(_differs(f) for f in K.IMPORT_FIELDS)
CHANGED_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN {_differs(f)} THEN '{f}' END" for f in K.IMPORT_FIELDS) + ")"


def _new_id(u, s, code, run, row):
    own = f"concat(CAST({u} AS VARCHAR), '/', coalesce(CAST({s} AS VARCHAR), '~'), '/', "
    key = f"CASE WHEN {code} IS NULL THEN {own} 'row/', {run}, '/', CAST({row} AS VARCHAR)) ELSE {own} 'code/', {code}) END"
    return f"CAST(concat('0x', substr(md5({key}), 1, 15)) AS BIGINT)"


def diff_sql(stored, uploaded, runs, tag=""):
    """Tables o, n, d and x (suffixed by ``tag``): every stored and uploaded row with its class, written without the package's join."""
    values = ", ".join(f"n.{c} AS new_{c}, o.{c} AS old_{c}" for c in COLUMNS.values())
    redo = " OR ".join(f"list_contains(string_split(changed, '|'), '{f}')" for f in K.REPROCESS_FIELDS)
    return f"""o{tag} AS (SELECT s.*, r.import_id AS run, r.user_id IS NOT NULL AS in_run FROM {stored} s LEFT JOIN {runs} r ON r.user_id = s.user_id AND r.site_id IS NOT DISTINCT FROM s.site_id),
n{tag} AS (SELECT u.*, r.import_id AS run FROM {uploaded} u LEFT JOIN {runs} r ON r.user_id = u.user_id AND r.site_id IS NOT DISTINCT FROM u.site_id),
d{tag} AS (SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.row_no IS NULL THEN o.site_id ELSE n.site_id END AS site_id, coalesce(n.product_code, o.product_code) AS code,
   n.row_no, CASE WHEN n.row_no IS NULL THEN o.run ELSE n.run END AS run, o.product_id AS old_id, o.status AS old_status, o.change_type AS old_change, o.processed_image_path, o.image_status, o.import_id AS old_import, {values},
   CASE WHEN o.product_id IS NULL THEN 'new'
     WHEN n.row_no IS NULL THEN CASE WHEN o.product_code IS NULL OR o.site_id IS NULL OR NOT o.in_run OR o.change_type IS NOT DISTINCT FROM 'removed' THEN 'kept' ELSE 'removed' END
     WHEN {ANY} THEN 'updated' ELSE 'unchanged' END AS kind,
   CASE WHEN o.product_id IS NULL OR n.row_no IS NULL THEN '' ELSE {CHANGED_SQL} END AS differing
  FROM n{tag} n FULL JOIN o{tag} o ON n.user_id = o.user_id AND n.site_id IS NOT DISTINCT FROM o.site_id AND n.product_code = o.product_code),
c{tag} AS (SELECT * EXCLUDE (differing), CASE WHEN kind = 'removed' THEN 'wholesale_status' ELSE differing END AS changed FROM d{tag}),
x{tag} AS (SELECT *, coalesce(old_id, {_new_id("user_id", "site_id", "code", "run", "row_no")}) AS product_id, new_original_name AS new_name, old_original_name AS old_name,
   kind = 'new' OR (kind = 'updated' AND (old_status <> 'completed' OR {redo})) AS redo FROM c{tag})"""


def state_sql(x):
    """The catalogue after the run that table ``x`` describes."""
    fresh = lambda c: f"CASE WHEN kind IN ('new', 'updated') THEN new_{c} {chr(10)}WHEN '{c}' = 'wholesale_status' AND kind = 'removed' THEN '단종' ELSE old_{c} END AS {c}" if c == "wholesale_status" else f"CASE WHEN kind IN ('new', 'updated') THEN new_{c} ELSE old_{c} END AS {c}"
    image = "kind = 'updated' AND list_contains(string_split(changed, '|'), 'images_list')"
    return f"""SELECT product_id, user_id, site_id, code AS product_code, {', '.join(fresh(c) for c in COLUMNS.values())},
  CASE WHEN redo THEN 'pending' ELSE old_status END AS status, CASE WHEN kind IN ('new', 'updated', 'removed') THEN kind ELSE old_change END AS change_type,
  CASE WHEN {image} OR kind = 'new' THEN 'not_started' ELSE image_status END AS image_status, CASE WHEN NOT ({image}) THEN processed_image_path END AS processed_image_path,
  CASE WHEN kind IN ('new', 'updated') THEN run ELSE old_import END AS import_id FROM {x}"""


DIFF_SQL = diff_sql("ledger_v1", "ledger_v2", "runs_v2")
SECOND_SQL = DIFF_SQL + f", s1 AS ({state_sql('x')}), " + diff_sql("s1", "ledger_v3", "runs_v3", "2")


@query("L1", """
SELECT product_code, user_id, site_id, count(*) AS n FROM
  (SELECT user_id, site_id, product_code FROM ledger_v2 UNION ALL SELECT user_id, site_id, product_code FROM ledger_v2 WHERE row_no % 10 = 0
   UNION ALL SELECT 2, 30, product_code FROM ledger_v2 WHERE user_id = 1) u
WHERE trim(product_code) <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def l1(t):
    rows = t.ledger_v2
    again = rows.filter("row_no % 10 = 0").unionByName(rows.filter("user_id = 1").withColumns({"user_id": F.lit(2), "site_id": F.lit(30)}))
    return lg.duplicate_codes(rows.unionByName(again))


@query("L2", f"""
WITH f AS ({PROJECTED_SQL}) SELECT site, row_no, wholesale_status AS raw_value FROM f WHERE wholesale_status IS NOT NULL AND {STATUS_SQL} IS NULL""")
def l2(t):
    return lg.invalid_status_rows(mp.parse_rows(mp.project_fields(*sheets(t))))


@query("L3", f"WITH {DIFF_SQL} SELECT user_id, site_id, code AS product_code, row_no, kind AS change_type FROM x WHERE row_no IS NOT NULL")
def l3(t):
    return changes(t).filter("new is not null").select(*lg.SCOPE, "product_code", F.col("new.row_no").alias("row_no"), "change_type")


def _value_case(side):
    shown = {f: f"CAST({side}_{COLUMNS[f]} AS VARCHAR)" if f not in LISTS else "NULL" for f in K.IMPORT_FIELDS}
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {v}" for f, v in shown.items()) + " END"


@query("L4", f"""
WITH {DIFF_SQL}, e AS (SELECT *, unnest(string_split(changed, '|')) AS field, generate_subscripts(string_split(changed, '|'), 1) AS pos FROM x WHERE kind IN ('updated', 'removed'))
SELECT user_id, site_id, code AS product_code, kind AS change_type, CAST(pos AS INT) AS position, field, {_value_case("old")} AS old_value,
  CASE WHEN kind = 'removed' THEN '단종' ELSE {_value_case("new")} END AS new_value
FROM e""")
def l4(t):
    return lg.change_rows(changes(t))


@query("L5", f"WITH {DIFF_SQL} SELECT product_id, code AS product_code, redo AS reprocess, CASE WHEN redo THEN 'pending' ELSE old_status END AS status FROM x WHERE kind = 'updated'")
def l5(t):
    redo = F.col("reprocess")
    return changes(t).filter("change_type = 'updated'").select(
        "product_id", "product_code", redo.alias("reprocess"), F.when(redo, F.lit("pending")).otherwise(F.col("old.status")).alias("status"))


@query("L6", """
SELECT user_id, site_id, product_code, product_id, original_name FROM ledger_v1 s
WHERE change_type IS DISTINCT FROM 'removed' AND EXISTS (SELECT 1 FROM runs_v2 r WHERE r.user_id = s.user_id AND r.site_id = s.site_id)
  AND NOT EXISTS (SELECT 1 FROM ledger_v2 u WHERE u.user_id = s.user_id AND u.site_id = s.site_id AND u.product_code = s.product_code)""")
def l6(t):
    return lg.discontinued(state(t), upload(t)).select(*lg.SCOPE, "product_code", "product_id", "original_name")


@query("L7", f"WITH {DIFF_SQL}, s AS ({state_sql('x')}) SELECT product_id, product_code, processed_image_path, image_status FROM s WHERE change_type = 'updated' AND import_id <> 'run-0'")
def l7(t):
    done = lg.next_state(changes(t)).filter("import_id <> 'run-0' and change_type = 'updated'")
    return done.select("product_id", "product_code", "processed_image_path", "image_status")


@query("L8", f"""
WITH {DIFF_SQL}, m AS (SELECT product_id, string_split(changed, '|') AS f FROM x WHERE kind IN ('updated', 'removed'))
SELECT p.product_id, platform_name, CASE WHEN m.product_id IS NOT NULL THEN 'pending_update' ELSE sync_status END AS sync_status,
  price_changed OR coalesce(list_has_any(f, ['price_wholesale', 'price_wholesale_raw', 'option_variants', 'standard_options']), false) AS price_changed,
  stock_changed OR coalesce(list_contains(f, 'wholesale_status'), false) AS stock_changed, CASE WHEN m.product_id IS NOT NULL THEN TIMESTAMP '2024-05-05 12:00:00' END AS last_changed_at
FROM platform_mappings p LEFT JOIN m ON m.product_id = p.product_id""")
def l8(t):
    at = F.lit("2024-05-05 12:00:00").cast("timestamp_ntz")
    return lg.propagate(t.platform_mappings.withColumn("last_changed_at", F.lit(None).cast("timestamp_ntz")), changes(t), at).select(
        "product_id", "platform_name", "sync_status", "price_changed", "stock_changed", "last_changed_at")


@query("L9", f"""
WITH {DIFF_SQL} SELECT run AS import_id, user_id, site_id, product_id, code AS product_code, coalesce(new_name, old_name) AS original_name, kind AS change_type, changed AS changed_fields
FROM x WHERE kind IN ('new', 'updated', 'removed')""")
def l9(t):
    log = lg.change_log(changes(t))
    return log.select("import_id", *lg.SCOPE, "product_id", "product_code", "original_name", "change_type", F.array_join("changed_fields", "|").alias("changed_fields"))


COUNTS_SQL = """count(*) FILTER (kind = 'new') AS new_count, count(*) FILTER (kind = 'updated') AS updated_count, count(*) FILTER (kind = 'removed') AS removed_count,
  count(*) FILTER (kind = 'unchanged') AS unchanged_count, count(*) FILTER (redo) AS reprocess_count, CASE WHEN count(*) FILTER (redo) = 0 THEN 'completed' ELSE 'pending' END AS status"""


@query("L10", f"WITH {DIFF_SQL} SELECT run AS import_id, user_id, site_id, {COUNTS_SQL} FROM x WHERE run IS NOT NULL GROUP BY 1, 2, 3")
def l10(t):
    return lg.counters(changes(t), by=("import_id", *lg.SCOPE))


SHOWN = ("product_id", *lg.SCOPE, "product_code", "original_name", "price_wholesale", "price_retail", "origin", "wholesale_status", "status", "change_type", "image_status", "import_id")


@query("L11", f"WITH {DIFF_SQL}, s AS ({state_sql('x')}) SELECT {', '.join(SHOWN)}, image_1, variant_1 FROM s")
def l11(t):
    return lg.next_state(changes(t)).select(*SHOWN, F.col("images_list")[0].alias("image_1"), F.col("option_variants")[0].alias("variant_1"))


@query("L11_second", f"WITH {SECOND_SQL}, s AS ({state_sql('x2')}) SELECT {', '.join(SHOWN)}, image_1, variant_1 FROM s")
def l11_second(t):
    """The state after a second batch of uploads over the state of the first."""
    return two_batches(t)[0].state().select(*SHOWN, F.col("images_list")[0].alias("image_1"), F.col("option_variants")[0].alias("variant_1"))


def two_batches(t):
    """A stored catalogue of 32 buckets and two batches of uploads; the catalogue and what the last batch did."""
    at = F.lit("2024-05-05 12:00:00").cast("timestamp_ntz")
    stamped = t.platform_mappings.withColumn("last_changed_at", F.lit(None).cast("timestamp_ntz"))
    stored = Catalogue.create(state(t), stamped, data_folder(t.spark, f"catalogue-{uuid.uuid4().hex}"), scopes=8, parts=4)
    stored.apply(upload(t), t.runs_v2, "1", at)
    return stored, stored.apply(nested(t.ledger_v3), t.runs_v3, "2", at)


@query("L10_second", f"WITH {SECOND_SQL} SELECT run AS import_id, user_id, site_id, {COUNTS_SQL} FROM x2 WHERE run IS NOT NULL GROUP BY 1, 2, 3")
def l10_second(t):
    return two_batches(t)[1].counters


@query("L9_second", f"""
WITH {SECOND_SQL}, logged AS (SELECT * FROM x UNION ALL SELECT * FROM x2)
SELECT run AS import_id, user_id, site_id, product_id, code AS product_code, coalesce(new_name, old_name) AS original_name, kind AS change_type, changed AS changed_fields
FROM logged WHERE kind IN ('new', 'updated', 'removed')""")
def l9_second(t):
    """The log of both batches, read back from the table they were appended to."""
    log = two_batches(t)[0].log()
    return log.select("import_id", *lg.SCOPE, "product_id", "product_code", "original_name", "change_type", F.array_join("changed_fields", "|").alias("changed_fields"))


def _marked_sql(x):
    return f"SELECT product_id, string_split(changed, '|') AS f FROM {x} WHERE kind IN ('updated', 'removed')"


@query("L8_second", f"""
WITH {SECOND_SQL}, m AS (SELECT product_id, flatten(list(f)) AS f FROM ({_marked_sql('x')} UNION ALL {_marked_sql('x2')}) b GROUP BY 1)
SELECT p.product_id, platform_name, CASE WHEN m.product_id IS NOT NULL THEN 'pending_update' ELSE sync_status END AS sync_status,
  price_changed OR coalesce(list_has_any(f, ['price_wholesale', 'price_wholesale_raw', 'option_variants', 'standard_options']), false) AS price_changed,
  stock_changed OR coalesce(list_contains(f, 'wholesale_status'), false) AS stock_changed, CASE WHEN m.product_id IS NOT NULL THEN TIMESTAMP '2024-05-05 12:00:00' END AS last_changed_at
FROM platform_mappings p LEFT JOIN m ON m.product_id = p.product_id""")
def l8_second(t):
    """The mappings of the stored catalogue after both batches."""
    return two_batches(t)[0].mappings().select("product_id", "platform_name", "sync_status", "price_changed", "stock_changed", "last_changed_at")


@query("L10_again", """
SELECT 'again' AS import_id, 1 AS user_id, 10 AS site_id, CAST(0 AS BIGINT) AS new_count, CAST(0 AS BIGINT) AS updated_count, CAST(0 AS BIGINT) AS removed_count, count(*) AS unchanged_count,
  CAST(0 AS BIGINT) AS reprocess_count, 'completed' AS status, 0 AS compared, 0 AS rewritten FROM ledger_v2 WHERE user_id = 1 AND site_id = 10 AND product_code IS NOT NULL""")
def l10_again(t):
    """A ledger is uploaded twice: the second time its digests are those of the catalogue, so no row is compared and no bucket written."""
    at = F.lit("2024-05-05 12:00:00").cast("timestamp_ntz")
    stamped = t.platform_mappings.withColumn("last_changed_at", F.lit(None).cast("timestamp_ntz"))
    one = upload(t).filter("user_id = 1 AND site_id = 10 AND product_code IS NOT NULL")
    stored = Catalogue.create(state(t), stamped, data_folder(t.spark, f"catalogue-{uuid.uuid4().hex}"), scopes=8, parts=4)
    run = lambda name: t.spark.createDataFrame([(name, 1, 10)], "import_id string, user_id int, site_id int")
    stored.apply(one, run("first"), "1", at)
    again = stored.apply(one, run("again"), "2", at)
    return again.counters.withColumns({"compared": F.lit(len(again.compared)), "rewritten": F.lit(len(again.rewritten))})


# Headers of a supplier's file, recognised without rules.
FILE_HEADERS = {"번호": "row_no", "상태": "wholesale_status", "제품번호": "wholesale_product_id", "상품코드": "product_code", "상품명": "original_name", "가격": "price_wholesale",
                "소비자가": "price_retail", "판매준수가": "price_min_selling", "원산지": "origin", "대표이미지": "image_1", "상세이미지": "image_detail", "등록일": "wholesale_registered_at"}
FILE_FIELDS = [c for c in FILE_HEADERS.values() if c not in ("row_no", "product_code")]


def from_file(t, rows, path):
    """Write rows as a supplier's CSV file, read it back, map its headers and parse it."""
    rows.select(*[F.col(c).cast("string").alias(h) for h, c in FILE_HEADERS.items()]).write.options(header="true", quote='"', escape='"').csv(path)
    raw = as_raw_rows(read_ledger(t.spark, path), 10, "번호")
    headers = t.spark.createDataFrame([(10, h) for h in FILE_HEADERS if h != "번호"], "site int, header string")
    rules = t.spark.createDataFrame([], "site int, field string, source string, default string, pattern string, regex_group string, regex_all boolean, join_with string, value_map map<string,string>, plain boolean")
    parsed = mp.parse_rows(mp.project_fields(raw, rules, headers)).withColumns({"user_id": F.lit(1), "site_id": F.col("site")})
    return t.spark.read.parquet(write_version(parsed, f"{path}-parsed", "1"))  # gates and comparison both read it


@query("L16", f"""
WITH o AS (SELECT * FROM ledger_v1 WHERE user_id = 1 AND site_id = 10), n AS (SELECT * FROM ledger_v2 WHERE user_id = 1 AND site_id = 10),
d AS (SELECT coalesce(n.product_code, o.product_code) AS product_code, CASE WHEN o.product_id IS NULL THEN 'new' WHEN n.row_no IS NULL THEN 'removed'
    WHEN {" OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in FILE_FIELDS)} THEN 'updated' ELSE 'unchanged' END AS kind, n.original_name AS n_name, o.original_name AS o_name,
    n.price_wholesale AS n_price, o.price_wholesale AS o_price, n.wholesale_status AS n_status, o.wholesale_status AS o_status
  FROM n FULL JOIN o ON n.product_code = o.product_code)
SELECT product_code, CASE WHEN kind IN ('new', 'updated') THEN n_name ELSE o_name END AS original_name, CAST(CASE WHEN kind IN ('new', 'updated') THEN n_price ELSE o_price END AS BIGINT) AS price_wholesale,
  CASE kind WHEN 'removed' THEN '단종' WHEN 'unchanged' THEN o_status ELSE n_status END AS wholesale_status, 'pending' AS status,
  CASE WHEN kind = 'unchanged' THEN 'new' ELSE kind END AS change_type, CASE WHEN kind IN ('new', 'updated') THEN 'run-2' ELSE 'run-1' END AS import_id FROM d""")
def l16(t):
    """Two supplier files, one after the other, from CSV to the catalogue: the first meets an empty one."""
    root = data_folder(t.spark, f"files-{uuid.uuid4().hex}")
    one_scope = "user_id = 1 AND site_id = 10"
    first = from_file(t, t.ledger_v1.filter(one_scope).withColumn("row_no", F.col("product_id")), f"{root}/first")
    second = from_file(t, t.ledger_v2.filter(one_scope), f"{root}/second")
    none = lambda kind: F.lit(None).cast(kind)
    empty = first.limit(0).drop("row_no").withColumns({"product_id": none("bigint"), "status": none("string"), "change_type": none("string"), "processed_image_path": none("string"), "image_status": none("string")})
    run = lambda name: t.spark.createDataFrame([(name, 1, 10)], "import_id string, user_id int, site_id int")
    stored = apply_uploads(first, empty, t.platform_mappings, run("run-1"), root, "1")
    applied = apply_uploads(second, stored.state, stored.mappings, run("run-2"), root, "2")
    return applied.state.select("product_code", "original_name", "price_wholesale", "wholesale_status", "status", "change_type", "import_id")


CRAWL_SQL = """
SELECT event_id AS seq, user_id % 60 AS supplier_id,
  concat(CASE WHEN event_type = 'signup' THEN 'D-' ELSE 'C-' END, CAST(user_id AS VARCHAR(20))) AS supplier_product_code,
  concat('crawled ', event_type) AS raw_product_name, CAST(floor(value) AS INT) AS supply_price
FROM events"""


@query("L12", f"""
WITH c AS ({CRAWL_SQL}), l AS (SELECT supplier_id, supplier_product_code, arg_max(raw_product_name, seq) AS n, arg_max(supply_price, seq) AS p FROM c GROUP BY 1, 2)
SELECT supplier_id, supplier_product_code, c.product_id, CASE WHEN l.n IS NOT NULL THEN l.n ELSE c.raw_product_name END AS raw_product_name,
  CASE WHEN l.n IS NOT NULL THEN l.p ELSE c.supply_price END AS supply_price, l.n IS NOT NULL AS touched, c.product_id IS NULL AS is_new
FROM crawled_products c FULL JOIN l USING (supplier_id, supplier_product_code)""")
def l12(t):
    out = lg.upsert_crawled(t.sql(CRAWL_SQL), t.crawled_products)
    return out.select("supplier_id", "supplier_product_code", "product_id", "raw_product_name", "supply_price", "touched", "is_new")


OUTCOMES_SQL = """SELECT p_partkey AS product_id, p_size % 3 <> 0 AS success, concat(p_name, ' refined') AS refined_name, p_size FROM part WHERE p_type <> 'LARGE'"""


def outcomes(t):
    stage = lambda name, ms: F.struct(F.lit(name).alias("stage"), ms.cast("int").alias("ms"))
    size = F.col("p_size")
    return t.sql(OUTCOMES_SQL).withColumns({
        "keywords": F.array("refined_name"), "stages": F.array(stage("refining", size), stage("keywords", size * 2), stage("categorizing", F.lit(None)))})


@query("L13", f"""
WITH o AS ({OUTCOMES_SQL})
SELECT product_id, CASE WHEN success THEN 'completed' WHEN NOT success THEN 'failed' ELSE s.status END AS status, CASE WHEN success THEN o.refined_name ELSE s.product_code END AS refined_name,
  CASE WHEN success THEN o.refined_name ELSE 'kept word' END AS keywords, CASE WHEN success IS TRUE THEN 'supplier|enrichment' ELSE 'supplier' END AS warnings,
  CASE WHEN success THEN NULL ELSE s.change_type END AS change_type, CASE WHEN success THEN NULL ELSE 'origin' END AS changed_fields,
  CASE WHEN success THEN CAST(p_size * 3 AS BIGINT) ELSE 77 END AS processing_time_ms
FROM state_flags s LEFT JOIN o USING (product_id)""")
def l13(t):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    products = t.state_flags.withColumns({"refined_name": F.col("product_code"), "keywords": words("kept word"), "supplier_warnings": words("supplier"), "warnings": words("supplier"),
                                          "changed_fields": words("origin"), "processing_time_ms": F.lit(77).cast("bigint")})
    out = lg.apply_outcomes(products, outcomes(t).withColumn("warnings", words("supplier", "enrichment")))
    flat = [F.array_join(c, "|").alias(c) for c in ("keywords", "warnings", "changed_fields")]
    return out.select("product_id", "status", "refined_name", *flat, "change_type", "processing_time_ms")


@query("L13_twice", f"""
WITH o AS ({OUTCOMES_SQL})
SELECT product_id, CASE WHEN success THEN 'completed' WHEN NOT success AND p_size % 2 = 0 THEN 'completed' WHEN NOT success THEN 'failed' ELSE s.status END AS status,
  CASE WHEN success THEN o.refined_name WHEN NOT success AND p_size % 2 = 0 THEN 'second try' ELSE s.product_code END AS refined_name
FROM state_flags s LEFT JOIN o USING (product_id)""")
def l13_twice(t):
    """Failed products of even size are tried again and succeed: each product stays one row, with its last outcome."""
    first = outcomes(t).withColumn("seq", F.lit(1))
    again = first.filter("NOT success AND p_size % 2 = 0").withColumns({"success": F.lit(True), "refined_name": F.lit("second try"), "seq": F.lit(2)})
    out = lg.apply_outcomes(t.state_flags.withColumn("refined_name", F.col("product_code")), first.unionByName(again))
    return out.select("product_id", "status", "refined_name")


@query("L13_run", f"""
WITH o AS ({OUTCOMES_SQL})
SELECT count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failed_count,
  CASE WHEN count(*) FILTER (success) = 0 AND count(*) > 0 THEN 'failed' ELSE 'completed' END AS status FROM o""")
def l13_run(t):
    return lg.outcome_counters(outcomes(t))


RESULTS_SQL = """SELECT p_partkey AS product_id, 'coupang' AS platform_name, concat('NEW', CAST(p_size AS VARCHAR(20))) AS category_id, p_type AS category_path, concat('brand=', p_brand) AS mapped_attributes FROM part WHERE p_size > 10"""


@query("L14", f"""
WITH r AS ({RESULTS_SQL})
SELECT product_id, platform_name, CASE WHEN r.category_id IS NOT NULL THEN r.category_id ELSE m.category_id END AS category_id,
  CASE WHEN r.category_id IS NOT NULL THEN r.category_path ELSE m.category_path END AS category_path, r.mapped_attributes, coalesce(m.sync_status, 'draft') AS sync_status
FROM platform_mappings m FULL JOIN r USING (product_id, platform_name)""")
def l14(t):
    return lg.ensure_mappings(t.platform_mappings, t.sql(RESULTS_SQL)).select("product_id", "platform_name", "category_id", "category_path", "mapped_attributes", "sync_status")


TWICE_SQL = f"""SELECT *, 1 AS seq FROM ({RESULTS_SQL}) a UNION ALL SELECT product_id, platform_name, concat('LATER', substr(category_id, 4)), category_path, 'corrected', 2 FROM ({RESULTS_SQL}) b WHERE product_id % 3 = 0"""


@query("L14_twice", f"""
WITH r AS ({RESULTS_SQL})
SELECT product_id, platform_name, CASE WHEN r.category_id IS NULL THEN m.category_id WHEN product_id % 3 = 0 THEN concat('LATER', substr(r.category_id, 4)) ELSE r.category_id END AS category_id,
  CASE WHEN r.category_id IS NULL THEN NULL WHEN product_id % 3 = 0 THEN 'corrected' ELSE r.mapped_attributes END AS mapped_attributes, coalesce(m.sync_status, 'draft') AS sync_status
FROM platform_mappings m FULL JOIN r USING (product_id, platform_name)""")
def l14_twice(t):
    """A third of the pairs have a second, later result: each pair keeps one mapping."""
    out = lg.ensure_mappings(t.platform_mappings, t.sql(TWICE_SQL))
    return out.select("product_id", "platform_name", "category_id", "mapped_attributes", "sync_status")


@query("L15", """
SELECT product_id, status, 'ids' AS source FROM state_flags WHERE product_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT product_id, status, 'run' FROM state_flags WHERE site_id = 2 AND status <> 'completed'""")
def l15(t):
    ids = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("product_id"))
    products = t.state_flags.withColumn("import_id", F.col("site_id"))
    chosen = lg.select_work(products, ids=ids).select("product_id", "status", F.lit("ids").alias("source"))
    return chosen.unionByName(lg.select_work(products, import_id=2).select("product_id", "status", F.lit("run").alias("source")))
