import pytest
from pyspark.sql import functions as F

from wareloom.operators import ledger as lg
from wareloom.operators.runs import apply_uploads

STATE = ("product_id int, product_code string, original_name string, price_wholesale int, wholesale_status string, images_list array<string>, status string, "
         "change_type string, image_status string, processed_image_path string")
UPLOAD = "row_no int, product_code string, original_name string, price_wholesale int, wholesale_status string, images_list array<string>"


FIELDS = ("original_name", "price_wholesale", "wholesale_status", "images_list")


def diff(upload, state, **options):
    return lg.diff(upload, state, fields=FIELDS, **options)


@pytest.fixture()
def state(spark):
    return spark.createDataFrame([
        (1, "SAME", "same", 100, "판매중", ["a"], "completed", None, "completed", "x.jpg"),
        (2, "UPD", "upd", 100, "판매중", ["a"], "completed", None, "completed", "x.jpg"),
        (3, "IMG", "img", 100, "판매중", ["a"], "completed", None, "completed", "x.jpg"),
        (4, "GONE", "gone", 100, "판매중", ["a"], "completed", None, "completed", "x.jpg"),
        (5, "OLD", "old", 100, "단종", ["a"], "completed", "removed", "completed", "x.jpg"),
        (6, None, "codeless", 100, "판매중", ["a"], "completed", None, "completed", "x.jpg"),
        (7, "BACK", "back", 100, "단종", ["a"], "pending", "removed", "completed", None)], STATE)


@pytest.fixture()
def upload(spark):
    return spark.createDataFrame([
        (1, "SAME", "same", 100, "판매중", ["a"]), (2, "UPD", "upd", 120, "판매중", ["a"]), (3, "IMG", "img", 100, "판매중", ["b"]),
        (4, "NEW", "new", 1, "판매중", []), (5, None, "no code", 1, "판매중", []), (6, " ", "blank code", 1, "판매중", []), (7, "BACK", "back", 100, "판매중", ["a"])], UPLOAD)


def test_classes_fields_and_reprocessing(upload, state):
    got = {(r.product_code or "").strip() + ":" + r.change_type: r for r in diff(upload, state).collect()}
    assert sorted(got) == sorted(["SAME:unchanged", "UPD:updated", "IMG:updated", "NEW:new", ":new", "GONE:removed", "OLD:kept", ":kept", "BACK:updated"])
    assert got["UPD:updated"].changed_fields == ["price_wholesale"] and got["UPD:updated"].reprocess is False
    assert got["UPD:updated"].field_changes["price_wholesale"].asDict() == {"old": "100", "new": "120"}
    assert got["IMG:updated"].reprocess is True and got["IMG:updated"].field_changes["images_list"].asDict() == {"old": None, "new": None}
    assert got["BACK:updated"].reprocess is True  # not finished before
    assert got["GONE:removed"].field_changes["wholesale_status"].asDict() == {"old": "판매중", "new": "단종"}


def test_counters_add_up_and_log_follows(upload, state):
    changes = diff(upload, state)
    c = lg.counters(changes).first()
    assert (c.new_count, c.updated_count, c.removed_count, c.unchanged_count, c.reprocess_count, c.status) == (3, 3, 1, 1, 5, "pending")
    assert lg.change_log(changes, "r").count() == 7
    assert lg.counters(changes, start_processing=False).first().status == "imported"


def test_without_a_site_nothing_is_removed(upload, state):
    assert diff(upload, state, site_given=False).filter("change_type = 'removed'").count() == 0


def test_same_ledger_again_changes_nothing_but_codeless_rows(upload, state):
    after = lg.next_state(diff(upload, state), "run-1")
    again = lg.counters(diff(upload, after)).first()
    assert (again.updated_count, again.removed_count, again.new_count) == (0, 0, 2)


def test_next_state_resets_images_and_marks_discontinued(upload, state):
    after = {r.product_code: r for r in lg.next_state(diff(upload, state), "run-1").collect() if r.product_code}
    assert (after["IMG"].processed_image_path, after["IMG"].image_status, after["IMG"].status) == (None, "not_started", "pending")
    assert (after["GONE"].wholesale_status, after["GONE"].change_type) == ("단종", "removed")
    assert (after["UPD"].price_wholesale, after["UPD"].status, after["UPD"].import_id) == (120, "completed", "run-1")
    assert after["SAME"].import_id is None


def test_propagation_only_sets_flags(spark, upload, state):
    mappings = spark.createDataFrame([(2, "naver", "synced", False, True), (4, "naver", "synced", False, False), (1, "naver", "synced", True, False)],
                                     "product_id int, platform_name string, sync_status string, price_changed boolean, stock_changed boolean")
    got = {r.product_id: (r.sync_status, r.price_changed, r.stock_changed) for r in lg.propagate(mappings, diff(upload, state)).collect()}
    assert got == {2: ("pending_update", True, True), 4: ("pending_update", False, True), 1: ("synced", True, False)}


def test_gates(spark):
    rows = spark.createDataFrame([("A",), ("A",), ("B",), (None,), (None,)], "product_code string")
    gate = lg.duplicate_codes(rows)
    assert [(r.product_code, r.n) for r in gate.collect()] == [("A", 2)]
    with pytest.raises(lg.RunRefused, match="Duplicate codes: A"):
        lg.refuse_if_any(gate, "Duplicate codes")
    lg.refuse_if_any(gate.filter("n > 5"), "Duplicate codes")


def test_crawled_upsert_keeps_unseen_and_takes_last_write(spark):
    stored = spark.createDataFrame([(1, 7, "A", "old"), (2, 7, "B", "stay")], "product_id int, supplier_id int, supplier_product_code string, raw_product_name string")
    crawled = spark.createDataFrame([(7, "A", "first", 1), (7, "A", "last", 2), (7, "C", "new", 3)], "supplier_id int, supplier_product_code string, raw_product_name string, seq int")
    got = {r.supplier_product_code: (r.product_id, r.raw_product_name, r.touched, r.is_new) for r in lg.upsert_crawled(crawled, stored).collect()}
    assert got == {"A": (1, "last", True, False), "B": (2, "stay", False, False), "C": (None, "new", True, True)}
    options = spark.createDataFrame([(1, "o1"), (2, "o2")], "product_id int, name string")
    fresh = spark.createDataFrame([(1, "n1")], "product_id int, name string")
    left = lg.replace_options(options, fresh, spark.createDataFrame([(1,)], "product_id int"))
    assert sorted((r.product_id, r.name) for r in left.collect()) == [(1, "n1"), (2, "o2")]


def test_run_fails_only_when_everything_failed(spark):
    outcome = lambda *flags: lg.outcome_counters(spark.createDataFrame([(f,) for f in flags], "success boolean")).first().status
    assert (outcome(False, False), outcome(True, False)) == ("failed", "completed")


SCOPED = "user_id int, site_id int, product_code string, original_name string, price_wholesale int, wholesale_status string, images_list array<string>"


def test_owner_and_site_are_part_of_the_key(spark):
    row = lambda user, site, code, price=1: (user, site, code, "n", price, "판매중", ["a"])
    stored = spark.createDataFrame([(i, *r, "completed", None, "completed", None) for i, r in enumerate(
        [row(1, 10, "A"), row(1, None, "A"), row(2, 10, "A"), row(2, 20, "A"), row(1, 10, "B"), row(1, None, "B"), row(3, 10, "A")])],
        f"product_id int, {SCOPED}, status string, change_type string, image_status string, processed_image_path string")
    upload = spark.createDataFrame([row(1, 10, "A", 2), row(1, None, "A"), row(2, 10, "N")], SCOPED)
    kinds = {(r.user_id, r.site_id, r.product_code): r.change_type for r in diff(upload, stored).collect()}
    assert kinds == {(1, 10, "A"): "updated", (1, None, "A"): "unchanged", (2, 10, "A"): "removed", (2, 20, "A"): "kept", (1, 10, "B"): "removed", (1, None, "B"): "kept",
                     (2, 10, "N"): "new", (3, 10, "A"): "kept"}
    empty = spark.createDataFrame([("r", 3, 10)], "import_id string, user_id int, site_id int")
    gone = diff(upload.limit(0), stored, runs=empty).filter("change_type = 'removed'").collect()
    assert [(r.user_id, r.site_id, r.product_code, r.import_id) for r in gone] == [(3, 10, "A", "r")]
    twice = spark.createDataFrame([row(1, 10, "A"), row(2, 10, "A"), row(1, None, "A"), row(1, None, "A")], SCOPED)
    assert [(r.user_id, r.site_id, r.product_code, r.n) for r in lg.duplicate_codes(twice).collect()] == [(1, None, "A", 2)]


def test_rows_without_a_code_come_out_once_and_each_side_is_read_once(spark, tmp_path, upload, state):
    """Rows without a code on both sides, some of them alike to the last column, match nothing; their own ids spread them."""
    blank = lambda n: spark.createDataFrame([(n, "\u3000\t", "no code", 1, "판매중", ["a"])] * 2, UPLOAD)
    bare = state.filter("product_code IS NULL")
    for name, rows in (("upload", upload.unionByName(blank(6)).unionByName(blank(None))), ("state", state.unionByName(bare).unionByName(bare.withColumn("product_id", F.lit(5))))):
        rows.write.parquet(f"{tmp_path}/{name}")
    runs = spark.createDataFrame([("r", None, 0)], "import_id string, user_id bigint, site_id bigint")
    done = diff(spark.read.parquet(f"{tmp_path}/upload"), spark.read.parquet(f"{tmp_path}/state"), runs=runs)
    codeless = done.filter(F.col("product_code").isNull() | F.col("product_code").isin(" ", "\u3000\t")).collect()
    assert sorted((r.change_type, r.old is None, r.new is None, r.product_id if r.old else 0) for r in codeless) == [("kept", False, True, 5), ("kept", False, True, 6), ("kept", False, True, 6)] + [("new", True, False, 0)] * 6
    assert done.count() == 16
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_new_products_get_an_owner_and_a_lasting_id(spark, upload, state):
    after = lg.next_state(diff(upload, state, import_id="r1"))
    assert len(set(after.columns)) == len(after.columns)
    ids = {r.product_code: r.product_id for r in after.collect() if r.change_type == "new"}
    assert all(ids.values()) and len(set(ids.values())) == 3
    again = {r.product_code: r.product_id for r in lg.next_state(diff(upload, after, import_id="r2")).filter("product_code = 'NEW'").collect()}
    assert again == {"NEW": ids["NEW"]}
    log = lg.change_log(diff(upload, state, import_id="r1")).filter("change_type = 'new'").collect()
    assert {r.product_id for r in log} == set(ids.values()) and {r.import_id for r in log} == {"r1"}


def test_a_field_missing_from_the_upload_is_refused(upload, state):
    with pytest.raises(ValueError, match="wholesale_product_id"):
        lg.diff(upload, state)


def test_a_refused_batch_writes_nothing(spark, tmp_path, upload):
    rows = upload.unionByName(upload.filter("product_code = 'NEW'")).withColumns({"user_id": F.lit(1), "site_id": F.lit(1)})
    runs = spark.createDataFrame([("r", 1, 1)], "import_id string, user_id int, site_id int")
    with pytest.raises(lg.RunRefused, match="NEW"):
        apply_uploads(rows, rows, rows, runs, str(tmp_path / "out"), "1")
    assert not (tmp_path / "out").exists()


def test_enrichment_writes_its_results_and_leaves_other_rows(spark):
    products = spark.createDataFrame([(i, "pending", "old", ["k"], "updated", ["origin"], 5) for i in (1, 2, 3)],
                                     "product_id int, status string, refined_name string, keywords array<string>, change_type string, changed_fields array<string>, processing_time_ms bigint")
    outcomes = spark.createDataFrame([(1, True, "new", ["a", "b"], [("x", 3)]), (2, False, None, None, None)],
                                     "product_id int, success boolean, refined_name string, keywords array<string>, stages array<struct<stage:string,ms:int>>")
    got = {r.product_id: (r.status, r.refined_name, r.keywords, r.change_type, r.changed_fields, r.processing_time_ms) for r in lg.apply_outcomes(products, outcomes).collect()}
    assert got == {1: ("completed", "new", ["a", "b"], None, None, 3), 2: ("failed", "old", ["k"], "updated", ["origin"], 5), 3: ("pending", "old", ["k"], "updated", ["origin"], 5)}
