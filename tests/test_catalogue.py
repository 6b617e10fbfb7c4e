import random

import pytest
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.operators import ledger as lg
from wareloom.operators.catalogue import Catalogue, ConcurrentBatch
from wareloom.operators.runs import apply_uploads

TYPES = {"option_variants": "array<string>", "standard_options": "array<string>", "images_list": "array<string>"}
FIELDS = ", ".join(f"{f} {TYPES.get(f, 'int' if f.startswith('price_') and f != 'price_wholesale_raw' else 'string')}" for f in K.IMPORT_FIELDS)
UPLOAD = f"row_no int, user_id int, site_id int, product_code string, {FIELDS}"
STATE = f"product_id bigint, user_id int, site_id int, product_code string, {FIELDS}, status string, change_type string, image_status string, processed_image_path string"
MAPPINGS = "product_id bigint, platform_name string, category_id string, sync_status string, price_changed boolean, stock_changed boolean"
RUNS = "import_id string, user_id int, site_id int"


def product(user, site, code, price=1, **values):
    row = {"product_code": code, "original_name": f"name {code}", "price_wholesale": price, "wholesale_status": "판매중", "images_list": ["a"], **values}
    return {"user_id": user, "site_id": site, **{f: row.get(f) for f in ("product_code", *K.IMPORT_FIELDS)}}


def rows(spark, items, schema):
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schema)


def uploaded(spark, items):
    return rows(spark, [{**p, "row_no": i} for i, p in enumerate(items)], UPLOAD)


@pytest.fixture()
def stored(spark, tmp_path):
    items = [{**product(u, s, f"c{i}"), "product_id": u * 1000 + (s or 0) * 100 + i, "status": "completed"} for u, s in ((1, 1), (1, None), (2, 1)) for i in range(40)]
    mapped = [{"product_id": p["product_id"], "platform_name": "naver", "sync_status": "synced", "price_changed": False, "stock_changed": False} for p in items]
    mapped.append({"product_id": 77777, "platform_name": "naver", "sync_status": "synced", "price_changed": False, "stock_changed": False})  # of no product
    return Catalogue.create(rows(spark, items, STATE), rows(spark, mapped, MAPPINGS), f"{tmp_path}/catalogue", scopes=8, parts=4)


def snapshot(catalogue):
    return {name: sorted(map(str, getattr(catalogue, name)().drop("last_changed_at").collect())) for name in ("state", "mappings", "log")}


def test_only_touched_buckets_are_rewritten(spark, stored):
    first = stored.pointer()
    ledger = [product(1, 1, f"c{i}") for i in range(40)]
    ledger[7]["price_wholesale"] = 5
    run = spark.createDataFrame([("r", 1, 1)], RUNS)
    done = stored.apply(uploaded(spark, ledger), run, "one")
    assert len(done.rewritten) == 1 and done.compared == done.rewritten
    second = stored.pointer()
    moved = {b for b in second["tables"]["state"] if second["tables"]["state"][b] != first["tables"]["state"].get(b)}
    assert moved == {str(b) for b in done.rewritten}
    r = done.counters.first()
    assert (r.import_id, r.new_count, r.updated_count, r.removed_count, r.unchanged_count) == ("r", 0, 1, 0, 39)
    assert [(r.product_id, r.price_changed) for r in stored.mappings().filter("sync_status = 'pending_update'").collect()] == [(1107, True)]
    again = stored.apply(uploaded(spark, ledger), run, "two")
    assert (again.compared, again.rewritten) == ([], []) and again.counters.first().unchanged_count == 40
    assert again.changes.count() == 0 and stored.log().count() == 1


def test_a_batch_that_dies_leaves_the_old_catalogue(spark, stored, monkeypatch):
    before = snapshot(stored)
    upload, run = uploaded(spark, [product(1, 1, "c1", 9), product(1, 1, "fresh")]), spark.createDataFrame([("r", 1, 1)], RUNS)
    monkeypatch.setattr(Catalogue, "_switch", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        stored.apply(upload, run, "one")
    monkeypatch.undo()
    assert snapshot(stored) == before
    stored.apply(upload, run, "one")
    after = snapshot(stored)
    assert stored.log().groupBy("change_type").count().orderBy("change_type").collect() == [("new", 1), ("removed", 39), ("updated", 1)]
    stored.vacuum()
    assert snapshot(stored) == after
    with pytest.raises(ConcurrentBatch):
        stored.apply(upload, run, "one")
    with pytest.raises(ConcurrentBatch):
        stored._switch(stored.pointer())
    with pytest.raises(lg.RunRefused, match="without a run"):
        stored.apply(upload, spark.createDataFrame([("r", 2, 1)], RUNS), "two")
    assert snapshot(stored) == after


def test_batches_equal_the_flat_tables(spark, stored, tmp_path):
    """Random ledgers of three scopes, with rows without a code and an empty ledger, one after the other by both ways."""
    rng = random.Random(4)
    state, mappings = stored.state(), stored.mappings()
    for n in range(3):
        scopes = rng.sample([(1, 1), (1, None), (2, 1)], 2)
        items = [product(u, s, f"c{i}", rng.choice([1, 1, 1, 2])) for u, s in scopes[: 2 - (n == 1)] for i in rng.sample(range(50), 35)] + [product(*scopes[0], None)] * 2
        run = spark.createDataFrame([(f"r{n}-{k}", *s) for k, s in enumerate(scopes)], RUNS)
        upload = uploaded(spark, items)
        applied = apply_uploads(upload, state, mappings, run, f"{tmp_path}/flat", str(n))
        state, mappings = applied.state, applied.mappings
        stored.apply(upload, run, str(n))
    shown = lambda df, like: sorted(map(str, df.select([c for c in sorted(like.columns) if c != "last_changed_at"]).collect()))
    assert shown(state, stored.state()) == shown(stored.state(), stored.state())
    assert shown(mappings, stored.mappings()) == shown(stored.mappings(), stored.mappings())
    assert shown(applied.log, stored.log()) == shown(stored.log(), stored.log())


def test_results_go_into_the_mappings_of_their_buckets(spark, stored):
    results = spark.createDataFrame([(1101, "naver", "N1", 1), (1101, "naver", "N2", 2), (1102, "coupang", "C1", 1), (999999, "naver", "X", 1)], "product_id bigint, platform_name string, category_id string, seq int")
    touched = stored.update_mappings(results, "m")
    assert 1 <= len(touched) <= 2
    got = {(r.product_id, r.platform_name): (r.category_id, r.sync_status) for r in stored.mappings().filter(F.col("product_id").isin(1101, 1102, 999999, 77777)).collect()}
    assert got == {(1101, "naver"): ("N2", "synced"), (1102, "naver"): (None, "synced"), (1102, "coupang"): ("C1", "draft"), (77777, "naver"): (None, "synced")}
    assert stored.mappings().count() == 122
