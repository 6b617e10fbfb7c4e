import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wareloom.operators import snapshots as sn
from wareloom.streaming.stock_watch import COLUMNS, StockWatch

SCHEMA = "snapshot_id int, product_id int, captured_at timestamp_ntz, supplier_status string, supply_price int"


def brute_force(rows):
    """Row-by-row comparison with the stored predecessor."""
    last, out = {}, []
    for sid, pid, at, status, price in sorted(rows, key=lambda r: (r[2], r[0])):
        if pid in last:
            s0, p0 = last[pid]
            if s0 != status:
                kind = ("sold_out" if (s0, status) == ("available", "sold_out") else "restocked" if (s0, status) == ("sold_out", "available")
                        else "status_changed" if s0 and status else None)
                if kind:
                    out.append((sid, kind, s0, status))
            if p0 != price:
                out.append((sid, "price_changed", None if p0 is None else str(p0), None if price is None else str(price)))
        last[pid] = (status, price)
    return sorted(out, key=str)


def snapshots_of(n, hot=3, seed=1):
    """A third of all snapshots belong to one product; times repeat and span many buckets."""
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, hot if rnd.random() < 0.34 else rnd.randint(10, 30), start + dt.timedelta(minutes=rnd.randint(0, 5000)),
             rnd.choice(["available", "sold_out", "stopped", None, ""]), rnd.choice([None, 1, 2])) for i in range(n)]


def found(df):
    return sorted(((r.snapshot_id, r.change_type, r.previous_value, r.new_value) for r in df.collect()), key=str)


def test_changes_equal_brute_force_with_a_hot_product(spark):
    rows = snapshots_of(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (60, 3600, 10**9):
        assert found(sn.detect_changes(sn.with_previous(df, ["supplier_status", "supply_price"], bucket))) == brute_force(rows)


def test_hot_product_is_not_sorted_in_one_task(spark):
    df = spark.createDataFrame(snapshots_of(50), SCHEMA)
    plan = sn.with_previous(df, ["supply_price"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(product_id" in plan and "_bucket" in plan


def test_latest_breaks_ties_by_id(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, at, "a", 1), (2, 1, at, "b", 2), (3, 2, at, None, None)], SCHEMA)
    assert {r.product_id: r.snapshot_id for r in sn.latest(df).collect()} == {1: 2, 2: 3}


def test_stock_changes_per_sku(spark):
    df = spark.createDataFrame([({"A": 1, "B": 2}, {"A": 1, "C": 3})], "o map<string,int>, n map<string,int>")
    got = df.select(F.explode(sn.stock_changes(F.col("o"), F.col("n"))).alias("c")).collect()
    assert sorted((r.c.option_sku, r.c.previous_value, r.c.new_value) for r in got) == [("B", "2", None), ("C", None, "3")]


def test_products_take_last_known_values(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, 1, t(1), "sold_out", 5), (2, 1, t(2), None, 7), (3, 1, t(3), None, None)], SCHEMA)
    products = spark.createDataFrame([(1, "available", 1), (2, "available", 1)], "product_id int, supplier_status string, supply_price int")
    assert {r.product_id: (r.supplier_status, r.supply_price) for r in sn.apply_to_products(products, df).collect()} == {1: ("sold_out", 7), 2: ("available", 1)}


def test_pagination_stops_at_the_first_page_without_news(spark):
    links = spark.createDataFrame([("c", 1, 1, "/a"), ("c", 1, 2, "/b"), ("c", 2, 1, "/a"), ("c", 2, 2, "/b"), ("c", 3, 1, "/z"), ("d", 1, 1, "/a")],
                                  "category_id string, page int, ord int, url string")
    assert sorted((r.category_id, r.url) for r in sn.cut_pagination(links).collect()) == [("c", "/a"), ("c", "/b"), ("d", "/a")]


def test_colliding_category_ids_take_the_address(spark):
    rows = spark.createDataFrame([("s", 1, "http://x/list.html", "A"), ("s", 2, "http://y/list.html", "B")], "site string, ord int, url string, name string")
    assert sorted(r.category_id for r in sn.unique_category_ids(rows).collect()) == ["http://y/list.html", "list.html"]


def test_stream_over_several_batches_equals_batch(spark, tmp_path):
    rows = sorted(snapshots_of(400), key=lambda r: (r[2], r[0]))
    source = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    watch = StockWatch(spark, str(tmp_path / "watch"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).select(*COLUMNS)
    watch.start(stream).awaitTermination()
    assert watch.changes().select("batch").distinct().count() == 4
    assert found(watch.changes()) == brute_force(rows)


def test_rerun_of_a_batch_gives_the_same_rows(spark, tmp_path):
    rows = snapshots_of(60)
    watch = StockWatch(spark, str(tmp_path))
    batch = spark.createDataFrame(rows, SCHEMA)
    watch.process(batch, 0)
    watch.process(batch, 0)
    assert found(watch.changes()) == brute_force(rows)


def test_tree_of_any_depth_and_cycles(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, str(i)) for i in range(7)]
    nodes = spark.createDataFrame([*chain, ("orphan", "nowhere", "o")], "id string, parent_id string, name string")
    assert {r.id: r.depth for r in sn.flatten_tree(nodes).collect()} == {f"n{i}": i for i in range(7)}
    circle = spark.createDataFrame([*chain, ("a", "b", "a"), ("b", "a", "b")], "id string, parent_id string, name string")
    with pytest.raises(sn.CategoryCycle):
        sn.flatten_tree(circle)


STOCKED = SCHEMA + ", stock map<string,int>"


def test_stock_unknown_products_late_rows_and_product_update(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    products = spark.createDataFrame([(1, "available", 5), (2, None, None), (3, "stopped", 9)], "product_id int, supplier_status string, supply_price int")
    watch = StockWatch(spark, str(tmp_path), products, "stock", buckets=4)
    batches = [
        [(1, 1, at(0), "available", 10, {"a": 1}), (2, 9, at(0), "available", 1, None), (3, 2, at(1), "available", 3, None)],
        [(4, 1, at(5), "sold_out", None, {"a": 2, "b": 1}), (5, 1, at(3), "available", 10, {"a": 1})],
        [(6, 1, at(2), "stopped", 99, {"a": 7}), (7, 2, at(9), "available", 4, None)],
        [(8, 1, at(9), "available", None, {"a": 2, "b": 1})]]
    for n, rows in enumerate(batches):
        watch.process(spark.createDataFrame(rows, STOCKED), n)
    got = {(r.snapshot_id, r.change_type, r.previous_value, r.new_value, r.option_sku) for r in watch.changes().collect()}
    assert got == {(4, "sold_out", "available", "sold_out", None), (4, "price_changed", "10", None, None), (4, "stock_changed", "1", "2", "a"),
                   (4, "stock_changed", None, "1", "b"), (7, "price_changed", "3", "4", None), (8, "restocked", "sold_out", "available", None)}
    assert [r.snapshot_id for r in watch.late().collect()] == [6]
    after = {r.product_id: (r.supplier_status, r.supply_price) for r in watch.updated(products, 3).collect()}
    assert after == {1: ("available", 10), 2: ("available", 4), 3: ("stopped", 9)}


def test_a_lost_manifest_is_an_error(spark, tmp_path):
    watch = StockWatch(spark, str(tmp_path))
    with pytest.raises(Exception, match="manifest"):
        watch.process(spark.createDataFrame(snapshots_of(5), SCHEMA), 3)


def test_deep_trees_take_few_rounds(spark):
    n = 10000
    chain = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"), F.col("id").cast("string").alias("name"))
    depths = sn.to_roots(chain, most_rounds=15)
    assert depths.agg(F.max("depth"), F.count("*"), F.min("rooted")).first() == (n - 1, n, True)
    with pytest.raises(sn.CategoryCycle):
        sn.to_roots(chain, most_rounds=13)


def test_paths_of_random_trees(spark):
    rnd = random.Random(6)
    nodes = [(f"n{i}", f"n{rnd.randint(max(0, i - 3), i - 1)}" if i % 40 else None, f"name {i}") for i in range(200)] + [("lost", "nowhere", "l"), ("below", "lost", "b")]
    parent, name = {i: p for i, p, _ in nodes}, {i: n for i, _, n in nodes}

    def chain(i):
        return chain(parent[i]) + [i] if parent[i] else [i]

    got = {r.id: (r.depth, r.path, r.ancestors) for r in sn.flatten_tree(spark.createDataFrame(nodes, "id string, parent_id string, name string")).collect()}
    assert got == {i: (len(chain(i)) - 1, " > ".join(name[x] for x in chain(i)), chain(i)[:-1]) for i in parent if i not in ("lost", "below")}


def test_shallow_trees_are_walked_by_level(spark, monkeypatch):
    rnd = random.Random(8)
    rows, depth = [(None, None, "no id"), (-1, -2, "lost"), (-3, -1, "below")], {}
    for i in range(300):
        parent = rnd.choice([p for p, d in depth.items() if d < 5]) if i % 50 else None
        depth[i] = depth[parent] + 1 if i % 50 else 0
        rows.append((i, parent, rnd.choice([None, "", f"n{i}"])))
    schema = "id bigint, parent_id bigint, name string"
    show = lambda df: sorted(df.select("id", "parent_id", "depth", "path", "ancestors").collect())
    by_doubling = show(sn.flatten_tree(spark.createDataFrame(rows, schema), levels=0))
    assert len(by_doubling) == 300 and {r.id: r.depth for r in by_doubling} == depth
    assert show(sn.flatten_tree(spark.createDataFrame(rows[:1] + rows[3:], schema))) == by_doubling
    with pytest.raises(sn.CategoryCycle):
        sn.flatten_tree(spark.createDataFrame([*rows, (900, 901, "a"), (901, 900, "b"), (902, 900, "c")], schema))
    monkeypatch.setattr(sn, "to_roots", lambda waiting, carried=None, rounds=None: None if not carried and waiting.count() == 2 else pytest.fail("doubling"))
    assert show(sn.flatten_tree(spark.createDataFrame(rows, schema))) == by_doubling
