"""Product snapshots over time, change detection, monitoring read models, category trees."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions import urls as ur
from wareloom.functions.rows import explode_built
from wareloom.functions.text import lookup
from wareloom.session import checkpoint_folder, data_folder

CHANGE = "struct<change_type:string,previous_value:string,new_value:string,option_sku:string>"


def _order() -> Column:
    return F.struct("captured_at", "snapshot_id")


def latest(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per product, combined map-side; equal times are decided by snapshot id."""
    rest = [c for c in snapshots.columns if c != "product_id"]
    return snapshots.groupBy("product_id").agg(F.max_by(F.struct(*rest), _order()).alias("s")).select("product_id", "s.*")


def with_previous(snapshots: DataFrame, values: list[str], bucket_seconds: int = 3600) -> DataFrame:
    """Add ``previous``, the struct of ``values`` in the product's preceding snapshot; null for the first one.

    A product may own a large share of all snapshots, so no task sorts a whole product: rows are ordered within
    (product, time bucket), and only the last row of every bucket travels to the next one.
    """
    keys = ["product_id", "_bucket"]
    micros = F.unix_micros(F.col("captured_at").cast("timestamp"))
    rows = snapshots.withColumns({
        "_bucket": F.floor(micros / (bucket_seconds * 1_000_000)), "_row": F.struct(*values, F.lit(True).alias("_present"))})
    within = Window.partitionBy(*keys).orderBy("captured_at", "snapshot_id")
    across = Window.partitionBy("product_id").orderBy("_bucket")
    ends = rows.groupBy(*keys).agg(F.max_by("_row", _order()).alias("_end"))
    carried = ends.withColumn("_carried", F.lag("_end").over(across)).select(*keys, "_carried")
    joined = rows.withColumn("_before", F.lag("_row").over(within)).join(carried, keys)
    return joined.withColumn("previous", F.coalesce("_before", "_carried")).drop("_bucket", "_row", "_before", "_carried", "_end")


def _change(kind, old, new, sku=None) -> Column:
    text = lambda c: c.cast("string")
    sku = F.lit(None).cast("string") if sku is None else sku
    return F.struct(text(kind).alias("change_type"), text(old).alias("previous_value"), text(new).alias("new_value"), sku.alias("option_sku"))


def status_change(old: Column, new: Column) -> Column:
    """sold_out, restocked or status_changed; nothing when either side is blank."""
    kind = (F.when((old == "available") & (new == "sold_out"), F.lit("sold_out"))
            .when((old == "sold_out") & (new == "available"), F.lit("restocked"))
            .when((old != "") & (new != ""), F.lit("status_changed")))
    return F.when(~old.eqNullSafe(new) & kind.isNotNull(), _change(kind, old, new))


def price_change(old: Column, new: Column) -> Column:
    return F.when(~old.eqNullSafe(new), _change(F.lit("price_changed"), old, new))


def stock_changes(old: Column, new: Column) -> Column:
    """One entry per sku whose quantity differs between two stock maps; a missing sku counts as null."""
    none = F.create_map().cast("map<string,int>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    skus = F.array_union(F.map_keys(old), F.map_keys(new))
    every = F.transform(skus, lambda s: F.when(
        ~F.try_element_at(old, s).eqNullSafe(F.try_element_at(new, s)),
        _change(F.lit("stock_changed"), F.try_element_at(old, s), F.try_element_at(new, s), s)))
    return F.array_compact(every)


def detect_changes(pairs: DataFrame, stock: str | None = None) -> DataFrame:
    """Change rows from snapshots that carry ``previous``; a first snapshot yields none."""
    old = lambda c: F.col(f"previous.{c}")
    found = F.array_compact(F.array(
        status_change(old("supplier_status"), F.col("supplier_status")), price_change(old("supply_price"), F.col("supply_price"))))
    if stock:
        found = F.concat(found, stock_changes(old(stock), F.col(stock)))
    with_old = pairs.filter(F.col("previous._present"))
    rows = explode_built(with_old, found, "snapshot_id", "product_id", "captured_at", name="c")
    return rows.select("snapshot_id", "product_id", "captured_at", "c.*")


def known_only(snapshots: DataFrame, products: DataFrame) -> DataFrame:
    """Snapshots of products that were crawled before."""
    return snapshots.join(products.select("product_id"), "product_id", "left_semi")


def apply_to_products(products: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Products with the last non-null status and the last non-null price seen."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("captured_at", "snapshot_id", c)))[c]
    seen = snapshots.groupBy("product_id").agg(last("supplier_status").alias("_status"), last("supply_price").alias("_price"))
    joined = products.join(seen, "product_id", "left")
    return joined.withColumns({
        "supplier_status": F.coalesce("_status", "supplier_status"), "supply_price": F.coalesce("_price", "supply_price"),
    }).drop("_status", "_price")


def baseline(crawled: DataFrame, run_id: str, captured_at: Column) -> DataFrame:
    """One snapshot per product of a full crawl, so that the first re-check has something to compare with."""
    return crawled.select("product_id", F.lit(run_id).alias("crawl_run_id"), captured_at.alias("captured_at"), "supplier_status", "supply_price")


def cut_pagination(links: DataFrame) -> DataFrame:
    """Product links up to the first listing page (per category) that shows nothing new, each link once."""
    first = links.groupBy("category_id", "url").agg(F.min(F.struct("page", "ord")).alias("f"))
    firsts = first.select("category_id", "url", "f.page", "f.ord")
    pages = links.select("category_id", "page").distinct()
    stale = pages.join(firsts.select("category_id", "page"), ["category_id", "page"], "left_anti")
    stop = stale.groupBy("category_id").agg(F.min("page").alias("stop"))
    kept = firsts.join(stop, "category_id", "left")
    return kept.filter(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")


def event_feed(changes: DataFrame, products: DataFrame, suppliers: DataFrame, supplier_id=None, change_type: str | None = None) -> DataFrame:
    """Change events with product and supplier, newest first."""
    if change_type:
        changes = changes.filter(F.col("change_type") == change_type)
    if supplier_id is not None:
        suppliers = suppliers.filter(F.col("supplier_id") == supplier_id)
    joined = changes.join(products, "product_id").join(suppliers, "supplier_id")
    return joined.select(
        "change_id", "detected_at", "supplier_id", "supplier_name", "product_id", "supplier_product_code", "raw_product_name", "change_type",
        lookup(F.col("change_type"), K.CHANGE_LABELS, F.col("change_type")).alias("change_label"),
        F.coalesce("previous_value", F.lit("")).alias("previous_value"), F.coalesce("new_value", F.lit("")).alias("new_value"),
        F.coalesce("acknowledged", F.lit(False)).alias("acknowledged")).orderBy(F.desc("detected_at"), "change_id")


def monitor_metrics(feed: DataFrame, runs: DataFrame, supplier_id=None) -> DataFrame:
    """One row: unread, sold-out, restocked and price events, failed checks."""
    checks = runs if supplier_id is None else runs.filter(F.col("supplier_id") == supplier_id)
    failed = checks.filter((F.col("run_type") == "stock_check") & (F.col("status") == "failed")).agg(F.count(F.lit(1)).alias("failed_checks"))
    n = lambda kind: F.count_if(F.col("change_type") == kind)
    events = feed.agg(F.count_if(~F.col("acknowledged")).alias("unread"), n("sold_out").alias("sold_out"),
                      n("restocked").alias("restocked"), n("price_changed").alias("price_changed"))
    return events.withColumn("failed_checks", failed.scalar())


def check_schedule(suppliers: DataFrame, runs: DataFrame) -> DataFrame:
    """Per supplier: latest check, error of the latest failed check, and when the next one is due."""
    checks = runs.filter(F.col("run_type") == "stock_check")
    order = F.struct("started_at", "run_id")
    failing = (F.col("status") == "failed") | F.col("error").isNotNull()
    facts = checks.groupBy("supplier_id").agg(
        F.max_by(F.coalesce("finished_at", "started_at"), order).alias("last_check_at"),
        F.max(F.when(failing, F.struct("started_at", "run_id", "error")))["error"].alias("latest_failure"))
    joined = suppliers.join(facts, "supplier_id", "left")
    due = F.col("last_check_at") + F.make_dt_interval(F.lit(0), F.col("interval_hours"))
    return joined.select("supplier_id", "supplier_name", "monitor_enabled", "interval_hours", "last_check_at",
                         F.when(F.col("monitor_enabled"), due).alias("next_check_at"), F.coalesce("latest_failure", F.lit("")).alias("latest_failure"))


def acknowledge(changes: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Mark the listed unread events as read at one time."""
    marked = changes.join(ids.select("change_id", F.lit(True).alias("_hit")), "change_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("acknowledged")
    return marked.withColumns({"acknowledged_at": F.when(hit, at), "acknowledged": F.col("acknowledged") | hit}).drop("_hit")


def last_runs(suppliers: DataFrame, runs: DataFrame) -> DataFrame:
    """Suppliers with the start of their last run, null if there was none."""
    last = runs.groupBy("supplier_id").agg(F.max("started_at").alias("last_crawl_at"))
    return suppliers.join(last, "supplier_id", "left").orderBy("supplier_name")


class CategoryCycle(ValueError):
    """Some categories are their own ancestors."""


def to_roots(nodes: DataFrame, carried: dict[str, Column] | None = None, most_rounds: int | None = None) -> DataFrame:
    """``(id, depth, rooted, ...)`` of every node by pointer doubling: each round every open node jumps to where its target points.

    A node's pointer covers twice as many levels after each round, so a tree of depth d takes about log2(d) + 1 of them, and only nodes that have not
    arrived take part. ``carried`` are arrays of the way to a node, which are joined in the same jumps. ``rooted`` is false below a missing parent.
    Nodes still on their way after ``most_rounds`` (by default as many as a chain of all nodes needs) are on or below a cycle, which is refused.
    Every round is written to the shared folder.
    """
    checkpoint_folder(nodes.sparkSession)
    carried = carried or {}
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    placed = nodes.join(known, "parent_id", "left")
    up = F.when(F.col("_known"), F.col("parent_id"))
    rows = placed.select("id", up.alias("up"), up.isNotNull().cast("int").alias("depth"), F.when(F.col("parent_id").isNull(), F.lit(True)).when(up.isNull(), F.lit(False)).alias("rooted"),
                         *[c.alias(name) for name, c in carried.items()]).checkpoint()
    most_rounds = most_rounds or max(1, rows.count()).bit_length() + 1
    for _ in range(most_rounds):
        going = rows.filter("up IS NOT NULL")
        if going.isEmpty():
            return rows.drop("up")
        targets = rows.select(F.col("id").alias("_id"), F.struct("up", "depth", "rooted", *carried).alias("t"))
        jumped = going.join(targets, going["up"] == targets["_id"]).select(
            "id", "t.up", (F.col("depth") + F.col("t.depth")).alias("depth"), "t.rooted", *[F.concat(F.col(f"t.{c}"), F.col(c)).alias(c) for c in carried])
        rows = rows.filter("up IS NULL").unionByName(jumped).checkpoint()
    if circular := rows.filter("up IS NOT NULL").select("id").limit(5).collect():
        raise CategoryCycle(f"categories in or below a cycle: {', '.join(str(r.id) for r in circular)}")
    return rows.drop("up")


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder; columns compress better there than a checkpoint's rows."""
    path = data_folder(rows.sparkSession, f"{name}-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _by_level(nodes: DataFrame, levels: int) -> DataFrame | None:
    """``(id, parent_id, depth, path, ancestors)`` from the roots down, for nodes with distinct ids; ``None`` if the tree is deeper than ``levels``.

    Each level meets the nodes that wait for their parent; only those travel again, without paths. Those that wait when a level has no rows are
    below a missing parent, or on or below a cycle, which is refused.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    root = F.col("parent_id").isNull()
    waiting = nodes.filter(~root)
    level = nodes.filter(root).select("id", "parent_id", F.lit(0).alias("depth"), F.col("name").alias("path"), F.array().cast(f"array<{kind}>").alias("ancestors"))
    found = [level]
    for depth in range(1, levels + 2):
        above = level.select(F.col("id").alias("_id"), F.struct("path", F.array_append("ancestors", F.col("id")).alias("ancestors")).alias("_above"))
        met = _kept(waiting.join(above, F.col("parent_id") == F.col("_id"), "left").drop("_id"), "tree-level")
        waiting = met.filter("_above IS NULL").select("id", "parent_id", "name")
        path = F.coalesce(F.concat("_above.path", F.lit(" > "), "name"), F.col("_above.path"), F.col("name"))  # a missing name is left out
        level = met.filter("_above IS NOT NULL").select("id", "parent_id", F.lit(depth).alias("depth"), path.alias("path"), F.col("_above.ancestors").alias("ancestors"))
        if level.isEmpty():
            if not waiting.isEmpty():
                to_roots(waiting)
            out = found[0]
            for part in found[1:]:
                out = out.unionByName(part)
            return out.filter("id IS NOT NULL").withColumn("path", F.coalesce("path", F.lit("")))
        found.append(level)
    return None


def flatten_tree(nodes: DataFrame, levels: int = 8) -> DataFrame:
    """``(id, parent_id, depth, path, ancestors)`` of a category tree of any depth.

    Nodes below a missing parent are left out; a cycle is refused, before any paths are put together along it. Trees of few ``levels`` are walked
    from the roots down, in which every path travels once; deeper ones, and those whose ids repeat, by pointer doubling.
    """
    nodes = _kept(nodes.select("id", "parent_id", "name"), "tree")
    if nodes.groupBy("id").count().filter("count > 1").isEmpty() and (tree := _by_level(nodes, levels)) is not None:
        return tree
    deepest = to_roots(nodes).agg(F.max("depth")).first()[0] or 0
    above = F.when(F.col("_known"), F.array("parent_id")).otherwise(F.array().cast("array<string>")).cast(f"array<{nodes.schema['id'].dataType.simpleString()}>")
    whole = to_roots(nodes, {"names": F.array("name"), "ancestors": above}, deepest.bit_length() + 1)
    rows = whole.filter("rooted").select("id", "depth", F.array_join("names", " > ").alias("path"), "ancestors")
    return nodes.select("id", "parent_id").join(rows, "id")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs; a node has at most as many ancestors as the tree has levels."""
    return tree.select(F.explode("ancestors").alias("ancestor_id"), F.col("id").alias("descendant_id"))


def unique_category_ids(entries: DataFrame) -> DataFrame:
    """Category id from the address; on a collision within a site every entry but the first takes its address as id."""
    rows = entries.withColumn("category_id", ur.category_id(F.col("url"), F.col("name")))
    first = rows.groupBy("site", "category_id").agg(F.min("ord").alias("_first"))
    joined = rows.join(first, ["site", "category_id"])
    return joined.withColumn("category_id", F.when(F.col("ord") == F.col("_first"), F.col("category_id")).otherwise(F.col("url"))).drop("_first")
