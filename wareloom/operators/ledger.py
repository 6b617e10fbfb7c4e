"""Change ledger: what an upload changed against the stored catalogue, and the tables that follow from it.

A product belongs to an owner and a site (``user_id, site_id``; no site is a scope of its own) and is matched by its code within
them. One batch may hold the uploads of many owners and sites: ``runs(import_id, user_id, site_id)`` has one row per upload, at most one per
scope. Frames without these columns are taken as one scope.

Rows without a product code never match stored rows; in the keyed join they are spread by their own ids, so they cannot pile up in
one partition. Gates (``duplicate_codes``, ``invalid_status_rows``) are tables; a run with a non-empty gate is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.rows import explode_built
from wareloom.functions.skew import join_per_key, salted
from wareloom.functions.text import is_blank

SCOPE = ("user_id", "site_id")


class RunRefused(ValueError):
    """A gate found rows that forbid the whole run."""


def scoped(rows: DataFrame, site_given: bool = True) -> DataFrame:
    """Rows with owner and site; a frame without them is one owner's, of one site or (``site_given`` false) of none."""
    missing = {"user_id": F.lit(None).cast("bigint"), "site_id": F.lit(0 if site_given else None).cast("bigint")}
    return rows.withColumns({c: v for c, v in missing.items() if c not in rows.columns})


def scope_key(user_id: Column, site_id: Column) -> Column:
    """One text per scope, never null: no site is a scope of its own."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    return F.concat_ws("/", part(user_id), part(site_id))


def duplicate_codes(parsed: DataFrame) -> DataFrame:
    """Codes that occur more than once in the upload of an owner and site."""
    keys = [c for c in SCOPE if c in parsed.columns]
    coded = parsed.filter(~is_blank(F.col("product_code")))
    return coded.groupBy("product_code", *keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def invalid_status_rows(parsed: DataFrame) -> DataFrame:
    """Rows whose status spelling is unknown, with the raw value."""
    bad = F.filter("warnings", lambda w: w["code"] == "invalid_wholesale_status")
    return explode_built(parsed, bad, "site", "row_no", name="w").select("site", "row_no", F.col("w.raw_value").alias("raw_value"))


def refuse_if_any(gate: DataFrame, reason: str, show: int = 10) -> None:
    """Raise when a gate has rows, naming at most ``show`` of them."""
    sample = [str(r[0]) for r in gate.limit(show + 1).collect()]
    if sample:
        raise RunRefused(f"{reason}: {', '.join(sample[:show])}{' ...' if len(sample) > show else ''}")


def refuse_first(gates: dict[str, DataFrame], show: int = 10) -> None:
    """``refuse_if_any`` for several gates in one job; the first reason that has rows is told."""
    parts = [df.select(F.lit(reason).alias("reason"), F.col(df.columns[0]).cast("string").alias("value")).limit(show + 1) for reason, df in gates.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    found = rows.collect()
    for reason in gates:
        sample = [r.value for r in found if r.reason == reason]
        if sample:
            raise RunRefused(f"{reason}: {', '.join(map(str, sample[:show]))}{' ...' if len(sample) > show else ''}")


def compared_fields(*frames: DataFrame, fields: tuple[str, ...] | None = None) -> list[str]:
    """The fields to compare: all product fields, or those named. A frame that lacks one is refused."""
    wanted = [f for f in K.IMPORT_FIELDS if fields is None or f in fields]
    absent = [f for f in wanted if any(f not in df.columns for df in frames)]
    if absent:
        raise ValueError(f"fields missing from upload or catalogue: {', '.join(absent)}")
    return wanted


def changed_fields(fields: list[str], old: str = "old", new: str = "new") -> Column:
    """Names of the fields that differ, in reporting order; nulls compare as values."""
    return F.array_compact(F.array(*[
        F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields]))


def field_changes(changed: Column, fields: list[str], old: str = "old", new: str = "new") -> Column:
    """``map<field, struct<old, new>>`` of the changed fields; nested fields record only that they changed."""
    none = F.lit(None).cast("string")

    def entry(f):
        pair = (none, none) if f in K.NESTED_FIELDS else (F.col(f"{old}.{f}").cast("string"), F.col(f"{new}.{f}").cast("string"))
        return F.struct(F.lit(f).alias("key"), F.struct(pair[0].alias("old"), pair[1].alias("new")).alias("value"))

    every = F.array(*[entry(f) for f in fields])
    return F.map_from_entries(F.filter(every, lambda e: F.array_contains(changed, e["key"])))


def needs_reprocess(old_status: Column, changed: Column) -> Column:
    """Not finished before, or a field changed that enrichment depends on."""
    touched = F.arrays_overlap(changed, F.array(*[F.lit(f) for f in K.REPROCESS_FIELDS]))
    return (F.size(changed) > 0) & (~old_status.eqNullSafe(F.lit("completed")) | touched)


def scopes_of(upload: DataFrame, import_id: str | None = None) -> DataFrame:
    """One run per scope that occurs in the upload."""
    return upload.select(*SCOPE).distinct().withColumn("import_id", F.lit(import_id).cast("string"))


def diff(upload: DataFrame, state: DataFrame, site_given: bool = True, runs: DataFrame | None = None,
         import_id: str | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Classify every uploaded and every stored row in one full outer join on owner, site and code.

    Result: ``user_id, site_id, product_code, product_id, import_id, old, new, change_type, changed_fields, field_changes, reprocess``;
    ``change_type`` is new, updated, unchanged, removed, or kept (stored, not uploaded, nothing to do). ``old`` and ``new`` are row
    structs. Stored products of a scope with a site and a run are removed when the run lacks them; ``runs`` names the runs, also those
    whose ledger is empty; without it every scope of the upload is one run. New products get an id from their natural key, those without a code
    from run and row number.
    """
    compared = compared_fields(upload, state, fields=fields)
    new_row = F.struct(*[F.col(f"`{c}`") for c in upload.columns]).alias("new")
    old_row = F.struct(*[F.col(f"`{c}`") for c in state.columns]).alias("old")
    upload, state = scoped(upload, site_given), scoped(state, site_given)
    runs = (scopes_of(upload, import_id) if runs is None else scoped(runs, site_given)).select(
        scope_key(F.col("user_id"), F.col("site_id")).alias("_scope"), F.col("import_id").alias("_run"), F.lit(True).alias("_in_run"))
    blank = is_blank(F.col("product_code"))

    plain = [f for f in compared if f not in K.NESTED_FIELDS]

    def keyed(rows: DataFrame, row: Column, side: str) -> DataFrame:
        """Rows with their scope and its run, if it has one; an owner with very many rows is spread by salt, rows without a code by ``_own``."""
        code = F.when(~blank, F.col("product_code"))
        own = F.coalesce(*[F.col(c).cast("string") for c in ("row_no", "product_id") if c in rows.columns], F.xxhash64(F.lit(0), *plain).cast("string"))
        keys = rows.select(*SCOPE, code.alias("code"), row, scope_key(F.col("user_id"), F.col("site_id")).alias("_scope"), F.when(blank, own).otherwise(F.lit("")).alias("_own"))
        found = join_per_key(salted(keys, ["code", "_own"]), runs, ["_scope"], "left")
        return found.select(*[F.col(c).alias(f"{side}_{c}") for c in ("_scope", "code", "_own", *SCOPE, "_run", "_in_run")], {"n": "new", "o": "old"}[side])

    # A code that is null equals none, so rows without one come out alone; each side is read once.
    same = [F.col(f"n_{c}") == F.col(f"o_{c}") for c in ("_scope", "code", "_own")]
    matched = keyed(upload, new_row, "n").join(keyed(state, old_row, "o"), same, "full_outer")
    either = lambda c: F.when(F.col("new").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    rows = matched.select("old", "new", *[either(c) for c in (*SCOPE, "code", "_run", "_in_run")])

    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    rows = rows.withColumn("_diff", F.when(both, changed_fields(compared)))
    gone = (F.col("new").isNull() & F.col("code").isNotNull() & F.col("site_id").isNotNull() & F.coalesce("_in_run", F.lit(False))
            & ~F.col("old.change_type").eqNullSafe(F.lit("removed")))
    kind = (F.when(F.col("old").isNull(), F.lit("new"))
            .when(both & (F.size("_diff") > 0), F.lit("updated")).when(both, F.lit("unchanged"))
            .when(gone, F.lit("removed")).otherwise(F.lit("kept")))
    rows = rows.withColumn("change_type", kind)
    removed = F.col("change_type") == "removed"
    removal = F.create_map(F.lit("wholesale_status"), F.struct(
        F.col("old.wholesale_status").alias("old"), F.lit(K.DISCONTINUED_STATUS).alias("new")))
    row_no = F.col("new.row_no") if "row_no" in upload.columns else F.lit(None)
    return rows.select(
        *SCOPE, F.coalesce("new.product_code", "old.product_code").alias("product_code"),
        F.coalesce(F.col("old.product_id").cast("bigint"), new_product_id(F.col("user_id"), F.col("site_id"), F.col("code"), F.col("_run"), row_no)).alias("product_id"),
        F.col("_run").alias("import_id"), "old", "new", "change_type",
        F.when(removed, F.array(F.lit("wholesale_status"))).otherwise(F.coalesce("_diff", F.array().cast("array<string>"))).alias("changed_fields"),
        F.when(F.col("change_type") == "updated", field_changes(F.col("_diff"), compared)).when(removed, removal).alias("field_changes"),
        F.when(F.col("change_type") == "new", F.lit(True)).otherwise(
            (F.col("change_type") == "updated") & needs_reprocess(F.col("old.status"), F.col("_diff"))).alias("reprocess"))


def new_product_id(user_id: Column, site_id: Column, code: Column, import_id: Column, row_no: Column) -> Column:
    """60 bits of the MD5 of owner, site and code; of owner, site, run and row for a product without a code."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    coded = F.concat_ws("/", part(user_id), part(site_id), F.lit("code"), code)
    bare = F.concat_ws("/", part(user_id), part(site_id), F.lit("row"), part(import_id), part(row_no))
    return F.conv(F.substring(F.md5(F.when(code.isNull(), bare).otherwise(coded)), 1, 15), 16, 10).cast("bigint")


def discontinued(state: DataFrame, upload: DataFrame) -> DataFrame:
    """Stored, coded, not yet removed products of an uploaded site that their scope's upload lacks."""
    keys = lambda df: scoped(df).withColumn("_scope", scope_key(F.col("user_id"), F.col("site_id")))
    given = keys(upload)
    codes = given.filter(~is_blank(F.col("product_code"))).select("_scope", "product_code")
    stored = keys(state)
    open_rows = stored.filter(~is_blank(F.col("product_code")) & F.col("site_id").isNotNull() & ~F.col("change_type").eqNullSafe(F.lit("removed")))
    uploaded = join_per_key(salted(open_rows, ["product_code"]), given.select("_scope").distinct(), ["_scope"]).drop("_salt")
    return uploaded.join(codes, ["_scope", "product_code"], "left_anti").select(*state.columns)


def change_rows(changes: DataFrame) -> DataFrame:
    """One row per changed field."""
    pairs = F.transform("changed_fields", lambda f: F.struct(f.alias("field"), F.try_element_at("field_changes", f).alias("v")))
    rows = changes.filter(F.col("change_type").isin("updated", "removed")).select(*SCOPE, "product_code", "change_type", F.posexplode(pairs).alias("pos", "c"))
    return rows.select(*SCOPE, "product_code", "change_type", (F.col("pos") + 1).alias("position"), F.col("c.field").alias("field"),
                       F.col("c.v.old").alias("old_value"), F.col("c.v.new").alias("new_value"))


def image_reset(changes: DataFrame) -> Column:
    """Whether the processed image of an updated product is void."""
    return F.array_contains("changed_fields", "images_list")


def propagate(mappings: DataFrame, changes: DataFrame, at: Column | None = None) -> DataFrame:
    """Next market mappings: those of updated and removed products wait for an update; flags are only ever set.

    ``last_changed_at`` of those becomes ``at`` (the run's time).
    """
    touched = changes.filter(F.col("change_type").isin("updated", "removed"))
    marks = touched.select(
        "product_id", F.lit(True).alias("_hit"),
        F.arrays_overlap("changed_fields", F.array(*[F.lit(f) for f in K.PRICE_FIELDS])).alias("_price"),
        F.array_contains("changed_fields", "wholesale_status").alias("_stock"))
    joined = mappings.join(marks, "product_id", "left")
    stamp = F.col("last_changed_at") if "last_changed_at" in mappings.columns else F.lit(None).cast("timestamp")
    return joined.withColumns({
        "sync_status": F.when(F.col("_hit"), F.lit("pending_update")).otherwise(F.col("sync_status")),
        "price_changed": F.col("price_changed") | F.coalesce("_price", F.lit(False)),
        "stock_changed": F.col("stock_changed") | F.coalesce("_stock", F.lit(False)),
        "last_changed_at": F.when(F.col("_hit"), F.current_timestamp() if at is None else at).otherwise(stamp),
    }).drop("_hit", "_price", "_stock")


def change_log(changes: DataFrame, import_id: str | None = None) -> DataFrame:
    """One log row per new, updated or removed product, with its run and the name it had at that time."""
    logged = changes.filter(F.col("change_type").isin("new", "updated", "removed"))
    run = F.col("import_id") if import_id is None else F.lit(import_id)
    return logged.select(
        run.alias("import_id"), *SCOPE, "product_id", "product_code",
        F.coalesce("new.original_name", "old.original_name").alias("original_name"), "change_type", "changed_fields", "field_changes")


def counters(changes: DataFrame, start_processing: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Summary of the batch, or (``by`` import_id, owner, site) of each run: counts per class, rows to reprocess, status."""
    n = lambda kind: F.count_if(F.col("change_type") == kind)
    figures = (n("new").alias("new_count"), n("updated").alias("updated_count"), n("removed").alias("removed_count"),
               n("unchanged").alias("unchanged_count"), F.count_if("reprocess").alias("reprocess_count"))
    done = changes.filter(F.col("import_id").isNotNull()).groupBy(*by).agg(*figures) if by else changes.agg(*figures)
    status = (F.when(F.col("reprocess_count") == 0, F.lit("completed")).otherwise(F.lit("pending"))
              if start_processing else F.lit("imported"))
    return done.withColumn("status", status)


def next_state(changes: DataFrame, import_id: str | None = None) -> DataFrame:
    """The catalogue after the run: the stored columns and the run's, with uploaded values where rows are new or updated."""
    old_columns, new_columns = changes.schema["old"].dataType.names, changes.schema["new"].dataType.names
    fields = [f for f in (*K.IMPORT_FIELDS, "warnings", "raw_metadata") if f in old_columns and f in new_columns]
    kind = F.col("change_type")
    fresh = kind.isin("new", "updated")
    changed = kind.isin("new", "updated", "removed")
    stored = lambda c, as_type: F.col(f"old.{c}") if c in old_columns else F.lit(None).cast(as_type)
    taken = {f: F.when(fresh, F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")) for f in fields}
    taken["wholesale_status"] = F.when(kind == "removed", F.lit(K.DISCONTINUED_STATUS)).otherwise(taken["wholesale_status"])
    reset = (kind == "updated") & image_reset(changes)
    run = F.col("import_id") if import_id is None else F.lit(import_id)
    flags = {
        "status": F.when(F.col("reprocess"), F.lit("pending")).otherwise(F.col("old.status")),
        "change_type": F.when(changed, kind).otherwise(F.col("old.change_type")),
        "processed_image_path": F.when(~reset, F.col("old.processed_image_path")),
        "image_status": F.when(reset | (kind == "new"), F.lit("not_started")).otherwise(F.col("old.image_status")),
        "import_id": F.when(fresh, run).otherwise(stored("import_id", "string").cast("string")),
        "changed_fields": F.when(changed, F.col("changed_fields")).otherwise(stored("changed_fields", "array<string>")),
        "field_changes": F.when(changed, F.col("field_changes")).otherwise(stored("field_changes", "map<string,struct<old:string,new:string>>")),
    }
    own = {*fields, *flags, *SCOPE, "product_code", "product_id"}
    others = [F.col(f"old.{c}").alias(c) for c in old_columns if c not in own]
    return changes.select(
        "product_id", *SCOPE, "product_code", *[c.alias(f) for f, c in taken.items()], *[c.alias(f) for f, c in flags.items()], *others)


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key, by map-side combining aggregation rather than a per-key sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def one_per_key(rows: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """Keys and a struct of the values of the last row by ``seq``, ties and tables without it by the values themselves (nulls first).

    Arrays of structs order by their elements, so every row type here compares; the aggregate combines before its shuffle.
    """
    order = ["seq"] if "seq" in rows.columns else []
    value = F.struct(*values)
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order, *values)).alias(name))


def upsert_crawled(crawled: DataFrame, products: DataFrame, keys=("supplier_id", "supplier_product_code"), order: str = "seq") -> DataFrame:
    """Crawled rows over stored products, the last write of a run winning; stored rows that were not seen stay."""
    keys = list(keys)
    latest = last_per_key(crawled, keys, order).drop(order)
    values = [c for c in latest.columns if c not in keys]
    renamed = latest.select(*keys, F.struct(*values).alias("n"), F.lit(True).alias("seen"))
    stored = [c for c in products.columns if c not in keys and c not in values]
    out = products.withColumn("stored", F.lit(True)).join(renamed, keys, "full_outer")
    return out.select(
        *keys, *stored, *[F.when(F.col("seen"), F.col(f"n.{c}")).otherwise(products[c]).alias(c) if c in products.columns
                          else F.col(f"n.{c}").alias(c) for c in values],
        F.coalesce("seen", F.lit(False)).alias("touched"), F.col("stored").isNull().alias("is_new"))


def replace_options(options: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "product_id") -> DataFrame:
    """Options of touched products are replaced as a whole, all others stay."""
    return options.join(touched.select(key), key, "left_anti").unionByName(fresh)


def apply_outcomes(products: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Enrichment results: success fills fields and clears the change marks, failure keeps them; products without a result stay as they are.

    ``outcomes``: ``product_id, success, refined_name, keywords, stages array<struct<stage, ms>>`` and, optionally, ``warnings array<string>``
    of the enrichment, which are laid beside the supplier's, and ``seq``. Of several outcomes of a product the last by ``seq`` counts, or without it
    a success before a failure and then the largest values.
    """
    optional = [c for c in ("warnings",) if c in outcomes.columns]
    values = ["success", "refined_name", "keywords", "stages", *optional]
    o = one_per_key(outcomes.filter(F.col("product_id").isNotNull()), ["product_id"], values, "o")
    won, lost = F.coalesce("o.success", F.lit(False)), ~F.coalesce("o.success", F.lit(True))
    spent = F.aggregate("o.stages", F.lit(0).cast("bigint"), lambda acc, s: acc + F.coalesce(s["ms"], F.lit(0)))
    stored = lambda c, kind: F.col(c) if c in products.columns else F.lit(None).cast(kind)
    joined = products.join(o, "product_id", "left")
    values = {
        "status": F.when(won, F.lit("completed")).when(lost, F.lit("failed")).otherwise(F.col("status")),
        "refined_name": F.when(won, F.col("o.refined_name")).otherwise(F.col("refined_name")),
        "keywords": F.when(won, F.col("o.keywords")).otherwise(stored("keywords", "array<string>")),
        "change_type": F.when(~won, F.col("change_type")),
        "changed_fields": F.when(~won, stored("changed_fields", "array<string>")),
        "field_changes": F.when(~won, stored("field_changes", "map<string,struct<old:string,new:string>>")),
        "processing_time_ms": F.when(won, spent).otherwise(stored("processing_time_ms", "bigint").cast("bigint")),
    }
    if optional:
        none = F.array().cast("array<string>")
        values["supplier_warnings"] = stored("supplier_warnings", "array<string>")
        merged = F.array_distinct(F.concat(F.coalesce(values["supplier_warnings"], none), F.coalesce("o.warnings", none)))
        values["warnings"] = F.when(won, merged).otherwise(stored("warnings", "array<string>"))
    return joined.withColumns(values).drop("o")


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """Successes, failures and the run status: failed only when everything failed."""
    totals = outcomes.agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failed_count"))
    return totals.withColumn("status", F.when((F.col("success_count") == 0) & (F.col("failed_count") > 0), F.lit("failed")).otherwise(F.lit("completed")))


def ensure_mappings(mappings: DataFrame, results: DataFrame) -> DataFrame:
    """Get or create the (product, platform) mapping of every result and write the category found, and its attributes, into it.

    A pair has one mapping: of several results for it the last by ``seq`` counts, or without that column the one of largest values.
    """
    values = [c for c in ("category_id", "category_path", "mapped_attributes") if c in results.columns]
    r = one_per_key(results, ["product_id", "platform_name"], values, "r")
    joined = mappings.withColumn("_stored", F.lit(True)).join(r, ["product_id", "platform_name"], "full_outer")

    def pick(c):
        stored = F.col(c) if c in mappings.columns else F.lit(None).cast(results.schema[c].dataType)
        return F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(stored).alias(c)

    others = [c for c in mappings.columns if c not in ("product_id", "platform_name", "sync_status", *values)]
    return joined.select("product_id", "platform_name", *[pick(c) for c in values],
                         F.when(F.col("_stored").isNull(), F.lit("draft")).otherwise(F.col("sync_status")).alias("sync_status"), *others)


def select_work(products: DataFrame, ids: DataFrame | None = None, import_id=None) -> DataFrame:
    """Products to process: the given ids, or those of a run that are not completed."""
    if ids is not None:
        return products.join(ids.select("product_id"), "product_id", "left_semi")
    return products.filter((F.col("import_id") == import_id) & (F.col("status") != "completed"))
