"""The stored catalogue: state and market mappings in buckets, rewritten bucket by bucket, with a digest per scope and bucket.

Every batch writes folders of its own (``state/<batch folder>/bucket=B``, the same for ``mappings``; ``digests``, ``log`` and ``changes`` without buckets)
that hold only the buckets it changes, and then one pointer file, which names the folder of every bucket. Readers follow the newest
pointer, so they see all tables of a batch or none; a batch that dies before its pointer leaves the old state. The pointer is renamed into
place and never replaces another, so of two batches at once one fails, and neither touches the other's files.

A product's bucket comes from its owner and site (``scopes`` slots) and its code (``parts`` of each slot), its mappings lie in the same bucket, and an
upload of few suppliers meets few buckets. Choose both so that a bucket suits a task; a bucket that is larger is written by several.

Digests: for each scope and bucket the number of products that its last upload held, and sums over the MD5 of their compared fields (before the
first upload: of the stored products that are not discontinued). Where an upload has the same digest, nothing has changed and neither side's rows are looked at again. Other buckets are compared row by row, and only those with new,
updated or removed products are rewritten. The driver handles bucket numbers only, ``scopes * parts`` at most.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wareloom import constants as K
from wareloom.functions.skew import join_per_key, salted
from wareloom.functions.text import is_blank
from wareloom.operators import ledger as lg
from wareloom.operators.runs import check
from wareloom.session import remove_folder

CHANGED = ("new", "updated", "removed")
DIGEST = "bucket int, scope string, n bigint, mixed bigint, total bigint"
LOG = ("import_id string, {scope}, product_id bigint, product_code string, original_name string, change_type string, changed_fields array<string>, "
       "field_changes map<string,struct<old:string,new:string>>")
#: columns that runs maintain, added to a catalogue without them
KEPT = {"import_id": "string", "status": "string", "change_type": "string", "image_status": "string", "processed_image_path": "string",
        "changed_fields": "array<string>", "field_changes": "map<string,struct<old:string,new:string>>"}


class ConcurrentBatch(RuntimeError):
    """Another batch has switched the pointer since this one read it."""


@dataclass(frozen=True)
class Batch:
    """What a batch did: counters per run, the compared rows, and the buckets compared and rewritten."""

    counters: DataFrame
    changes: DataFrame
    compared: list[int]
    rewritten: list[int]


class Catalogue:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- reading -----------------------------------------------------------------------------------------------------------------

    def pointer(self) -> dict:
        """The newest pointer: generation, batch, layout, schemas, and the generation of each bucket of each table."""
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("pointer")) if not s.getPath().getName().startswith("_")]
        return self._read(f"pointer/{max(names)}")

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        return self._table("state", self.pointer(), buckets).drop("bucket")

    def mappings(self, buckets: list[int] | None = None) -> DataFrame:
        return self._table("mappings", self.pointer(), buckets).drop("bucket")

    def log(self) -> DataFrame:
        """The change log of all batches up to the newest pointer."""
        at = self.pointer()
        return self._parquet(at["schemas"]["log"], *[f"log/{folder}" for folder in at["log"]])

    def _table(self, name: str, at: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all or some buckets, with the number of their bucket."""
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/{name}/{folder}/bucket={b}" for b, folder in at["tables"][name].items() if wanted is None or int(b) in wanted]
        schema = f"{at['schemas'][name]}, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, gen string").option("basePath", f"{self.root}/{name}").parquet(*paths).drop("gen")

    def _parquet(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    # -- writing -----------------------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, state: DataFrame, mappings: DataFrame, root: str, scopes: int = 64, parts: int = 16) -> Catalogue:
        """Store a catalogue and its mappings as the first generation."""
        out, folder = cls(state.sparkSession, root), cls._folder(0)
        layout = {"scopes": scopes, "parts": parts}
        state = lg.scoped(state)
        state = state.withColumns({c: F.lit(None).cast(kind) for c, kind in KEPT.items() if c not in state.columns})
        placed = out._bucketed(state, layout)
        if "last_changed_at" not in mappings.columns:
            mappings = mappings.withColumn("last_changed_at", F.lit(None).cast("timestamp"))
        mapped = mappings.join(placed.select("product_id", "bucket"), "product_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit(-1)))  # -1: of no product
        kinds = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        scope_kinds = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in lg.SCOPE)
        at = {"generation": 0, "batch": None, "layout": layout, "log": [], "digests": folder,
              "schemas": {"state": kinds(state), "mappings": kinds(mappings), "log": LOG.format(scope=scope_kinds)},
              "tables": {"state": out._write("state", folder, placed), "mappings": out._write("mappings", folder, mapped)}}
        gone = F.col("change_type").eqNullSafe(F.lit("removed")) & F.col("wholesale_status").eqNullSafe(F.lit(K.DISCONTINUED_STATUS))
        out._write_digests(folder, out._digests(out._table("state", at).filter(~gone)))
        out._switch(at)
        return out

    def apply(self, upload: DataFrame, runs: DataFrame, batch: str, at: Column | None = None) -> Batch:
        """Check an upload, compare it, and switch to the catalogue after it. A batch that was the last to be applied is refused."""
        old = self.pointer()
        if old["batch"] == batch:
            raise ConcurrentBatch(f"batch {batch} is applied")
        generation, layout = old["generation"] + 1, old["layout"]
        folder = self._folder(generation)
        runs = lg.scoped(runs)
        placed = self._kept("upload", folder, self._placed_upload(lg.scoped(upload), runs, layout))  # mapped and parsed once
        check(placed, runs)
        facts = self._kept("compared", folder, self._equal_digests(placed, runs, old["digests"]))
        compared = sorted(r.bucket for r in facts.filter("NOT same").select("bucket").distinct().collect())
        diffed = lg.diff(placed.filter(F.col("bucket").isin(compared)).drop("bucket"), self._table("state", old, compared).drop("bucket"), runs=runs)
        changes = self._kept("changes", folder, self._bucketed(diffed, layout))
        touched = changes.filter(F.col("change_type").isin(*CHANGED)).groupBy("bucket").agg(F.max(F.col("change_type") != "new").alias("mapped")).collect()
        rewritten = sorted(r.bucket for r in touched)
        remapped = sorted(r.bucket for r in touched if r.mapped)
        inside = changes.filter(F.col("bucket").isin(rewritten))
        state = self._as_stored(lg.next_state(inside.drop("bucket")), old["schemas"]["state"])
        mapped = lg.propagate(self._table("mappings", old, remapped), inside.filter(F.col("bucket").isin(remapped)).drop("bucket"), at)
        new = {**old, "generation": generation, "batch": batch, "log": [*old["log"], folder], "digests": folder, "tables": {
            "state": old["tables"]["state"] | self._write("state", folder, self._bucketed(state, layout)),
            "mappings": old["tables"]["mappings"] | self._write("mappings", folder, self._as_stored(mapped, old["schemas"]["mappings"], "bucket"))}}
        self._write_digests(folder, facts.filter("given IS NOT NULL").select("bucket", "scope", "given.*"), runs, old["digests"])
        self._as_stored(lg.change_log(inside.drop("bucket")), old["schemas"]["log"]).write.parquet(f"{self.root}/log/{folder}")
        self._switch(new)
        skipped = facts.filter(~F.col("bucket").isin(compared))
        return Batch(self._counters(changes, skipped, runs), changes.drop("bucket"), compared, rewritten)

    def update_mappings(self, results: DataFrame, batch: str) -> list[int]:
        """Write category results into the mappings (``ledger.ensure_mappings``), rewriting the buckets of their products only; results for
        no stored product are left out."""
        old = self.pointer()
        generation = old["generation"] + 1
        folder = self._folder(generation)
        ids = self._table("state", old).select("product_id", "bucket")
        placed = self._kept("results", folder, results.join(ids, "product_id"))
        touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())
        merged = lg.ensure_mappings(self._table("mappings", old, touched).drop("bucket"), placed.drop("bucket"))
        rows = self._as_stored(merged, old["schemas"]["mappings"]).join(ids.filter(F.col("bucket").isin(touched)), "product_id")
        tables = {**old["tables"], "mappings": old["tables"]["mappings"] | self._write("mappings", folder, rows)}
        self._switch({**old, "generation": generation, "batch": batch, "tables": tables})
        return touched

    def vacuum(self) -> None:
        """Remove folders of state and mappings that the newest pointer does not name: readers of older pointers and running batches lose them."""
        at = self.pointer()
        for name, buckets in at["tables"].items():
            for status in self._fs().listStatus(self._path(name)):
                if status.getPath().getName().startswith("gen=") and status.getPath().getName() not in buckets.values():
                    remove_folder(self.spark, status.getPath().toString())

    # -- parts -------------------------------------------------------------------------------------------------------------------

    @staticmethod
    def _folder(generation: int) -> str:
        return f"gen={generation:09d}-{uuid.uuid4().hex[:8]}"

    @staticmethod
    def _as_stored(rows: DataFrame, schema: str, *more: str) -> DataFrame:
        """The columns of a stored table, by name."""
        kinds = StructType.fromDDL(schema)
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds], *more)

    def _kept(self, name: str, folder: str, rows: DataFrame) -> DataFrame:
        """Write a table of this batch and read it from there."""
        path = f"{self.root}/{name}/{folder}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @staticmethod
    def _bucket(layout: dict, product_id: Column) -> Column:
        """The bucket of a product; those without a code are spread by id."""
        code = F.when(is_blank(F.col("product_code")), product_id.cast("string")).otherwise(F.col("product_code"))
        slot = F.pmod(F.xxhash64(lg.scope_key(F.col("user_id"), F.col("site_id"))), F.lit(layout["scopes"]))
        return (slot * layout["parts"] + F.pmod(F.xxhash64(F.lit("code"), code), F.lit(layout["parts"]))).cast("int")

    def _bucketed(self, rows: DataFrame, layout: dict) -> DataFrame:
        return rows.withColumn("bucket", self._bucket(layout, F.col("product_id")))

    def _placed_upload(self, upload: DataFrame, runs: DataFrame, layout: dict) -> DataFrame:
        """The upload with the bucket of each row; a row without a code goes where its new product will be."""
        row_no = F.col("row_no") if "row_no" in upload.columns else F.lit(None)
        named = runs.select(lg.scope_key(F.col("user_id"), F.col("site_id")).alias("_scope"), F.col("import_id").alias("_run"))
        rows = upload.withColumn("_scope", lg.scope_key(F.col("user_id"), F.col("site_id")))
        rows = join_per_key(salted(rows, [c for c in ("product_code", "row_no") if c in upload.columns]), named, ["_scope"], "left")
        bare = lg.new_product_id(F.col("user_id"), F.col("site_id"), F.lit(None).cast("string"), F.col("_run"), row_no)
        return rows.select(*upload.columns, self._bucket(layout, bare).alias("bucket"))

    @staticmethod
    def _digests(rows: DataFrame) -> DataFrame:
        """(bucket, scope, n, mixed, total) over coded rows."""
        text = F.to_json(F.struct("product_code", *lg.compared_fields(rows)), {"ignoreNullFields": "false"})
        part = lambda at: F.conv(F.substring("_md5", at, 14), 16, 10).cast("bigint")
        coded = rows.filter(~is_blank(F.col("product_code"))).select("bucket", lg.scope_key(F.col("user_id"), F.col("site_id")).alias("scope"), F.md5(text).alias("_md5"))
        return coded.groupBy("bucket", "scope").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(part(1)).alias("mixed"), F.sum(F.shiftright(part(15), 24)).alias("total"))

    def _equal_digests(self, placed: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
        """(bucket, scope, given, n, same) of every bucket in which the catalogue or the upload has products of a scope of this batch."""
        scope = lg.scope_key(F.col("user_id"), F.col("site_id")).alias("scope")
        stored = self._parquet(DIGEST, f"digests/{folder}").join(runs.select(scope), "scope", "left_semi")
        given = self._digests(placed).select("bucket", "scope", F.struct("n", "mixed", "total").alias("given"))
        bare = placed.filter(is_blank(F.col("product_code"))).select("bucket", scope).distinct().withColumn("bare", F.lit(True))
        both = stored.select("bucket", "scope", F.struct("n", "mixed", "total").alias("stored")).join(given, ["bucket", "scope"], "full_outer").join(bare, ["bucket", "scope"], "full_outer")
        same = F.col("stored").eqNullSafe(F.col("given")) & F.col("bare").isNull()
        return both.select("bucket", "scope", "given", F.coalesce("given.n", F.lit(0)).cast("bigint").alias("n"), same.alias("same"))

    def _write_digests(self, folder: str, fresh: DataFrame, runs: DataFrame | None = None, before: str | None = None) -> None:
        """What each scope's last upload looked like: new digests for the scopes of this batch, the others as they were."""
        if before is not None:
            scopes = runs.select(lg.scope_key(F.col("user_id"), F.col("site_id")).alias("scope"))
            fresh = self._parquet(DIGEST, f"digests/{before}").join(scopes, "scope", "left_anti").select(fresh.columns).unionByName(fresh)
        fresh.write.parquet(f"{self.root}/digests/{folder}")

    def _write(self, name: str, folder: str, rows: DataFrame) -> dict[str, str]:
        """Write the buckets of a batch, large ones in several files; returns which buckets there are."""
        dealt = self.spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {rows}", rows=rows)
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(f"{name}/{folder}"))]
        return {n.removeprefix("bucket="): folder for n in sorted(names) if n.startswith("bucket=")}

    def _counters(self, changes: DataFrame, skipped: DataFrame, runs: DataFrame) -> DataFrame:
        """Counters per run; the rows of buckets with equal digests are unchanged ones."""
        by = ("import_id", *lg.SCOPE)
        counted = lg.counters(changes.drop("bucket"), by=by)
        more = skipped.groupBy("scope").agg(F.sum("n").alias("n"))
        named = runs.select("import_id", *lg.SCOPE, lg.scope_key(F.col("user_id"), F.col("site_id")).alias("scope")).join(more, "scope")
        bare = named.select(*[F.col(c).cast(counted.schema[c].dataType) for c in by], *[F.lit(0).cast("bigint").alias(c) for c in counted.columns if c.endswith("_count") and c != "unchanged_count"],
                            F.col("n").alias("unchanged_count"))
        rows = counted.drop("status").unionByName(bare)
        sums = rows.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in counted.columns if c.endswith("_count")])
        return sums.withColumn("status", F.when(F.col("reprocess_count") == 0, F.lit("completed")).otherwise(F.lit("pending")))

    def _switch(self, at: dict) -> None:
        """Put the pointer in place; it must not be there yet."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        temporary, final = self._path(f"pointer/_{uuid.uuid4().hex}"), self._path(f"pointer/{at['generation']:09d}.json")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(at).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(temporary), fs.makeQualified(final), none)
        except Exception as error:
            if fs.exists(final):
                raise ConcurrentBatch(f"generation {at['generation']} is there already") from error
            raise

    def _read(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
