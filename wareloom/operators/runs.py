"""One batch of uploads from gates to written tables.

The change table is the expensive part, so it is written once and everything else is derived from the written table. New versions of
state and mappings are written beside the ones that were read; the caller switches readers to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.operators import ledger as lg
from wareloom.sources.writers import append, write_version


@dataclass(frozen=True)
class Applied:
    """The tables a batch wrote, and its counters per run."""

    changes: DataFrame
    state: DataFrame
    mappings: DataFrame
    log: DataFrame
    counters: DataFrame


def check(upload: DataFrame, runs: DataFrame) -> None:
    """Refuse the whole batch for unknown status spellings, codes given twice, rows of an owner and site that no run names (they would be
    logged under no run), and scopes with several runs."""
    key = lambda df: lg.scoped(df).select(lg.scope_key(*map(F.col, lg.SCOPE)).alias("scope"))
    named = key(runs)
    gates = {"Invalid wholesale status": lg.invalid_status_rows(upload).select("raw_value")} if "warnings" in upload.columns else {}
    lg.refuse_first({**gates, "Duplicate product codes": lg.duplicate_codes(upload), "Uploads without a run": key(upload).distinct().join(named, "scope", "left_anti"),
                     "Several runs of one owner and site": named.groupBy("scope").count().filter("count > 1")})


def apply_uploads(upload: DataFrame, state: DataFrame, mappings: DataFrame, runs: DataFrame, root: str, batch: str,
                  at: Column | None = None) -> Applied:
    """Check, compare with the catalogue, and write changes, next state, next mappings and log below ``root``.

    A refused batch writes nothing. A batch that is applied again under its name overwrites its own output.
    """
    spark = upload.sparkSession
    check(upload, runs)
    changes = spark.read.parquet(write_version(lg.diff(upload, state, runs=runs), f"{root}/changes", batch))
    next_state = spark.read.parquet(write_version(lg.next_state(changes), f"{root}/state", batch))
    next_mappings = spark.read.parquet(write_version(lg.propagate(mappings, changes, at), f"{root}/mappings", batch))
    append(lg.change_log(changes), f"{root}/log", "import_id")
    return Applied(changes, next_state, next_mappings, spark.read.parquet(f"{root}/log"), lg.counters(changes, by=("import_id", *lg.SCOPE)))
