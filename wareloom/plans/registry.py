"""Registry of named queries and their SQL oracles."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wareloom.operators.nodes import store
from wareloom.plans.fixtures import FIXTURES, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NODE_TABLES: dict[tuple[str, str, str], DataFrame] = {}

FAMILIES = ("scalars", "mapping", "options", "ledger", "snapshots", "quality", "pricing", "reads", "keywords", "drafts", "pages", "io",)


class Tables:
    """Attribute access to the driver tables and to the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        raise AttributeError(name)

    def nodes(self, name: str) -> DataFrame:
        """The node table of a table of pages: parsed and written by the first query of a session that reads it, read by the others."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in NODE_TABLES:
            NODE_TABLES[key] = store(getattr(self, name))
        return NODE_TABLES[key]

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose table names are driver tables or derived inputs."""
        used = {name: getattr(self, name) for name in referenced(text)}
        text = text.replace("{", "{{").replace("}", "}}")
        for name in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **used)


def referenced(text: str) -> list[str]:
    names = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text)
    return [n for n in dict.fromkeys(names) if n in TABLES or n in FIXTURES]


def with_inputs(body: str) -> str:
    """Prefix an oracle with the derived inputs it reads, as common table expressions."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in referenced(text):
            if name in FIXTURES and name not in ordered:
                visit(FIXTURES[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({FIXTURES[name]})" for name in ordered)
    inner = re.match(r"\s*WITH\s", body)
    return f"WITH {ctes}{', ' + body[inner.end():] if inner else chr(10) + body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name`` together with its oracle SQL."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_inputs(oracle)
        return fn

    return register


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"wareloom.plans.{family}")
