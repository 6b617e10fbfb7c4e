"""The node table: pages taken apart once, one row per element and per piece of text.

``ord`` numbers a page's elements and texts in document order and ``last`` is the number of an element's last descendant, so an element's subtree
is the interval (ord, last]. Intervals of one page nest or are disjoint. Selectors use that: an element has an ancestor among some
elements exactly if the largest ``last`` of those that began before it reaches it, which one sweep over the page finds for all selectors
at once. Text is kept at the pieces only; the text of an element is put together when it is asked for.

``store`` writes the table bucketed by page and sorted, so that readers neither parse nor shuffle it again. ``page_id`` identifies a page; a page
without HTML has no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareloom.functions import markup
from wareloom.session import data_folder

TEXT = "#text"  # the tag of a piece of text
NODES = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
                   ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SCHEMA = ("page_id bigint, ord int, last int, parent int, tag string, id string, classes array<string>, attrs map<string,string>, text string, start int, end int")
SLICE = 64  # pages whose nodes are handed on at once


def _maps(values: Iterable[dict | None]) -> pa.Array:
    """Attribute maps from flat keys and values, several times as fast as from pairs."""
    offsets, keys, items = [], [], []
    for value in values:
        offsets.append(None if value is None else len(keys))
        if value:
            keys.extend(value)
            items.extend(value.values())
    return pa.MapArray.from_arrays(pa.array([*offsets, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()))


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            rows = [[page, *node] for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if html is not None for node in markup.nodes(html)]
            columns = zip(*rows) if rows else [[]] * len(NODES)
            yield pa.RecordBatch.from_arrays([_maps(values) if f.name == "attrs" else pa.array(values, f.type) for values, f in zip(columns, NODES)], schema=NODES)


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """The node table of ``pages(page_id, html)``."""
    return pages.select(F.col("page_id").cast("bigint"), F.col(html).cast("string")).mapInArrow(_parsed, SCHEMA)


def store(pages: DataFrame, html: str = "html") -> DataFrame:
    """Parse, and write the node table to the shared folder with a page's rows together; returns the written table."""
    spark = pages.sparkSession
    name = f"nodes_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Pages are dealt before they are parsed: they are smaller than their nodes, and each task then writes one bucket.
    dealt = pages.select(F.col("page_id").cast("bigint").alias("page_id"), html).repartition(buckets, "page_id")
    parse(dealt, html).write.bucketBy(buckets, "page_id").sortBy("page_id", "ord").format("parquet").option("path", data_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


_SIMPLE = re.compile(r"""^(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[[\w-]+(?:[*^]?=["']?[^"'\]]*["']?)?\])*)$""", re.X)
_PART = re.compile(r"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)["']?(?P<val>[^"'\]]*)["']?)?\]""")


def chains(selector: str) -> list[list[str]]:
    """Comma groups, each a list of simple selectors from ancestor to element."""
    return [g.split() for g in selector.split(",")]


def supported(selector: str) -> bool:
    return all(g and all(_SIMPLE.match(s) for s in g) for g in chains(selector))


def matches(simple: str) -> Column:
    """Whether a row of the node table is an element that fits a simple selector."""
    found = _SIMPLE.match(simple)
    if not found:
        raise ValueError(f"unsupported selector: {simple}")
    test = F.col("tag") != TEXT if found["tag"] in (None, "*") else F.col("tag") == found["tag"].lower()
    for part in _PART.finditer(found["rest"]):
        if part["id"]:
            test = test & (F.col("id") == part["id"])
        elif part["cls"]:
            test = test & F.array_contains("classes", part["cls"])
        else:
            value = F.try_element_at("attrs", F.lit(part["attr"]))
            check = {None: value.isNotNull(), "=": value == part["val"], "*=": value.contains(part["val"] or ""),
                     "^=": value.startswith(part["val"] or "")}[part["op"]]
            test = test & F.coalesce(check, F.lit(False))
    return test


def _inside(flag: Column) -> Column:
    """Whether a row lies below an element for which the flag holds."""
    earlier = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(earlier) >= F.col("ord"), F.lit(False))


def select(nodes: DataFrame, selectors: dict[str, str], images: Iterable[str] = ()) -> DataFrame:
    """(page_id, name, ord, last, tag, attrs, start, end) of the elements that each named selector fits.

    For the names in ``images`` the images at or below those elements are given instead. All selectors share one sweep: a step of every chain
    per window, over the rows that fit some simple selector.
    """
    paths = {name: chains(s) for name, s in selectors.items()}
    wanted = set(images)
    simple = {s: f"_s{i}" for i, s in enumerate(dict.fromkeys(s for groups in paths.values() for g in groups for s in g))}
    if not simple:
        return nodes.limit(0).select("page_id", F.lit("").alias("name"), "ord", "last", "tag", "attrs", "start", "end")
    rows = nodes.select("page_id", "ord", "last", "tag", "attrs", "start", "end", *[F.coalesce(matches(s), F.lit(False)).alias(c) for s, c in simple.items()])
    is_image = F.col("tag") == "img"
    kept = F.greatest(*[F.col(c) for c in simple.values()], F.lit(False))
    rows = rows.filter(kept | is_image if wanted else kept)
    flags = {(name, k): simple[g[0]] for name, groups in paths.items() for k, g in enumerate(groups)}
    for level in range(1, max(len(g) for groups in paths.values() for g in groups)):
        step = {}
        for (name, k), flag in list(flags.items()):
            chain = paths[name][k]
            if level < len(chain):
                column = f"_{len(step)}_{level}"
                step[column] = F.col(simple[chain[level]]) & _inside(F.col(flag))
                flags[name, k] = column
        rows = rows.withColumns(step)
    found = {name: F.greatest(*[F.col(flags[name, k]) for k in range(len(groups))], F.lit(False)) for name, groups in paths.items()}
    if wanted:
        rows = rows.withColumns({f"_hit_{i}": found[name] for i, name in enumerate(sorted(wanted))})
        found |= {name: is_image & (F.col(f"_hit_{i}") | _inside(F.col(f"_hit_{i}"))) for i, name in enumerate(sorted(wanted))}
    rows = rows.withColumns({f"_found_{i}": flag for i, flag in enumerate(found.values())})
    names = F.array_compact(F.array(*[F.when(F.col(f"_found_{i}"), F.lit(name)) for i, name in enumerate(found)]))
    return rows.select("page_id", F.explode(names).alias("name"), "ord", "last", "tag", "attrs", "start", "end")


def with_text(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add the visible text of each chosen element: its subtree's pieces in order, met by their intervals within the page."""
    pieces = nodes.filter((F.col("tag") == TEXT) & F.col("text").isNotNull()).select(F.col("page_id").alias("_page"), F.col("ord").alias("_at"), "text")
    within = (F.col("page_id") == F.col("_page")) & F.col("_at").between(F.col("ord"), F.col("last"))
    spots = chosen.select("page_id", "ord", "last").distinct()
    parts = spots.join(pieces, within).groupBy("page_id", "ord").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_p"))
    whole = parts.select("page_id", "ord", F.array_join(F.col("_p.text"), "").alias("text"))
    return chosen.join(whole, ["page_id", "ord"], "left").withColumn("text", F.coalesce("text", F.lit("")))
