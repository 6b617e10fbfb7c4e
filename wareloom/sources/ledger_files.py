"""Reading many suppliers' ledgers at once, each file by its own header.

Files of one folder may have different columns in different orders. The header widths are found in a first pass over the files' first lines; then all
files are parsed in one job into arrays of cells, which are written once. A file's first record names its columns, and every row is put together
with the header of its own file by ``_metadata.file_path``, whichever task read it. Rows are numbered within their file, as many tasks as a
large file has: from the order in each split and the row counts of the splits before it.

A header is one line. Cells may hold line breaks with ``multi_line``; such a file is not split. Blank headers are called ``Unnamed: i``, and a name that
comes again gets ``.1``, ``.2`` and so on, so no column is lost.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wareloom.session import data_folder


@dataclass(frozen=True)
class LedgerFiles:
    """``rows(file, row_no, raw)``, ``headers(file, position, header)`` and ``report(file, n_columns, n_rows, long_rows, problem)``."""

    rows: DataFrame
    headers: DataFrame
    report: DataFrame


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of all files below a folder or a glob, also of those without content, which Spark's readers pass over."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    top = hadoop.Path(path)
    fs = top.getFileSystem(conf)
    found = []
    for status in fs.globStatus(top) or []:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            one = files.next()
            if not one.getPath().getName().startswith(("_", ".")):
                found.append((one.getPath().toUri().toString(), one.getLen()))
    return spark.createDataFrame(found, "file string, length bigint").withColumn("file", _plain(F.col("file")))


def _plain(file: Column) -> Column:
    """One spelling of a local path."""
    return F.regexp_replace(file, "^file:/+", "file:/")


def _placed(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value, _plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))


def unique_names(header: Column) -> Column:
    """Column names of a header row: blank ones by position, repeated ones by count."""
    named = F.transform(header, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(x))
    def numbered(x, i, names):
        earlier = F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
        return F.when(earlier > 0, F.concat(x, F.lit("."), earlier.cast("string"))).otherwise(x)
    return F.transform(F.array(named), lambda names: F.transform(names, lambda x, i: numbered(x, i, names)))[0]


def read_ledgers(spark: SparkSession, path: str, multi_line: bool = False, delimiter: str = ",") -> LedgerFiles:
    """All CSV files below ``path`` (a folder or a glob); names that begin with a dot or underscore are passed over, as by Spark."""
    lines = _placed(spark.read.option("recursiveFileLookup", "true").text(path), F.col("value")).filter("start = 0")
    firsts = lines.groupBy("file").agg(F.min_by("value", "id").alias("line"))
    widest = firsts.agg(F.max(F.length("line") - F.length(F.replace("line", F.lit(delimiter), F.lit(""))))).first()[0] or 0
    columns = [f"c{i}" for i in range(widest + 2)]  # one more than any header has shows cells beyond it
    reader = spark.read.schema(", ".join(f"{c} string" for c in columns)).options(
        header="false", multiLine=str(multi_line).lower(), quote='"', escape='"', mode="PERMISSIVE", sep=delimiter, recursiveFileLookup="true")
    folder = data_folder(spark, f"ledgers-{uuid.uuid4().hex}")
    _placed(reader.csv(path), F.array(*columns).alias("cells")).write.parquet(folder)
    cells = spark.read.parquet(folder)

    splits = cells.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("cells", F.col("id")).alias("cells"))
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    width = F.aggregate("cells", F.struct(F.lit(0).alias("at"), F.lit(0).alias("last")), lambda a, c: F.struct((a["at"] + 1).alias("at"), F.when(c.isNotNull(), a["at"] + 1).otherwise(a["last"]).alias("last")))["last"]
    splits = splits.withColumns({"offset": F.coalesce(F.sum("n").over(upto), F.lit(0)), "header": F.first(F.slice("cells", F.lit(1), width)).over(whole)})
    header = F.transform("header", lambda x: F.regexp_replace(x, "^﻿", ""))
    splits = splits.select("file", "start", "first", "offset", "n", unique_names(header).alias("header"))

    placed = cells.join(splits.select("file", "start", "first", "offset", "header"), ["file", "start"]).withColumn("row_no", F.col("offset") + F.col("id") - F.col("first")).filter("row_no > 0")
    own = F.size("header")
    beyond = F.exists(F.slice("cells", own + 1, F.size("cells")), lambda c: c.isNotNull())
    rows = placed.select("file", "row_no", F.map_from_arrays("header", F.slice("cells", F.lit(1), own)).alias("raw"))
    tops = splits.filter("offset = 0")
    headers = tops.select("file", F.posexplode("header").alias("position", "header"))
    sizes = splits.groupBy("file").agg((F.sum("n") - 1).alias("n_rows"), F.size(F.first("header")).alias("n_columns"))
    long_rows = placed.filter(beyond).groupBy("file").agg(F.count(F.lit(1)).alias("long_rows"))
    report = _listed(spark, path).join(sizes, "file", "left").join(long_rows, "file", "left")
    problem = (F.when(F.col("n_columns").isNull(), F.lit("no header")).when(F.col("n_rows") == 0, F.lit("no rows"))
               .when(F.col("long_rows") > 0, F.lit("cells beyond the header")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return LedgerFiles(rows, headers, report.select("file", count("n_columns"), count("n_rows"), count("long_rows"), problem.alias("problem")))


def sampled(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of every file, blanks as empty strings."""
    kept = rows.filter(F.col("row_no") <= n)
    return kept.withColumn("raw", F.transform_values("raw", lambda k, v: F.coalesce(v, F.lit(""))))
