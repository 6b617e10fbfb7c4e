import os

from wareloom.sources.ledger_files import read_ledgers, sampled


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as f:
        f.write(text)


def table(files):
    return sorted((os.path.basename(r.file), r.row_no, r.raw) for r in files.rows.collect())


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path, "a", "﻿code,name,price\n1,one,\n2,\"two, 2\",5\n")
    write(tmp_path, "b", "price,,code,code,name\n7,x,3,4,three\n8,,5\n")
    write(tmp_path / "x y", "c", "code\n6,more\n")
    write(tmp_path, "d", "")
    files = read_ledgers(spark, str(tmp_path))
    assert table(files) == [
        ("a.csv", 1, {"code": "1", "name": "one", "price": None}), ("a.csv", 2, {"code": "2", "name": "two, 2", "price": "5"}),
        ("b.csv", 1, {"price": "7", "Unnamed: 1": "x", "code": "3", "code.1": "4", "name": "three"}), ("b.csv", 2, {"price": "8", "Unnamed: 1": None, "code": "5", "code.1": None, "name": None}),
        ("c.csv", 1, {"code": "6"})]
    report = {os.path.basename(r.file): (r.n_columns, r.n_rows, r.long_rows, r.problem) for r in files.report.collect()}
    assert report == {"a.csv": (3, 2, 0, None), "b.csv": (5, 2, 0, None), "c.csv": (1, 1, 1, "cells beyond the header"), "d.csv": (0, 0, 0, "no header")}
    assert sampled(files.rows, 1).count() == 3


def test_rows_of_split_files_are_numbered_in_order(spark, tmp_path):
    write(tmp_path, "large", "n,text\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(1, 3001)))
    write(tmp_path, "small", "text,n\nx,1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        files = read_ledgers(spark, str(tmp_path))
        rows = table(files)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(n, raw["n"]) for _, n, raw in rows] == [(i, str(i)) for i in range(1, 3001)] + [(1, "1")]


def test_cells_with_line_breaks_and_an_empty_folder(spark, tmp_path):
    write(tmp_path / "in", "a", "code,text\n1,\"two\nlines, and \"\"quotes\"\"\"\n2,one\n")
    assert [raw["text"] for _, _, raw in table(read_ledgers(spark, str(tmp_path / "in"), multi_line=True))] == ['two\nlines, and "quotes"', "one"]
    write(tmp_path / "none", "a", "")
    files = read_ledgers(spark, str(tmp_path / "none"))
    assert files.rows.collect() == [] and files.report.first().problem == "no header"
