import random

import pytest

from wareloom.operators.paging import SortedList

SCHEMA = "a int, b string, id int"


def placed(row, keys):
    """A sort key for Python: nulls first ascending, last descending."""
    return [((row[k] is None) == down, -row[k] if down and row[k] is not None else row[k] or 0) if k != "b" else (row[k] is not None, row[k] or "") for k, down in keys.items()]


@pytest.mark.parametrize("keys", [{"a": True, "id": False}, {"b": False, "a": True, "id": True}, {"id": False}])
def test_pages_equal_the_whole_sort(spark, tmp_path, keys):
    rnd = random.Random(len(keys))
    rows = [{"a": rnd.choice([None, 1, 2, 3, 3, 3, 3]), "b": rnd.choice([None, "x", "y"]), "id": i} for i in range(300)]
    rnd.shuffle(rows)
    listed = SortedList.store(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), str(tmp_path), keys, parts=7)
    want = [r["id"] for r in sorted(rows, key=lambda r: placed(r, keys))]
    got, cursor = [], None
    while page := listed.page(64, cursor).collect():
        got += [r.id for r in page]
        cursor = page[-1].asDict()
    assert got == want


def test_a_late_page_reads_few_ranges(spark, tmp_path):
    listed = SortedList.store(spark.range(5000).selectExpr("cast(id as int) a", "'x' b", "cast(id as int) id"), str(tmp_path), {"id": True}, parts=50)
    files = lambda df: len({f for f in df.inputFiles()})
    assert files(listed.page(10)) <= 2 and files(listed.page(10, {"id": 40})) <= 2
    assert [r.id for r in listed.page(3, {"id": 4321}).collect()] == [4320, 4319, 4318]


def test_empty_list(spark, tmp_path):
    listed = SortedList.store(spark.createDataFrame([], SCHEMA), str(tmp_path), {"id": False})
    assert listed.page(5).collect() == []
