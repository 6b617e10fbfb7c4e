"""Every registered query against its SQL oracle on the smallest driver tables."""

import os

import pytest

from tools.check import compare
from wareloom.plans import ORACLES, QUERIES, load_all

load_all()
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    status, _, note = compare(spark, FOLDER, name, QUERIES, ORACLES)
    assert status in ("ok", "rows-only"), note


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
