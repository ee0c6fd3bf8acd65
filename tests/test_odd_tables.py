"""No query breaks on empty tables, nulls, repeated rows or columns with clashing names."""

import pytest
from odd_tables import nulls, write

from runloom.plans import registry

QUERIES = registry()[0]
NAMES = [n for n in QUERIES if not n.startswith("host_")]


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def null_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nulls"), nulls())


@pytest.mark.parametrize("name", NAMES)
def test_nulls(spark, null_dir, name):
    QUERIES[name](spark, null_dir).collect()


@pytest.mark.parametrize("name", [n for n in NAMES if n[0] == "p" and n[1].isdigit()] + ["first_loop", "exact_topk", "grade_strict", "round_robin_pick"])
def test_empty(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0
