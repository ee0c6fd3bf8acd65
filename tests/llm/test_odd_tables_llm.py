"""No query breaks on empty tables, nulls, repeated rows, very long texts or columns with clashing names."""

import pytest
from odd_tables import nulls, write

from runloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def null_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nulls"), nulls())


@pytest.mark.parametrize("name", list(QUERIES))
def test_nulls(spark, null_dir, name):
    QUERIES[name](spark, null_dir).collect()


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_every_row_has_its_container(spark, null_dir):
    rows = QUERIES["p2_pack"](spark, null_dir).collect()
    assert len(rows) == 3 and all(r["container"] == "c" and r["tokens"] == 0 and r["container_no"] == 0 for r in rows)
