"""Every registered query against its check SQL on the smallest tables."""

import pytest
from compare import assert_same

from tickloom.catalog import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(name, spark, duck, folder):
    assert_same(QUERIES[name](spark, folder), duck, CHECKS[name])


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 10
