"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from oracle import compare

from leafmill import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
