"""Every query of the subpackage against its SQL on the smallest tables."""

import pytest

from tests.test_queries import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")

from cantera.llm.oracle import ORACLE  # noqa: E402
from cantera.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
