import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    s = get_spark("local[4]", 4, extra={"tessera.ordered.slices": "7"})
    yield s


@pytest.fixture(scope="session")
def t(spark):
    from tessera.sources.tables import tables
    return tables(spark, SF001)
