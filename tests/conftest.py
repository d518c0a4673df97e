import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import session  # noqa: E402

DATA = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "8", spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture
def tiny_blocks(spark):
    """Force every key with more than 7 rows through the divided plan."""
    spark.conf.set("millrace.blockRows", "7")
    yield
    spark.conf.unset("millrace.blockRows")


def rows(df):
    """Rows as a sorted list of tuples, floats rounded, for comparing results."""
    def cell(v):
        return round(v, 6) if isinstance(v, float) else v

    data = [tuple(cell(v) for v in r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(data, key=lambda r: tuple((v is not None, str(v)) for v in r))
