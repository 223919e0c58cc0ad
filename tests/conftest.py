import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from deltaforge.session import session

    root = tempfile.mkdtemp(prefix="deltaforge-tests-")
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{root}", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df):
    """Rows as sorted tuples of values by column name."""
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
