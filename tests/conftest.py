import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestone.scratch import Scratch  # noqa: E402
from lodestone.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    out = session("tests", 4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    yield out
    out.stop()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def sf():
    return SF
