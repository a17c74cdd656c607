import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def make_session():
    from paramo.session import build_session
    spark = build_session(
        "paramo-tests", spark__master="local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="8g", spark__driver__host="127.0.0.1",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="paramo-tests-"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_session()
