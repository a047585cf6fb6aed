import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cairnflow.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "tests",
        4,
        **{
            "spark.checkpoint.dir": f"file://{shared}",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.sql.shuffle.partitions": "4",
        },
    )
    yield s
    s.stop()
