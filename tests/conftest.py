import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codewarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", app="tests", shuffle_partitions=8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.autoBroadcastJoinThreshold": "10485760"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
