import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.session import SEGMENTS_CONF, build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.driver.memory": "6g", "spark.ui.enabled": "false", SEGMENTS_CONF: "8"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
