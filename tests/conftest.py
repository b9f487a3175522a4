import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

from marquetry.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    extra = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("layers")),
    }
    session = build("local[8]", 8, extra)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
