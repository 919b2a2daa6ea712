import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from footscape.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8", "6g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
