import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session
    session = build_session("local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    return session
