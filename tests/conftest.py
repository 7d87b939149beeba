import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("JAVA_TOOL_OPTIONS", "-XX:TieredStopAtLevel=1 -XX:ReservedCodeCacheSize=256m")  # small data: compile fast, not well
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lotgrid.session import build_session, ship

    session = build_session("tests", 8, "6g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
