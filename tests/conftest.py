from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tideline-tests", 8, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
