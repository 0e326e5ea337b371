from __future__ import annotations

import os

import pytest

from ctxlake.runtime import session

SF = os.environ.get("CTXLAKE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
    s = session("local[4]", 4, "ctxlake-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
