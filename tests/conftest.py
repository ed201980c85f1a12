import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fabula.session import build

    session = build("tests", master="local[4]", partitions=4)
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fabula-tests-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
