import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passbook.session import local_session  # noqa: E402

TESTDATA = os.environ.get("PASSBOOK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"
