import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from flowsentry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
