"""One session for all tests, on driver tables small enough to be checked by brute force."""

from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
