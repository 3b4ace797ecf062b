from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.session import make_session  # noqa: E402

TEST_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return TEST_DIR


@pytest.fixture(scope="session")
def tx(spark, sf_dir):
    """The transaction view, stored."""
    from txrisk.fixtures import transactions
    from txrisk.sources.staging import stage

    return stage(transactions(spark, sf_dir), "tx")
