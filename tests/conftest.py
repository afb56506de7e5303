from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seekledger.session import local_session

    folders = {"spark.checkpoint.dir": "shared", "spark.sql.warehouse.dir": "warehouse"}
    session = local_session(4, "tests", {key: str(tmp_path_factory.mktemp(name)) for key, name in folders.items()})
    yield session
    session.stop()
