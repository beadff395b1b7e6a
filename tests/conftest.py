import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))

from brightloom.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("4", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield ship(s)
    s.stop()
