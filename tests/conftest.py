import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# workers import the package, and the test modules whose functions they run
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rivulet.session import local_session

    session = local_session("8", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def numbers(spark):
    """numbers(1, 2, 3): rows with their order."""
    return lambda *values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord long, v int")
