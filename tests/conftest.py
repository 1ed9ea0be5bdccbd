import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postflow.plans import stand_in  # noqa: E402
from postflow.session import local_session  # noqa: E402

stand_in.install()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("checkpoints"))
    s = local_session(4, shuffle_partitions=4, app="postflow-tests", extra={"spark.checkpoint.dir": shared})
    yield s
    s.stop()
