import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from twinbook.session import build_session
    from twinbook.streaming.processors import STATE_CONF

    s = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4")
    for k, v in STATE_CONF.items():
        s.conf.set(k, v)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()
