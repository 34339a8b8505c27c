import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TILLROLL_LOCAL_CKPT", tempfile.mkdtemp(prefix="tillroll-test-"))
    from tillroll.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()
