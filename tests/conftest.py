import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from remedy.session import build_session

    s = build_session("local[4]", 4, "remedy-tests",
                      {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="remedy-test-ckpt-")})
    yield s
    s.stop()
