import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kilowatt.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # The session's own spark.checkpoint.dir is kept; build_session gives a
    # local session a fresh folder only when none is configured.
    s = build_session("local[*]", app="kilowatt-tests", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="kw-test-")
