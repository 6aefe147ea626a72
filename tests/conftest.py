import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from offerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("local[4]", shuffle_partitions=4)
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="offerloom-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_tables():
    return "/root/testdata/sf0.001"
