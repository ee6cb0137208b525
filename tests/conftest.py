import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wearcast.session import checkpoint_dir, local_session

    s = local_session("*", shuffle_partitions=8, app="wearcast-tests")
    checkpoint_dir(s)  # registers a scratch folder only when none is configured
    yield s
    s.stop()
