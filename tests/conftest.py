import sys

import pytest
from paths import ROOT

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from cartwheel.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="cartwheel-tests")
    yield s
    s.stop()
