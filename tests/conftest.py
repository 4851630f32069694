import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrastat.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("4", shuffle_partitions=4, memory="4g")
