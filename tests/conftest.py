import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from alertsieve.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="alertsieve-tests")
    yield s
    s.stop()


def epoch_ms(text: str) -> int:
    from datetime import datetime, timezone

    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)
