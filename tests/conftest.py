from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tabloom.session import get_spark
    return get_spark(master="local[*]", shuffle_partitions=8)


SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
