import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mediaspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", 4, "4g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
