import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))
# Python workers import the package too
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from litforge.core.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
