import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from motusflow.session import importable, local_session

    s = local_session(4, partitions=4, memory="2g")
    s.sparkContext.setLogLevel("ERROR")
    return importable(s)
