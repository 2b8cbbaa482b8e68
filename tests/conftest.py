import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from foldwise.session import get_session
    s = get_session("local[4]", 4, extra={"spark.driver.memory": "4g"})
    yield s
    from foldwise.session import release_scratch
    release_scratch(s)


SF = "/root/testdata/sf0.001"
