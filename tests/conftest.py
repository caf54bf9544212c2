import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# the Python workers of the test session import the package from here
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from tallyweir.session import local_session

    return local_session(cores=4, shuffle_partitions=4, name="tests")


@pytest.fixture(scope="session")
def sf():
    """The smallest tables, for tests of whole queries."""
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
