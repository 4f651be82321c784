import pytest

from siftwell.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
