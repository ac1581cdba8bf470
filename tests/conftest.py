import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reconcile.session import local_session

    s = local_session(8, "tests", str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Collect selected columns as a sorted list of tuples."""

    def collect(df, *cols):
        out = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in out.collect()), key=repr)

    return collect
