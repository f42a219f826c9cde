import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quarte.session import local_session

    return local_session(8, 4)


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Chunks, buckets and lanes so small that every series crosses their edges."""
    from quarte.operators import series

    monkeypatch.setattr(series, "CHUNK", 5)
    monkeypatch.setattr(series, "BUCKET", 3)
    monkeypatch.setattr(series, "LANES", 3)
