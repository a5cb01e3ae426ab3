from __future__ import annotations

import pytest

from loomsift.session import local_session, workers_find_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, 2)
    session.sparkContext.setLogLevel("ERROR")
    workers_find_package(session)
    yield session
    session.stop()
