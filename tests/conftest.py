from __future__ import annotations

import pytest

from gleanery.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
