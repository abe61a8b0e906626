from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from gleaner.session import ship_package

    ship_package(spark)
