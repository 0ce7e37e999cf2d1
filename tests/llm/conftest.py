from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_check():
    return "/root/testdata/sf0.01"
