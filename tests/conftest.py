from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from memlake.session import get_spark
    s = get_spark(master="local[*]", app="memlake-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def queries():
    from memlake.plans import load_all
    q, o = load_all()
    return q, o


def memory_row(**over):
    """The reference tests' entry factory (FIXTURES.md part A), `now` fixed."""
    now = over.pop("now", 1_700_000_000)
    base = dict(hash="abc1234567890def", created_at=now, last_accessed=now, access_count=0,
                importance=3.0, explicit_save=False, full_text="This is the full text of the memory.",
                summary_text="Summary of the memory.", essence_text="Memory essence", context_log=None,
                tags=["test"], memory_type="conversation", sensitivity="public", project="test-project",
                session_id="session_1", owner_id="default")
    base.update(over)
    return base


MEMORY_DDL = ("hash string, created_at bigint, last_accessed bigint, access_count bigint, importance double, "
              "explicit_save boolean, full_text string, summary_text string, essence_text string, "
              "context_log string, tags array<string>, memory_type string, sensitivity string, project string, "
              "session_id string, owner_id string")


def memories_df(spark, rows):
    from memlake.sources.fixtures import MEMORY_COLUMNS
    return spark.createDataFrame([tuple(r[c] for c in MEMORY_COLUMNS) for r in rows], MEMORY_DDL)
