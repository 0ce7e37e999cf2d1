"""The query catalog of this package: importing a module registers its queries."""

from memlake.llm import (  # noqa: F401
    collocations,
    decontaminate,
    embedding_dedup,
    exact_dedup,
    html_text,
    manifest,
    mixing,
    packing,
    quality,
    repeats,
    secrets,
    simhash,
    tool_calls,
)
from memlake.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
