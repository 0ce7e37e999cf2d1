"""Text layouts of a memory at each fidelity tier, built with concat / format_string.

Fixed values (output layout of the original service, must match for equal text):
    hot   : "## 🔴 [<id7>]<proj><tags> (score: <2 decimals>)" newline full text
    warm  : "## 🟡 [<id7>]<proj><tags> (score: <2 decimals>)" newline summary
            newline "> Recall full: hash `<id7>`"
    cool  : "## 🔵 [<id7>]<proj><tags> (score: <2 decimals>)" newline essence
            newline "> Recall full: hash `<id7>`"
    faded : "## ⚪ [<id7>]<proj> — <essence> _(recall to restore)_"
    gone  : empty text
    <proj> is " @<project>" when a project is set; <tags> is " [a, b]" when tags exist.
    Context header: "# λ-Memory", then "_<n> memories loaded | ~<used/4>/<budget/4> tokens |
    <used> chars_", then an empty line, then the blocks, all joined by newlines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import short_id

MARK_HOT, MARK_WARM, MARK_COOL, MARK_FADED = "🔴", "🟡", "🔵", "⚪"
CONTEXT_TITLE = "# λ-Memory"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def project_part(project="project") -> Column:
    p = _c(project)
    return F.when(p.isNotNull() & (p != ""), F.concat(F.lit(" @"), p)).otherwise(F.lit(""))


def tags_part(tags="tags") -> Column:
    t = _c(tags)
    return F.when(F.coalesce(F.size(t), F.lit(0)) > 0,
                  F.concat(F.lit(" ["), F.array_join(t, ", "), F.lit("]"))).otherwise(F.lit(""))


def score_text(score) -> Column:
    return F.format_string("%.2f", _c(score))


def _header(mark: str, h7: Column, proj: Column, tags: Column, score: Column) -> Column:
    return F.concat(F.lit(f"## {mark} ["), h7, F.lit("]"), proj, tags,
                    F.lit(" (score: "), score_text(score), F.lit(")"))


def tier_blocks(score="score", hash_col="hash", project="project", tags="tags",
                full_text="full_text", summary_text="summary_text",
                essence_text="essence_text") -> dict[str, Column]:
    """The four non-empty layouts of one memory, keyed by tier."""
    h7, proj, tg, sc = short_id(hash_col), project_part(project), tags_part(tags), _c(score)
    recall = F.concat(F.lit("\n> Recall full: hash `"), h7, F.lit("`"))
    return {
        "hot": F.concat(_header(MARK_HOT, h7, proj, tg, sc), F.lit("\n"), _c(full_text)),
        "warm": F.concat(_header(MARK_WARM, h7, proj, tg, sc), F.lit("\n"), _c(summary_text), recall),
        "cool": F.concat(_header(MARK_COOL, h7, proj, tg, sc), F.lit("\n"), _c(essence_text), recall),
        "faded": F.concat(F.lit(f"## {MARK_FADED} ["), h7, F.lit("]"), proj, F.lit(" — "),
                          _c(essence_text), F.lit(" _(recall to restore)_")),
    }


def format_memory(tier="fidelity", **kw) -> Column:
    b = tier_blocks(**kw)
    t = _c(tier)
    return (F.when(t == "hot", b["hot"]).when(t == "warm", b["warm"]).when(t == "cool", b["cool"])
            .when(t == "faded", b["faded"]).otherwise(F.lit("")))
