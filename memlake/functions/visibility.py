"""Row-level visibility and scope rules as Column predicates.

Every reader applies the same predicate so single requests and batch jobs agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asked(x: Column) -> Column:
    """A requester's project or owner: an empty one asks for nothing, like NULL."""
    return F.nullif(x, F.lit(""))


def _lit_or_col(x):
    if isinstance(x, Column):
        return asked(x)
    return F.lit(x)


def visible(project=None, owner=None, sensitivity="sensitivity", row_project="project",
            row_owner="owner_id") -> Column:
    """Visibility of memory rows to one requester.

    With an owner: public, or internal in the asked project, or secret owned by the requester.
    Without a project, internal never matches (comparison with NULL). Without an owner
    (legacy mode) everything but secret is visible. When a project is asked, rows must also
    belong to it. `project` / `owner` may be Python values or Columns (batch form); empty ones
    count as not given.
    """
    sens, rp, ro = F.col(sensitivity), F.col(row_project), F.col(row_owner)
    p, o = _lit_or_col(project), _lit_or_col(owner)
    with_owner = ((sens == "public") | ((sens == "internal") & (rp == p))
                  | ((sens == "secret") & (ro == o)))
    legacy = sens != "secret"
    if isinstance(owner, Column):
        pred = F.when(o.isNotNull(), F.coalesce(with_owner, F.lit(False))).otherwise(legacy)
    elif owner:
        pred = F.coalesce(with_owner, F.lit(False))
    else:
        pred = legacy
    if isinstance(project, Column):
        pred = pred & (p.isNull() | (F.coalesce(rp == p, F.lit(False))))
    elif project:
        pred = pred & F.coalesce(rp == p, F.lit(False))
    return pred


def scope_clamp(wanted="project", allowed="allowed") -> Column:
    """Restricted callers get the asked project when allowed, else their first allowed one.

    A NULL allowed list means an unrestricted caller.
    """
    a, al = F.col(wanted) if isinstance(wanted, str) else wanted, F.col(allowed) if isinstance(allowed, str) else allowed
    a = asked(a)
    return (F.when(al.isNull(), a)
            .when(a.isNotNull() & F.coalesce(F.array_contains(al, a), F.lit(False)), a)
            .otherwise(F.try_element_at(al, F.lit(1))))
