"""Fuzzy project-name resolution against the known project names.

Priority: exact, case-insensitive, normal form (lower-case without '-', '_', whitespace,
'.'), then Levenshtein distance (on lower-cased names) up to 1 / 2 / 3 edits for incoming
names of <= 4 / <= 10 / longer length. Known names are scanned by memory count desc, so
ties go to the larger project (then the name). Blank input passes through.

Every level is an equi join: levels 1-3 on the (normalised) name. Level 4 uses exact
segment blocking (pigeonhole): each known name of length >= 4 is cut into 4 segments; if an
incoming name is within d <= 3 edits, one segment is untouched and occurs in it at a
position shifted by at most d. Incoming names are expanded into those few (length, segment,
substring) keys and equi-joined to the segments, then `levenshtein` verifies the candidates.
No candidate is lost and no all-pairs product is formed; names shorter than 4 chars (a
small, bounded set) are paired by length. The best candidate per incoming name is an
aggregate (`min_by`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.config import UNTAGGED
from memlake.functions.text import js_trim, normalize_name


def known_names(mem: DataFrame) -> DataFrame:
    """(name, cnt) of real projects (no NULL / "_untagged")."""
    return (mem.filter(F.col("project").isNotNull() & (F.col("project") != UNTAGGED))
            .groupBy(F.col("project").alias("name")).agg(F.count("*").alias("cnt")))


def max_edits(length) -> F.Column:
    return F.when(length <= 4, 1).when(length <= 10, 2).otherwise(3)


MAX_SEGMENTS = 4  # largest edit limit (3) + 1


def _seg_start(L, i, S):
    """0-based start of segment i of a length-L string cut into S (the last L % S are longer)."""
    base, extra = F.floor(L / S), L % S
    return i * base + F.greatest(F.lit(0), i - (S - extra))


def _seg_len(L, i, S):
    base, extra = F.floor(L / S), L % S
    return base + F.when(i >= S - extra, 1).otherwise(0)


def _segment_candidates(live: DataFrame, nm: DataFrame) -> DataFrame:
    """(incoming, t, name, cnt, lname) pairs sharing an exactly placed segment. A name is cut into one segment more
    than the incoming name may have edits, so one segment is untouched; short names get long segments."""
    cuts = nm.select("name", "cnt", "lname", "nlen", F.explode(F.sequence(F.lit(2), F.lit(MAX_SEGMENTS))).alias("S"))
    segs = (cuts.filter(F.col("nlen") >= F.col("S"))
            .select("name", "cnt", "lname", "nlen", "S", F.explode(F.sequence(F.lit(0), F.col("S") - 1)).alias("i"))
            .select("name", "cnt", "lname", "nlen", "S", "i",
                    F.substring("lname", (_seg_start(F.col("nlen"), F.col("i"), F.col("S")) + 1).cast("int"),
                                _seg_len(F.col("nlen"), F.col("i"), F.col("S")).cast("int")).alias("seg")))
    tl = F.length("t")
    d = max_edits(tl)
    keys = (live.select("incoming", "t", (d + 1).alias("S"), F.explode(F.sequence(F.greatest(tl - d, d + 1), tl + d)).alias("L"))
            .filter(F.col("L") <= tl + d)        # empty range when the name is too short
            .select("incoming", "t", "S", "L", F.explode(F.sequence(F.lit(0), F.col("S") - 1)).alias("i")))
    st, ln = _seg_start(F.col("L"), F.col("i"), F.col("S")), _seg_len(F.col("L"), F.col("i"), F.col("S"))
    keys = keys.select("incoming", "t", "S", "L", "i", ln.alias("ln"), F.explode(F.sequence(st - d, st + d)).alias("q"))
    keys = keys.filter((F.col("q") >= 0) & (F.col("q") + F.col("ln") <= tl))
    keys = keys.select("incoming", "t", "S", "L", "i",
                       F.substring(F.lower("t"), (F.col("q") + 1).cast("int"), F.col("ln").cast("int")).alias("seg"))
    j = keys.join(segs, (F.col("L") == F.col("nlen")) & (keys["S"] == segs["S"]) & (keys["i"] == segs["i"]) & (keys["seg"] == segs["seg"]))
    return j.select("incoming", "t", "name", "cnt", "lname").distinct()


def _deletions(df: DataFrame, text: str, times) -> DataFrame:
    """`df` with `del`: the text with up to `times` (a column, at most 3) characters left out."""
    out = df.withColumn("del", F.lower(text)).withColumn("_left", times)
    step = out
    for _ in range(MAX_SEGMENTS - 1):
        step = (step.filter((F.col("_left") > 0) & (F.length("del") > 0))
                .withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("del"))))
                .withColumn("del", F.concat(F.substring("del", F.lit(1), F.col("_i") - 1), F.substr("del", F.col("_i") + 1)))
                .withColumn("_left", F.col("_left") - 1).drop("_i"))
        out = out.unionByName(step)
    return out.drop("_left").distinct()


def _short_candidates(live: DataFrame, nm: DataFrame) -> DataFrame:
    """Known names with fewer characters than segments (at most 3), met on what is left after deletions."""
    tl = F.length("t")
    short = _deletions(nm.filter(F.col("nlen") < MAX_SEGMENTS).select("name", "cnt", "lname"), "lname", F.lit(MAX_SEGMENTS - 1))
    near = live.filter(tl < 2 * MAX_SEGMENTS - 1).select("incoming", "t")
    return (_deletions(near, "t", max_edits(tl)).join(short, "del")
            .select("incoming", "t", "name", "cnt", "lname").distinct())


def resolve(incoming: DataFrame, names: DataFrame, col: str = "incoming") -> DataFrame:
    """(incoming, resolved, corrected, strategy) for every incoming name."""
    inc = incoming.select(F.col(col).alias("incoming")).distinct()
    inc = inc.withColumn("t", js_trim("incoming"))
    nm = names.select("name", "cnt", F.lower("name").alias("lname"), normalize_name("name").alias("nname"),
                      F.length("name").alias("nlen"))

    def cand(df, strategy_rank, strategy, dist=F.lit(0)):
        return df.select("incoming", F.struct(F.lit(strategy_rank).alias("sr"), dist.alias("d"),
                                              (-F.col("cnt")).alias("c"), F.col("name").alias("n")).alias("key"),
                         F.col("name").alias("resolved"), F.lit(strategy).alias("strategy"))

    live = inc.filter(F.col("t") != "")
    exact = cand(live.join(nm, F.col("t") == F.col("name")), 1, "exact")
    case = cand(live.join(nm, F.lower("t") == F.col("lname")), 2, "case-insensitive")
    norm = cand(live.join(nm, normalize_name(F.col("t")) == F.col("nname")), 3, "normalized")
    tl = F.length("t")
    pairs = _segment_candidates(live, nm).unionByName(_short_candidates(live, nm))
    lev = pairs.withColumn("dist", F.levenshtein(F.lower("t"), F.col("lname")))
    lev = cand(lev.filter((F.col("dist") > 0) & (F.col("dist") <= max_edits(tl))), 4, "levenshtein", F.col("dist"))

    allc = exact.unionByName(case).unionByName(norm).unionByName(lev)
    best = (allc.groupBy("incoming")
            .agg(F.min_by(F.struct("resolved", "strategy"), F.col("key")).alias("b"))
            .select("incoming", "b.resolved", "b.strategy"))
    out = inc.join(best, "incoming", "left")
    return out.select(
        "incoming",
        F.when(F.col("t") == "", F.col("incoming")).otherwise(F.coalesce("resolved", "t")).alias("resolved"),
        F.coalesce(F.col("strategy").isin("case-insensitive", "normalized", "levenshtein"), F.lit(False)).alias("corrected"),
        F.col("strategy"))
