"""Budgeted context assembly (assembleContext) for every project in one job.

Candidates per project: the top 50 by importance / recency (window with a group limit, so
at most 50 rows per project and task cross the shuffle). Per project the candidates are
sorted by decay score (ties keep candidate order) and folded with `aggregate` over a state
(used chars, stopped, chosen blocks): gone rows are skipped; a block that does not fit the
remaining budget is downgraded hot -> warm -> cool -> faded; the first row that fits at no
tier stops the fold. Lengths are UTF-16 code units, as the service measures them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.config import CANDIDATE_LIMIT, CHAR_BUDGET
from memlake.functions.format import CONTEXT_TITLE, tier_blocks
from memlake.functions.text import token_estimate, utf16_length
from memlake.operators.candidates import scored, top_candidates_per_project

CHAIN = ("hot", "warm", "cool", "faded")


def packed_items(mem: DataFrame, now: int, budget: int = CHAR_BUDGET, limit: int = CANDIDATE_LIMIT,
                 owner=None) -> DataFrame:
    """(project, pos, hash, tier, block_len, block) for the items each project's block holds."""
    return pack(top_candidates_per_project(mem, limit, owner), "project", now, budget)


def pack(cands: DataFrame, group: str, now: int, budget: int = CHAR_BUDGET) -> DataFrame:
    """assembleContext for every group of ranked candidates (`rank` = candidate order).

    Returns (group, pos, hash, tier, block_len, block)."""
    c = scored(cands, now)
    blocks = tier_blocks()
    c = c.select(F.col(group).alias("_g"), "rank", "hash", "score", "fidelity",
                 *[blocks[t].alias(f"b_{t}") for t in CHAIN])
    c = c.select("*", *[utf16_length(f"b_{t}").alias(f"l_{t}") for t in CHAIN])
    item = F.struct((-F.col("score")).alias("neg_score"), F.col("rank").alias("rank"), "hash",
                    F.col("fidelity").alias("tier"), *[f"l_{t}" for t in CHAIN], *[f"b_{t}" for t in CHAIN])
    per_group = c.groupBy("_g").agg(F.sort_array(F.collect_list(item)).alias("items"))

    chosen_t = "struct<hash:string,tier:string,len:int,block:string>"
    init = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"),
                    F.array().cast(f"array<{chosen_t}>").alias("out"))

    def step(acc, it):
        rem = F.lit(budget) - acc["used"]
        skip = acc["stop"] | (it["tier"] == "gone")
        start = F.when(it["tier"] == "hot", 0).when(it["tier"] == "warm", 1).when(it["tier"] == "cool", 2).otherwise(3)
        pick = None
        for i, t in enumerate(CHAIN):
            cond = (start <= i) & (it[f"l_{t}"] <= rem)
            pick = F.when(cond, F.lit(t)) if pick is None else pick.when(cond, F.lit(t))
        tier = pick  # NULL when nothing fits
        length = (F.when(tier == "hot", it["l_hot"]).when(tier == "warm", it["l_warm"])
                  .when(tier == "cool", it["l_cool"]).otherwise(it["l_faded"]))
        block = (F.when(tier == "hot", it["b_hot"]).when(tier == "warm", it["b_warm"])
                 .when(tier == "cool", it["b_cool"]).otherwise(it["b_faded"]))
        taken = F.struct((acc["used"] + length).alias("used"), F.lit(False).alias("stop"),
                         F.array_append(acc["out"], F.struct(it["hash"].alias("hash"), tier.alias("tier"),
                                                             length.alias("len"), block.alias("block"))).alias("out"))
        stopped = F.struct(acc["used"].alias("used"), F.lit(True).alias("stop"), acc["out"].alias("out"))
        return F.when(skip, acc).when(tier.isNull(), stopped).otherwise(taken)

    folded = per_group.select("_g", F.aggregate("items", init, step)["out"].alias("out"))
    return folded.select("_g", F.posexplode("out").alias("pos", "c")).select(
        F.col("_g").alias(group), (F.col("pos") + 1).alias("pos"), "c.hash", "c.tier",
        F.col("c.len").alias("block_len"), F.col("c.block").alias("block"))


def context_blocks(items: DataFrame, budget: int = CHAR_BUDGET, group: str = "project") -> DataFrame:
    """(group, n_items, used_chars, context): header plus blocks joined by newlines."""
    g = (items.groupBy(group)
         .agg(F.count("*").alias("n_items"), F.sum("block_len").alias("used_chars"),
              F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("bl")))
    header = F.concat(F.lit(CONTEXT_TITLE + "\n_"), F.col("n_items").cast("string"), F.lit(" memories loaded | ~"),
                      token_estimate("used_chars").cast("string"), F.lit(f"/{int(budget / 4 + 0.5)} tokens | "),
                      F.col("used_chars").cast("string"), F.lit(" chars_\n\n"))
    return g.select(group, "n_items", F.col("used_chars").cast("bigint").alias("used_chars"),
                    F.concat(header, F.array_join(F.transform("bl", lambda x: x["block"]), "\n")).alias("context"))
