"""The reference's decay / fidelity / formatting / packing cases, plus a brute-force model of
context packing compared with the Spark fold on random candidates."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from conftest import memories_df, memory_row
from memlake.config import DEFAULT_THRESHOLDS, Thresholds
from memlake.functions.decay import decay_score, fidelity, threshold_scale
from memlake.functions.format import format_memory
from memlake.operators import context as X

NOW = 1_700_000_000


def _score(spark, importance, hours):
    df = spark.createDataFrame([(importance, NOW - int(hours * 3600))], "importance double, last_accessed bigint")
    return df.select(decay_score(now=NOW).alias("s")).first()["s"]


def test_decay_points(spark):
    assert _score(spark, 4.0, 0) == 4.0
    assert 3.9 < _score(spark, 4.0, 1) < 4.0
    assert 1.0 < _score(spark, 4.0, 100) < 2.0
    assert 0.0 < _score(spark, 1.0, 1000) < 0.01


def test_decay_monotone(spark):
    rows = [(3.0, NOW - h * 3600) for h in range(0, 500, 7)]
    df = spark.createDataFrame(rows, "importance double, last_accessed bigint")
    s = [r["s"] for r in df.select(decay_score(now=NOW).alias("s")).collect()]
    assert all(a >= b for a, b in zip(s, s[1:]))


def test_fidelity_tiers(spark):
    df = spark.createDataFrame([(3.0,), (1.5,), (0.5,), (0.05,), (0.005,)], "score double")
    assert [r["f"] for r in df.select(fidelity("score").alias("f")).collect()] == ["hot", "warm", "cool", "faded", "gone"]


def test_effective_thresholds(spark):
    df = spark.createDataFrame([(8000.0, 8000.0), (1000.0, 8000.0)], "b double, m double")
    k = [r["k"] for r in df.select(threshold_scale("b", "m").alias("k")).collect()]
    assert k[0] == 1.0
    assert k[1] > 1.0 and DEFAULT_THRESHOLDS.hot * k[1] > DEFAULT_THRESHOLDS.hot


def test_format_by_tier(spark):
    m = memories_df(spark, [memory_row()]).withColumn("score", F.lit(3.5))
    text = {t: m.select(format_memory(F.lit(t)).alias("x")).first()["x"] for t in ("hot", "warm", "cool", "faded", "gone")}
    assert "This is the full text of the memory." in text["hot"] and text["hot"].startswith("## 🔴 [abc1234]")
    assert "Summary of the memory." in text["warm"] and "full text" not in text["warm"]
    assert "Memory essence" in text["cool"]
    assert text["faded"].startswith("## ⚪ [abc1234] @test-project — Memory essence")
    assert text["gone"] == ""


def test_pack_order_and_empty(spark):
    rows = [memory_row(hash="h" * 16, importance=5.0, now=NOW, project="p"),
            memory_row(hash="l" * 16, importance=3.0, now=NOW, project="p"),
            memory_row(hash="o" * 16, importance=1.0, last_accessed=NOW - 500 * 3600, now=NOW, project="p")]
    items = X.packed_items(memories_df(spark, rows), NOW, budget=5000).orderBy("pos").collect()
    assert items[0]["hash"] == "h" * 16
    assert X.packed_items(memories_df(spark, rows).limit(0), NOW).count() == 0


def test_pack_budget(spark):
    rows = [memory_row(hash=f"{i:016d}", importance=5.0, full_text="x" * 500, now=NOW, project="p") for i in range(20)]
    blk = X.context_blocks(X.packed_items(memories_df(spark, rows), NOW, budget=2000)).first()
    assert blk["used_chars"] <= 2000
    assert len(blk["context"]) <= 2500


# ---------------------------------------------------------------- brute-force model

def _u16(s):
    return sum(2 if ord(c) > 0xFFFF else 1 for c in s)


def _model_pack(cands, budget, th=Thresholds()):
    """assembleContext as the service runs it, on dicts with score and block texts."""
    order = sorted(range(len(cands)), key=lambda i: (-cands[i]["score"], i))
    used, out = 0, []
    for i in order:
        c = cands[i]
        s = c["score"]
        tier = "hot" if s >= th.hot else "warm" if s >= th.warm else "cool" if s >= th.cool else "faded" if s >= th.faded else "gone"
        if tier == "gone":
            continue
        rem = budget - used
        chain = ["hot", "warm", "cool", "faded"]
        chosen = None
        for t in chain[chain.index(tier):]:
            if _u16(c["blocks"][t]) <= rem:
                chosen = t
                break
        if chosen is None:
            break
        out.append((c["hash"], chosen))
        used += _u16(c["blocks"][chosen])
    return out


def test_pack_matches_model(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        rows.append(memory_row(hash=f"{rnd.randrange(16**15):016x}", importance=float(rnd.randint(1, 5)),
                               last_accessed=NOW - rnd.randint(0, 400) * 3600, now=NOW,
                               full_text="w" * rnd.randint(10, 3000), summary_text="s" * rnd.randint(5, 300),
                               essence_text="e" * rnd.randint(1, 60), project="p" if i % 2 else "q",
                               tags=["a", "b"][: rnd.randint(0, 2)]))
    mem = memories_df(spark, rows)
    from memlake.functions.format import tier_blocks
    from memlake.operators.candidates import scored, top_candidates_per_project
    c = scored(top_candidates_per_project(mem, 50), NOW)
    b = tier_blocks()
    cands = c.select("project", "rank", "hash", "score", *[b[t].alias(t) for t in ("hot", "warm", "cool", "faded")]).collect()
    got = {(r["project"], r["pos"]): (r["hash"], r["tier"]) for r in X.packed_items(mem, NOW, budget=3000).collect()}
    for p in ("p", "q"):
        pc = sorted([r for r in cands if r["project"] == p], key=lambda r: r["rank"])
        model = _model_pack([{"hash": r["hash"], "score": r["score"],
                              "blocks": {t: r[t] for t in ("hot", "warm", "cool", "faded")}} for r in pc], 3000)
        assert [got[(p, i + 1)] for i in range(len(model))] == model
        assert (p, len(model) + 1) not in got
    assert math.isfinite(sum(r["score"] for r in cands))
