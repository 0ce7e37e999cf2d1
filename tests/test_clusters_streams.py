"""k-means against a plain model of the service's loop; streams equal their batch jobs."""

from __future__ import annotations

import numpy as np

from conftest import SF_SMALL
from memlake.operators import clusters as K
from memlake.sources import fixtures as FX


def model_kmeans(hashes, vecs, k=5, max_iter=20):
    """kMeansClusters with the seeded start (k smallest hashes)."""
    order = np.argsort(hashes)
    cent = np.array([vecs[i] for i in order[:k]], dtype=float)
    n = len(vecs)
    assign = np.zeros(n, dtype=int)
    for _ in range(max_iter):
        changed = False
        for i in range(n):
            best, best_sim = 0, -1.0
            for c in range(k):
                a, b = vecs[i], cent[c]
                den = np.linalg.norm(a) * np.linalg.norm(b)
                sim = float(a @ b / den) if den > 0 else 0.0
                if sim > best_sim:
                    best_sim, best = sim, c
            if assign[i] != best:
                assign[i] = best
                changed = True
        if not changed:
            break
        for c in range(k):
            mem = [vecs[i] for i in range(n) if assign[i] == c]
            if mem:
                cent[c] = np.mean(mem, axis=0)
    return {hashes[i]: int(assign[i]) for i in range(n)}


def test_lloyd_matches_model(spark):
    items = FX.cluster_items(spark, SF_SMALL)
    rows = items.collect()
    hashes = [r["hash"] for r in rows]
    vecs = [np.array(r["vec"], dtype=float) for r in rows]
    exp = model_kmeans(hashes, vecs)
    a, cent, iters = K.lloyd(spark, items)
    got = {r["hash"]: r["cluster_id"] for r in a.collect()}
    assert got == exp
    assert 1 <= iters <= 20 and cent.shape[0] == 5


def test_mllib_kmeans_runs(spark):
    out = K.mllib_kmeans(FX.cluster_items(spark, SF_SMALL))
    assert out.count() == FX.cluster_items(spark, SF_SMALL).count()
    assert out.select("cluster_id").distinct().count() <= 5


def test_streams_equal_batch(spark, queries):
    q, _ = queries
    for stream, batch in (("stream_touch_rollup", "touch_rollup"), ("stream_snapshot_changes", "snapshot_change_detection")):
        a = sorted(q[stream](spark, SF_SMALL).collect())
        b = sorted(q[batch](spark, SF_SMALL).collect())
        assert a == b, stream


def test_stream_ingest_equals_batch(spark, queries):
    q, _ = queries
    a = sorted(tuple(r) for r in q["stream_ingest"](spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in q["ingest_documents"](spark, SF_SMALL).collect())
    assert a == b


def test_access_stream_dedupe(spark, tmp_path):
    """Duplicate access events (same memory, same second) count once with dedupe on."""
    from memlake.streaming import jobs as J
    src = tmp_path / "acc"
    rows = [("a" * 16, 100), ("a" * 16, 100), ("a" * 16, 160), ("b" * 16, 50)]
    spark.createDataFrame(rows, "hash string, ts long").write.parquet(str(src))
    stream = spark.readStream.schema("hash string, ts long").parquet(str(src))
    out = J.work_dir(spark, "dedupe-test")
    q = J.access_rollup_stream(spark, stream, out, dedupe_watermark="1 hour")
    q.awaitTermination()
    got = {r["hash"][0]: (r["last_touch"], r["touches"]) for r in J.touch_state(spark, out).collect()}
    assert got == {"a": (160, 2), "b": (50, 1)}
