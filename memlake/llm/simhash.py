"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints: 64 majority bits over the XXH64 values of a text's word shingles.

Links: two fingerprints differ in at most 2 * r bits exactly if some value lies within r bits of
both. So every distinct fingerprint emits all variants within r bits (2,081 for r = 2), the
variants are shuffled to buckets, and equal variants mark linked fingerprints. All fingerprints of one
variant are linked with each other by construction; a star to the smallest of them (each pair of it
verified by its bit count) says as much as all pairs, and a bucket sends on only a spanning forest.

Variants travel as packed arrays (8 bytes and a 2-byte mask number each), in ROUNDS rounds by the
parities of the variant, so that the disk holds one round's share at a time; parities are linear, so a
round generates only its own variants.

Classes: the links are contracted to stars of smallest labels (each node and its neighbours move to the
smallest neighbour) with a written table per step; no task sees a whole class.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; shorter texts than a
shingle are one shingle. Rows that repeat an id are rows of their own. Null ids do not count for the smallest id;
a class with only null ids has a null class id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import materialize, register, text_of
from memlake.sources.tables import read_table

#: Words in a shingle, and bits in which linked fingerprints may differ (even).
SHINGLE_WORDS, MAX_BITS = 4, 4
#: Seed of XXH64.
HASH_SEED = 42
#: Rounds of variants (a power of two).
ROUNDS = 8
#: Variants in a bucket, about.
BUCKET_VARIANTS = 1 << 20
#: Fingerprints whose variants are made at once.
BLOCK = 512

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]
#: Bits over which the parities that pick the round are taken.
_PARITY = np.array([0x5B3C96A7F10D4E28, 0xC6A51E8F3972D04B, 0x39E7A4D2586B1FC0], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = text.encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        digests = xxhash.xxh64_digest(joined, HASH_SEED)
    else:
        ends = list(accumulate(map(len, words)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0, *(e + 1 for e in ends[:n - shingle])]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1:], strict=True)])
    values = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((values + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers."""
    @F.pandas_udf("bigint")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return docs.select(F.col(id_col).alias("doc_id"), signed(text_of(text_col)).alias("fp"))


def ball_masks(radius: int) -> np.ndarray:
    """All 64-bit masks with at most `radius` bits."""
    bits = [1 << i for i in range(64)]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def _parities(x: np.ndarray, rounds: int) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for j in range(rounds.bit_length() - 1):
        out |= (np.bitwise_count(x & _PARITY[j]).astype(np.int64) & 1) << j
    return out


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def variants(fps: DataFrame, radius: int, rounds: int, turn: int, buckets: int) -> DataFrame:
    """(bucket, keys, flips): the variants whose parities name this turn, packed."""
    masks = ball_masks(radius)
    kind = _parities(masks, rounds)
    chosen = [np.flatnonzero(kind == k) for k in range(rounds)]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(own), BLOCK):
                block = own[at:at + BLOCK]
                cls = _parities(block, rounds)
                keys, flips = [], []
                for k in range(rounds):
                    some = block[cls == k]
                    pick = chosen[k ^ turn]
                    keys.append((some[:, None] ^ masks[pick][None, :]).ravel())
                    flips.append(np.tile(pick.astype(np.uint16), len(some)))
                key, flip = np.concatenate(keys), np.concatenate(flips)
                where = _bucket(key, buckets)
                order = np.argsort(where, kind="stable")
                key, flip, where = key[order], flip[order], where[order]
                first = np.flatnonzero(np.diff(where, prepend=-1))
                last = np.append(first[1:], len(where))
                yield pd.DataFrame({"bucket": where[first],
                                    "keys": [key[a:b].tobytes() for a, b in zip(first, last, strict=True)],
                                    "flips": [flip[a:b].tobytes() for a, b in zip(first, last, strict=True)]})
    return fps.select("fp").mapInPandas(pack, "bucket bigint, keys binary, flips binary")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the links a-b, without the roots themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def colliding(packed: DataFrame, radius: int) -> DataFrame:
    """(hi, lo): a spanning forest of the links that the buckets' equal variants prove."""
    masks = ball_masks(radius)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        own = key ^ masks[np.frombuffer(b"".join(pdf["flips"]), np.uint16)]
        order = np.argsort(key)
        key, own = key[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        star = np.minimum.reduceat(own, first)
        several = np.repeat(size > 1, size)
        own, star = own[several], np.repeat(star[size > 1], size[size > 1])
        true = (own != star) & (np.bitwise_count(own ^ star) <= 2 * radius)
        pairs = np.unique(np.stack([own[true], star[true]], axis=1), axis=0) if true.any() else np.empty((0, 2), np.uint64)
        hi, lo = _forest(pairs[:, 0], pairs[:, 1])
        return pd.DataFrame({"hi": hi.view(np.int64), "lo": lo.view(np.int64)})
    return packed.groupBy("bucket").applyInPandas(links, "hi bigint, lo bigint")


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, rounds: int = ROUNDS) -> DataFrame:
    """(hi, lo): links whose components are those of all pairs within `max_bits` bits.

    `fps` holds distinct fingerprints in a written table."""
    radius = max_bits // 2
    if max_bits != 2 * radius:
        raise ValueError("max_bits must be even")
    size = max(1, fps.count() * len(ball_masks(radius)) // rounds)
    buckets = max(1, -(-size // BUCKET_VARIANTS))
    found = [materialize(colliding(variants(fps, radius, rounds, t, buckets), radius), f"simhash_links{t}")
             for t in range(rounds)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def contract(links: DataFrame) -> DataFrame:
    """(hi, lo): every node of the links but the smallest of each component, with that smallest."""
    stars = materialize(links, "stars")
    while True:
        both = stars.select("hi", "lo").unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = materialize(both.groupBy(F.col("hi").alias("node")).agg(
            F.least(F.min("lo"), F.first("hi")).alias("low"), F.max("lo").alias("high"), F.min("lo").alias("least")), "stars_low")
        # done when every node that has a smaller neighbour has no other
        open_nodes = low.where("least < node and high <> least").limit(1).count()
        if not open_nodes:
            return stars
        moved = both.join(low.select("node", "low"), both["hi"] == F.col("node"))
        stars = materialize(moved.select(F.col("lo").alias("a"), "low")
                            .unionByName(low.select(F.col("node").alias("a"), "low"))
                            .where("a <> low").select(F.greatest("a", "low").alias("hi"), F.least("a", "low").alias("lo"))
                            .distinct(), "stars")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash_rows")
    own = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash_fps")
    stars = contract(link_fingerprints(own.select("fp"), max_bits))
    rooted = (own.join(stars, own["fp"] == stars["hi"], "left")
              .select("fp", F.coalesce("lo", "fp").alias("root"), "least_id"))
    least = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash_roots")
    classes = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash_classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


@register("op9_simhash_neardup")
def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprint and class by links of at most four differing bits."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
