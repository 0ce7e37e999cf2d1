"""Phrase collocation mining with HAT-trie counting.

Counting. Each task feeds the word sequences of its texts into a HAT-trie: a shallow trie over word ids whose leaves are hash
containers of packed suffixes; a container that outgrows BURST entries bursts into a node with one container per next word.
When the trie outgrows its memory, whole subtrees are spilled, largest first, as packed runs sorted by phrase. The runs are dealt by
prefix (language and a hash of the first two words; about PREFIX_BYTES of text for each partition) and merged there. A merge
holds its partition's runs: the frequent phrases of these prefixes, once per task and spill.

Filter. A phrase can only occur `min_count` times if its parts do. Two passes count phrases of one and two words, and of three and
four words that consist of frequent pairs, by KEY_BITS of their hash, in sorted runs of packed keys that are merged per piece of
the key space. What stays below `min_count` is not fed to the trie. A bitmap of each pass's frequent keys goes to all tasks, about
FILTER_SHARE bits a key and at most 2 ** MAX_FILTER_BITS bits (8 MB): with more keys it lets more through, as collisions do. The
result does not depend on the filters.

Scores come from joins of the frequent phrases with themselves. One-word parts are shared by many phrases, so the joins are salted.
Every join is hinted to shuffle and merge: Spark sizes a side by the compressed file it is read from, not by the rows that salts and
spans are exploded to, and would copy gigabytes through the driver.

Defined cases: a null or empty text has no words; a null language is `und`; words are whole whatever their length; a text
longer than SLICE_BYTES is read by itself. Rows that repeat an id or a text count each time. An empty table gives no rows. Ties
are broken as stated (score, count, phrase). Other columns are ignored.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import materialize, register
from memlake.sources.tables import read_table

#: Least occurrences of a phrase, most words in it, share (percent) of a longer phrase that hides a shorter one, rows per language.
MIN_COUNT, MAX_WORDS, HIDING_PERCENT, TOP = 30, 4, 80, 2000
#: Bits of a counted key; keys in a run; bytes of text for one piece of the key space; filter bits a frequent key, and at most.
KEY_BITS, RUN_KEYS, PIECE_BYTES, FILTER_SHARE, MAX_FILTER_BITS = 40, 4_000_000, 4 << 20, 32, 26
#: Bytes of text read at once; entries at which a container bursts; entries and words held by a task before it spills; words fed at once.
SLICE_BYTES, BURST, TRIE_ENTRIES, TASK_WORDS, FEED_WORDS = 4 << 20, 4096, 300_000, 300_000, 700_000
#: Bytes of text for one prefix partition; entries that are cut into runs together.
PREFIX_BYTES, RUN_ENTRIES = 4 << 20, 100_000
#: Copies of a one-word and of a longer part in the joins.
WORD_SALTS, PART_SALTS = 32, 4

_BREAK = b"\xff"  # in no UTF-8 text
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class Words(dict):
    """Word ids of one task and language; a word's hash is the same in every task."""

    def __init__(self, lang: bytes):
        super().__init__({_BREAK: 0})
        self.names, self.hashes, self.seed = [_BREAK], array("Q", [0]), xxhash.xxh64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return i

    def read(self, texts: list[bytes]) -> np.ndarray:
        """The word ids of the texts, 0 between pieces."""
        words = _BREAK.join(texts).translate(_BYTES).replace(_BREAK, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Filter:
    """A bitmap over the leading bits of the keys."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def holds(self, key: np.ndarray) -> np.ndarray:
        at = (key >> np.uint64(KEY_BITS - self.bits)).astype(np.int64)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def phrases(words: Words, ids: np.ndarray, filters: list[Filter], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, key, open) for k words: the key of the phrase at every place, and whether all that is known lets it be frequent."""
    h = np.frombuffer(words.hashes, np.uint64)[ids]
    with np.errstate(over="ignore"):
        turned = (h >> np.uint64(29)) ^ h * np.uint64(0x165667B19E3779F9)
        mixed, ok = h, ids > 0
        for k in range(1, min(upto, len(ids)) + 1):
            if k > 1:
                mixed = mixed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ turned[k - 1:]
                ok = ok[:-1] & ok[1:]
            key = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEY_BITS)
            if (k - 1) // 2 < len(filters):
                at = np.flatnonzero(ok)
                ok = np.zeros(len(key), bool)
                ok[at[filters[(k - 1) // 2].holds(key[at])]] = True
            yield k, key, ok


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """(language, texts) of about SLICE_BYTES, from batches of (lang, text as binary)."""
    for b in batches:
        held, size = {}, 0
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            held.setdefault(lang.as_py(), []).append(text)
            size += len(text)
            if size >= SLICE_BYTES:
                yield from held.items()
                held, size = {}, 0
        yield from held.items()


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def frequent_filter(docs: DataFrame, size: int, min_count: int, filters: list[Filter], max_words: int) -> Filter:
    """The filter of the phrases of the next two lengths that occur `min_count` times, from (lang, text) as binary of `size` bytes."""
    done = 2 * len(filters)
    piece_bits = min(20, max(6, (size // PIECE_BYTES).bit_length()))
    low_bits, enough = KEY_BITS - piece_bits, min(min_count, 65_535)
    schema = pa.schema([("piece", pa.int64()), ("low", pa.binary()), ("n", pa.binary())])

    def count(batches):
        held, total, by_lang = [], 0, {}

        def run():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            n = np.minimum(n, enough).astype(np.uint16)
            piece, low = key >> np.uint64(low_bits), (key & np.uint64((1 << low_bits) - 1)).astype("<u8")
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            ends = np.append(first[1:], len(key))
            # 5 bytes hold 40 bits
            low = low.view(np.uint8).reshape(-1, 8)[:, :5]
            for i in range(0, len(first), 1024):
                some = list(zip(first[i:i + 1024].tolist(), ends[i:i + 1024].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(piece[first[i:i + 1024]].astype(np.int64)),
                                                  pa.array([low[x:y].tobytes() for x, y in some], pa.binary()),
                                                  pa.array([n[x:y].tobytes() for x, y in some], pa.binary())], schema=schema)
        for lang, texts in slices(batches):
            if sum(map(len, by_lang.values())) > TASK_WORDS:
                by_lang = {}
            words = by_lang.setdefault(lang, Words(lang))
            ids = words.read(texts)
            own = [key[ok] for k, key, ok in phrases(words, ids, filters, min(done + 2, max_words)) if k > done]
            held += own
            total += sum(map(len, own))
            if total >= RUN_KEYS:
                yield from run()
                held, total = [], 0
        if total:
            yield from run()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.zeros((sum(map(len, pdf["low"])) // 5, 8), np.uint8)
        low[:, :5] = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, 5)
        key, n = _summed(low.view("<u8").ravel(), np.frombuffer(b"".join(pdf["n"]), np.uint16).astype(np.int64))
        key = key[n >= enough]
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "n": [len(key)], "low": [key.tobytes()]})
    merged = materialize(docs.mapInArrow(count, "piece bigint, low binary, n binary").groupBy("piece")
                         .applyInPandas(merge, "piece bigint, n bigint, low binary"), "collocation_filter")
    wanted = (merged.agg(F.sum("n")).first()[0] or 0) * FILTER_SHARE
    bits = min(MAX_FILTER_BITS, max(piece_bits + 3, wanted.bit_length()))
    own = 1 << (bits - piece_bits)

    def mark(batches):
        for pdf in batches:
            out = []
            for low in pdf["low"]:
                often = np.zeros(own, bool)
                often[(np.frombuffer(low, np.uint64) >> np.uint64(KEY_BITS - bits)).astype(np.int64)] = True
                out.append(np.packbits(often).tobytes())
            yield pd.DataFrame({"piece": pdf["piece"], "often": out})
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged.where("n > 0").mapInPandas(mark, "piece bigint, often binary").collect():  # at most 2 ** MAX_FILTER_BITS bits in all
        packed[r["piece"] * own // 8:(r["piece"] + 1) * own // 8] = np.frombuffer(r["often"], np.uint8)
    return Filter(bits, packed)


class HatTrie:
    """Counts of word-id sequences packed as big-endian 4-byte ids.

    A child is a container (dict of packed suffix to count) or, once burst, a node (list of own count and children)."""

    def __init__(self, burst: int = BURST):
        self.kids: dict[bytes, dict | list] = {}
        self.sizes: dict[bytes, int] = {}
        self.entries, self.burst = 0, burst

    def add(self, path: bytes, count: int) -> None:
        kids, first, at = self.kids, path[:4], 4
        head = first
        while True:
            child = kids.get(head)
            if child is None:
                child = kids[head] = {}
            suffix = path[at:]
            if type(child) is dict:
                old = child.get(suffix)
                child[suffix] = count if old is None else old + count
                if old is None:
                    self.entries += 1
                    self.sizes[first] = self.sizes.get(first, 0) + 1
                    if len(child) > self.burst:
                        kids[head] = self._split(child)
                return
            if not suffix:
                child[0] += count
                return
            kids, head, at = child[1], suffix[:4], at + 4

    @staticmethod
    def _split(container: dict) -> list:
        kids: dict[bytes, dict] = {}
        for suffix, n in container.items():
            if suffix:
                kids.setdefault(suffix[:4], {})[suffix[4:]] = n
        return [container.get(b"", 0), kids]

    def spill(self, keep: int = 0) -> Iterator[list[tuple[bytes, int]]]:
        """Take out whole subtrees, largest first, until at most `keep` entries are left."""
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                return
            self.entries -= self.sizes.pop(first)
            yield list(self._entries(first, self.kids.pop(first)))

    def _entries(self, path: bytes, child: dict | list) -> Iterator[tuple[bytes, int]]:
        if type(child) is dict:
            yield from ((path + suffix, n) for suffix, n in child.items())
            return
        if child[0]:
            yield path, child[0]
        for head, kid in child[1].items():
            yield from self._entries(path + head, kid)


def feed(trie: HatTrie, words: Words, ids: np.ndarray, filters: list[Filter], max_words: int) -> None:
    """Count the phrases of one slice that pass the filters."""
    packed, kids = ids.astype(">u4").tobytes(), trie.kids
    at, prefix = np.arange(len(ids)), ids
    for k, _, ok in phrases(words, ids, filters, max_words):
        # `prefix` numbers the phrases of k - 1 words that start at the places `at`
        some = at < len(ok)
        at, prefix = at[some], prefix[some]
        some = ok[at]
        at, prefix = at[some], prefix[some]
        key = prefix if k == 1 else prefix << 32 | ids[at + k - 1]
        _, where, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if k > 1:
            prefix = number
        for i, c in zip(at[where].tolist(), count.tolist(), strict=True):
            child, suffix = kids.get(packed[4 * i:4 * i + 4]), packed[4 * i + 4:4 * (i + k)]
            if type(child) is dict and suffix in child:  # the common case of `add`
                child[suffix] += c
            else:
                trie.add(packed[4 * i:4 * (i + k)], c)


def runs(docs: DataFrame, filters: list[Filter], max_words: int, parts: int) -> DataFrame:
    """(lang, part, phrases, n): sorted runs of phrases, packed, with their counts; the empty phrase counts all words."""
    schema = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("phrases", pa.binary()), ("n", pa.binary())])
    form = {4 * k: f">{k}I" for k in range(1, max_words + 1)}

    def packed(lang, by_part):
        out = []
        for part, entries in by_part.items():
            entries.sort()
            phrase, n = zip(*entries, strict=True)
            out.append({"lang": lang, "part": part, "phrases": b"\n".join(phrase), "n": np.array(n, np.int64).tobytes()})
        return pa.RecordBatch.from_pylist(out, schema)

    def rows(lang, words, spilled):
        name, seed, where, by_part, size = words.names, words.seed, {}, {}, 0
        for run in spilled:
            for p, n in run:
                phrase = b" ".join([name[i] for i in struct.unpack(form[len(p)], p)])
                part = where.get(p[:8])
                if part is None:
                    part = where[p[:8]] = xxhash.xxh64_intdigest(b" ".join(phrase.split(b" ", 2)[:2]), seed) % parts
                by_part.setdefault(part, []).append((phrase, n))
            size += len(run)
            if size >= RUN_ENTRIES:
                yield packed(lang, by_part)
                by_part, size = {}, 0
        if size:
            yield packed(lang, by_part)

    def count(batches):
        held, total = {}, {}

        def take(lang):
            words, trie, waiting = held[lang]
            if waiting:
                feed(trie, words, np.concatenate(waiting), filters, max_words)
                waiting.clear()
        for lang, texts in slices(batches):
            words, trie, waiting = held.setdefault(lang, (Words(lang), HatTrie(), []))
            ids = words.read(texts)
            total[lang] = total.get(lang, 0) + int(np.count_nonzero(ids))
            waiting += [ids, np.zeros(1, np.int64)]
            if sum(map(len, waiting)) >= FEED_WORDS:
                take(lang)
            if sum(len(w) for w, _, _ in held.values()) > TASK_WORDS:
                for key, (w, t, _) in held.items():
                    take(key)
                    yield from rows(key.decode(), w, t.spill())
                held = {}
            elif sum(t.entries for _, t, _ in held.values()) > TRIE_ENTRIES:
                for key, (w, t, _) in held.items():
                    yield from rows(key.decode(), w, t.spill(t.entries // 2))
        for key, (w, t, _) in held.items():
            take(key)
            yield from rows(key.decode(), w, t.spill())
        if total:
            yield pa.RecordBatch.from_pylist([{"lang": k.decode(), "part": -1, "phrases": b"", "n": np.array([v]).tobytes()}
                                              for k, v in total.items()], schema)
    return docs.mapInArrow(count, "lang string, part bigint, phrases binary, n binary")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, f) of every phrase of up to `max_words` words with f >= `min_count`; the empty phrase counts all words."""
    own = docs.select(F.coalesce(F.col("lang"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    filters: list[Filter] = []
    while 2 * len(filters) < max_words:
        filters.append(frequent_filter(own, size, min_count, filters, max_words))
    parts = max(8, size // PREFIX_BYTES)

    def merge(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for phrases, n in zip(table.column("phrases").to_pylist(), table.column("n").to_pylist(), strict=True):
            for p, c in zip(phrases.split(b"\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                total[p] = total.get(p, 0) + c
        often = [(p, c) for p, c in total.items() if c >= min_count or not p]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(often), pa.string()),
                         "phrase": pa.array([p for p, _ in often], pa.binary()).cast(pa.string()), "f": pa.array([c for _, c in often], pa.int64())})
    return runs(own, filters, max_words, parts).groupBy("lang", "part").applyInArrow(merge, "lang string, phrase string, f bigint")


def _exact(c: str) -> str:
    return f"CAST({c} AS DECIMAL(20, 0))"


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, hiding: int = HIDING_PERCENT,
                 top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    counted = materialize(phrase_counts(docs, min_count, max_words), "collocation_counts")
    known = counted.where("phrase <> ''").withColumn("words", F.split("phrase", " "))
    cand = known.where("size(words) > 1").withColumnRenamed("f", "a")

    # the two parts of every cut meet their counts
    def part(words):
        return F.array_join(words, " ").alias("part")
    cuts = cand.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    rest = F.size("words") - F.col("k")
    parts = (cuts.select("lang", "phrase", "a", "k", F.lit(True).alias("is_first"), F.col("k").alias("size"), part(F.slice("words", 1, F.col("k"))))
             .unionByName(cuts.select("lang", "phrase", "a", "k", F.lit(False).alias("is_first"), rest.alias("size"),
                                      part(F.slice("words", F.col("k") + 1, rest)))))
    salts = F.when(F.col("size") == 1, WORD_SALTS).otherwise(PART_SALTS)
    lookup = (known.select("lang", F.col("phrase").alias("part"), "f", F.size("words").alias("size"))
              .select("lang", "part", "f", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    met = parts.withColumn("salt", F.pmod(F.xxhash64("phrase", "k"), salts).cast("int")).join(lookup.hint("merge"), ["lang", "part", "salt"])
    sums = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"),
                                                       F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r"))
    score = F.expr(f"{_exact('a')} * CAST(2000000 AS DECIMAL(7, 0)) DIV ({_exact('l')} + {_exact('r')})").cast("bigint")
    best = sums.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    # a candidate hides inside a longer one that occurs nearly as often
    n = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longest = (cand.where("size(words) > 2").select("lang", F.explode(spans).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = (best.join(longest.hint("merge"), ["lang", "phrase"], "left")
            .where(f"longer IS NULL OR CAST(100 AS DECIMAL(3, 0)) * {_exact('longer')} < CAST({hiding} AS DECIMAL(3, 0)) * {_exact('a')}")
            .select("lang", "phrase", "a", "b.score", "b.l", "b.r"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = (left.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # one language may hold most rows
            .withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).where(f"_rank <= {top}"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(f"rank <= {top}")
    totals = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = "\n  UNION ALL ".join(
    f"SELECT lang, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS phrase, {k} AS size "
    f"FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, MAX_WORDS + 1))


@register("op13_phrase_collocations", rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM t),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, phrase, size, count(*) AS f FROM (
  {_GRAMS}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1),
k AS (SELECT *, array_to_string(list_slice(w, 1, k), ' ') AS p1, array_to_string(list_slice(w, k + 1, size), ' ') AS p2
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, g1.f AS l, g2.f AS r, CAST(CAST(k.a AS HUGEINT) * 2000000 // (CAST(g1.f AS HUGEINT) + g2.f) AS BIGINT) AS score
  FROM k JOIN g g1 ON g1.lang = k.lang AND g1.phrase = k.p1 JOIN g g2 ON g2.lang = k.lang AND g2.phrase = k.p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_spans AS (SELECT lang, a, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM (
  SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2))),
hidden AS (SELECT lang, phrase, max(a) AS longer FROM inner_spans GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN hidden h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE h.longer IS NULL OR CAST(h.longer AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * {HIDING_PERCENT})
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}""")
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the 2,000 strongest phrases of two to four words per language."""
    return collocations(read_table(spark, sf_dir, "documents"))
