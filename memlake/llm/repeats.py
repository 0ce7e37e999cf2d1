"""Substring dedup: words covered by a window of WINDOW words that also starts in an earlier document are removed.

Suffix automata of reference shards give the matching statistics. Broadcasting the automata of all earlier documents to all
documents would be work in the square of the corpus, and nothing bounds their size; so
candidates are routed to the shards instead:

1. Every window takes as anchor the least hash of the word triples in it. Equal windows have equal
   anchors, so only windows whose anchor occurs in two documents can repeat (`anchors`, `shared`).
2. The neighbouring windows of one such anchor form a chunk. Equal chunks of an anchor collapse to one content
   with its earliest document (`chunks`, `contents`), so copies cost nothing further.
3. The contents of an anchor meet in one shard. In order of their earliest document they are streamed
   through the shard's suffix automaton of the earlier ones: the matching statistics say for each window which
   content had it first. New contents extend the automaton (`first_owners`).
   An anchor with more than HOT_CONTENTS contents is not given to one task: its windows are grouped by
   themselves, which partial aggregation keeps even (`hot_owners`).
4. Windows whose first owner is an earlier document than the row's mark words; overlapping ones merge to maximal spans.

The hashes only choose candidates; windows are compared word by word in the automaton (or as whole text in a hot anchor).

Defined cases: a null text has no words. Rows that repeat an id do not remove each other's words; a row without
an id counts as later than all that have one. Texts shorter than a window lose nothing. Empty
tables give no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import materialize, register, shuffle_partitions, text_of
from memlake.sources.tables import read_table

#: Words in a window, and in the grams among which its anchor is the least.
WINDOW, GRAM = 13, 3
#: Contents of one anchor up to which one automaton takes them.
HOT_CONTENTS = 1000
#: Bytes that are hashed together, about.
BATCH_BYTES = 1 << 20
#: The place of rows without an id: after all others.
LAST = (1 << 63) - 1

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 2**64)


class _Powers:
    """Powers of the hash's base and of its inverse modulo 2 ** 64, as many as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, _U(b))]))
                                      for b in (_PRIME, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word of `raw`, without a loop over words."""
    data = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * up[:-1])])
        return starts, _mix((total[ends] - total[starts]) * down[starts])


def window_anchors(words: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window that lies in one text; `owner` numbers the words' texts."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        gram = words[:len(words) - GRAM + 1].copy()
        for k in range(1, GRAM):
            gram = gram * _U(_PRIME) + words[k:len(words) - GRAM + 1 + k]
        gram = _mix(gram)
    width, reach = 1, window - GRAM + 1
    while 2 * width <= reach:
        gram = np.minimum(gram[:len(gram) - width], gram[width:])
        width *= 2
    if width < reach:
        gram = np.minimum(gram[:len(gram) - (reach - width)], gram[reach - width:])
    at = np.flatnonzero(owner[:n] == owner[window - 1:])
    return at, gram[:n][at]


def _joined(texts: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, after last, texts) of runs of texts of about BATCH_BYTES."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield first, i + 1, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, len(texts), held


def _hashed(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word of the texts."""
    begin = np.cumsum([0] + [len(e) + 1 for e in encoded])
    starts, hashes = word_hashes(b"\n".join(encoded))
    return hashes, np.searchsorted(begin, starts, side="right") - 1


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(oid, doc_id, body, print): order id, whole text and its hash, by which rows of one id are told apart."""
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("body"))
            .select(F.coalesce("doc_id", F.lit(LAST)).alias("oid"), "doc_id", "body", F.xxhash64("body").alias("print")))


def anchors(rows: DataFrame, window: int) -> DataFrame:
    """(h, oid, print): the anchors of every text; neighbouring windows with one anchor give one row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, prints = pdf["oid"].to_numpy(np.int64), pdf["print"].to_numpy(np.int64)
            for first, last, encoded in _joined([t.encode() for t in pdf["body"]]):
                words, owner = _hashed(encoded)
                at, anchor = window_anchors(words, owner, window)
                if len(at):
                    who = owner[at]
                    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (who[1:] != who[:-1])])
                    yield pd.DataFrame({"h": anchor[new].view(np.int64), "oid": ids[first:last][who[new]],
                                        "print": prints[first:last][who[new]]})
    return rows.select("oid", "print", "body").mapInPandas(run, "h bigint, oid bigint, print bigint")


def shared_anchors(found: DataFrame) -> DataFrame:
    """(oid, print, hs): for every text its anchors that a text of another id has too; no array holds more than one text's."""
    shared = materialize(found.groupBy("h").agg(F.min("oid").alias("a"), F.max("oid").alias("b"))
                         .where("a < b").select("h"), "repeat_shared")
    return found.join(shared, "h", "left_semi").groupBy("oid", "print").agg(F.collect_set("h").alias("hs"))


def _run_rows(encoded: list[bytes], ids: np.ndarray, prints: np.ndarray, hs: list, window: int) -> pd.DataFrame | None:
    """The chunks of some texts (their words already joined by single spaces)."""
    plain = b"\n".join(encoded)
    starts, hashes = word_hashes(plain)
    begin = np.cumsum([0] + [len(e) + 1 for e in encoded])
    owner = np.searchsorted(begin, starts, side="right") - 1
    at, anchor = window_anchors(hashes, owner, window)
    with np.errstate(over="ignore"):  # a text's shared anchors, all texts in one lookup
        keys = anchor + owner[at].astype(np.uint64) * _U(_INVERSE)
        known = (np.concatenate([np.asarray(h, np.int64) for h in hs]).view(np.uint64)
                 + np.repeat(np.arange(len(hs), dtype=np.uint64), [len(h) for h in hs]) * _U(_INVERSE))
    use = np.isin(keys, known)
    at, anchor = at[use], anchor[use]
    if not len(at):
        return None
    who = owner[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (who[1:] != who[:-1])]))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1] + window
    doc = who[new]
    ends = np.minimum(np.append(starts, len(plain) + 1)[last], begin[doc + 1]) - 1  # empty texts may follow
    text = plain.decode()
    if len(text) != len(plain):  # places in characters: continuation bytes begin none
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(plain, np.uint8) & 0xC0) != 0x80)])
        begins, ends = chars[starts[first]], chars[ends]
    else:
        begins = starts[first]
    return pd.DataFrame({"h": anchor[new].view(np.int64), "oid": ids[doc], "print": prints[doc],
                         "start": (first - np.searchsorted(owner, doc)).astype(np.int32),
                         "words": [text[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]})


def chunks(rows: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(h, content, oid, print, start, words): runs of windows with one shared anchor, as text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, prints, hs = pdf["oid"].to_numpy(np.int64), pdf["print"].to_numpy(np.int64), pdf["hs"].tolist()
            for first, last, encoded in _joined([b" ".join(t.encode().split()) for t in pdf["body"]]):
                out = _run_rows(encoded, ids[first:last], prints[first:last], hs[first:last], window)
                if out is not None:
                    yield out
    return (rows.select("oid", "print", "body").join(shared, ["oid", "print"])
            .mapInPandas(run, "h bigint, oid bigint, print bigint, start int, words string")
            .select("h", F.xxhash64("h", "words").alias("content"), "oid", "print", "start", "words"))


class SuffixAutomaton:
    """A suffix automaton over word ids; every state knows the owner of its first occurrence."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]
        self.last = 0
        self.breaks = -1

    def add(self, words: list[int], owner: int) -> None:
        """Append a text; a break that occurs nowhere else parts it from the one before."""
        for w in [self.breaks, *words]:
            self._extend(w, owner)
        self.breaks -= 1

    def _extend(self, w: int, owner: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        self.owner.append(owner)
        p = self.last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                clone = len(nxt)
                link.append(clone)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.owner.append(self.owner[q])
                link[q] = clone
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
        self.last = cur

    def first_owners(self, words: list[int], window: int) -> list[int]:
        """For each window of `words` the owner that had it first, or -1: the matching statistics, cut at `window`."""
        nxt, link, length, out = self.next, self.link, self.length, []
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                out.append(self.owner[state])
            elif i >= window - 1:
                out.append(-1)
        return out


def anchor_owners(texts: list[str], first: list[int], window: int) -> list[list[int]]:
    """For each content of one anchor the earliest document of each of its windows."""
    out: list[list[int]] = [[]] * len(texts)
    ids: dict[str, int] = {}
    automaton = SuffixAutomaton()
    for i in sorted(range(len(texts)), key=lambda i: first[i]):
        words = [ids.setdefault(w, len(ids)) for w in texts[i].split(" ")]
        found = automaton.first_owners(words, window)
        out[i] = [first[i] if f < 0 else first[f] for f in found]
        if -1 in found:
            automaton.add(words, i)
    return out


def first_owners(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """(h, content, owners) of the contents; each shard holds whole anchors."""
    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "first", "words"], kind="stable")
        h = pdf["h"].to_numpy()
        texts, first = pdf["words"].tolist(), pdf["first"].tolist()
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])).tolist()
        owners: list[list[int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            owners += anchor_owners(texts[a:b], first[a:b], window)
        return pd.DataFrame({"h": h, "content": pdf["content"].to_numpy(), "owners": owners})
    return (contents.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard")
            .applyInPandas(shard, "h bigint, content bigint, owners array<bigint>"))


def hot_owners(contents: DataFrame, window: int) -> DataFrame:
    """The same for anchors with many contents: each window's text is grouped over all contents."""
    words = F.split("words", " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1),
                          lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(window))))
    each = materialize(contents.select("h", "content", "first", F.posexplode(windows).alias("i", "window")), "repeat_hot")
    least = materialize(each.groupBy("window").agg(F.min("first").alias("owner")), "repeat_hot_least")
    return (each.join(least, "window").groupBy("h", "content")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "owner"))), lambda s: s["owner"]).alias("owners")))


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(oid, print, starts): first words of the windows that an earlier document has too."""
    found = materialize(anchors(rows, window), "repeat_anchors")
    shared = materialize(shared_anchors(found), "repeat_documents")
    pieces = materialize(chunks(rows, shared, window), "repeat_chunks")
    contents = materialize(pieces.groupBy("h", "content", "words").agg(F.min("oid").alias("first")), "repeat_contents")
    hot = materialize(contents.groupBy("h").count().where(F.col("count") > HOT_CONTENTS).select("h"), "repeat_hot_anchors")
    shards = 4 * shuffle_partitions(rows.sparkSession)
    owners = materialize(first_owners(contents.join(hot, "h", "left_anti"), window, shards)
                         .unionByName(hot_owners(contents.join(hot, "h", "left_semi"), window)), "repeat_owners")
    late = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("oid"), F.col("start") + i)), lambda s: s.isNotNull())
    return (pieces.select("h", "content", "oid", "print", "start").join(owners, ["h", "content"])
            .select("oid", "print", late.alias("starts")).where(F.size("starts") > 0)
            .groupBy("oid", "print").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))


def spans_of(starts, window: int) -> list[tuple[int, int]]:
    """Maximal [first, after last) word spans that the windows cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): the words that stay, space-joined, and the removed word spans as first:after."""
    rows = text_rows(docs, id_col, text_col)
    starts = materialize(repeated_spans(rows, window), "repeat_starts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, removed, kept, spans = [], [], [], []
            for body, late in zip(pdf["body"], pdf["starts"], strict=True):
                words = body.encode().split()
                gone = [] if late is None else spans_of(late, window)
                stay, at = [], 0
                for a, b in gone:
                    stay += words[at:a]
                    at = b
                stay += words[at:]
                n.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode())
                spans.append(",".join(f"{a}:{b}" for a, b in gone))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n, "n_removed": removed, "kept": kept, "spans": spans})
    joined = rows.join(starts, ["oid", "print"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "body", "starts")
    out = joined.mapInPandas(cut, "doc_id string, n_words bigint, n_removed bigint, kept string, spans string")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all with a smaller id."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
