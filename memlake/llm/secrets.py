"""Secret scan in DataFrame operations only: fixed patterns, and the Shannon entropy of a window
that slides over candidate strings.

Positions: a pattern's matches and the pieces between them (`regexp_extract_all`, `split`)
alternate, so running lengths give every match's start in code points.

Entropy: a candidate is a run of token characters with a letter and a digit. It is judged as a whole, by
the narrowest of CLASSES that holds all of it, and so is each maximal run of a narrower class in it that
would be a candidate by itself: the value in KEY=VALUE is judged as it would be behind a space. The window moves one
character at a time; the counts of the entering and the leaving character change by one, and with them
sum(c * log2 c), from which the entropy follows. Windows above the class's threshold are merged to spans,
over all runs of a candidate. A candidate that matches the allow-list is suppressed with all its runs, a run that matches it
by itself, and a span that lies inside a pattern's span.

No shuffle: each text is judged in its own row, whole, whatever its length. Running positions and the spans inside a pattern's
are worked out in blocks of the square root of the number of matches, so very long texts with very many matches stay cheap.

Defined cases: a null text counts as empty and gives no span; every input row gives one row,
repeated rows too. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import register, text_of
from memlake.sources.tables import read_table

#: Base patterns (fixed values): kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same matches, found faster: no shorter run can pass, and a run's tail cannot pass where the run failed.
FAST = {"access": r"AKIA[A-Z0-9]{14,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+"}
#: Token characters, in the order of their count index.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Window length in characters.
WINDOW = 20
#: Candidates: maximal runs of at least WINDOW token characters with a letter and a digit.
CANDIDATE = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])"
             r"[A-Za-z0-9+/_=-]{20,}+")
#: Character classes, narrowest first: name, characters, least entropy in bits per character.
CLASSES = (("hex", r"[0-9A-Fa-f]+", 3.0), ("alnum", r"[0-9A-Za-z]+", 3.6), ("base64", r"[A-Za-z0-9+/_=-]+", 3.8))
#: Candidates inside a candidate: the maximal runs of a narrower class, of at least WINDOW characters with a letter and a digit.
INNER = {
    "hex": r"(?<![0-9A-Fa-f])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{20,}+",
    "alnum": r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[0-9A-Za-z]{20,}+",
}
#: Candidates that are no secrets: UUIDs, dates and times, documentation keys, masks, paths of plain words.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9-]*Z?$",
    r"(?i)example|placeholder|changeme|dummy",
    r"^(.)\1+$|x{6,}|X{6,}",
    r"^/?([A-Za-z]{2,}[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}/?$",
)


def _scan(items: Column, zero: Column, fold: Callable, emit: Callable, row_type: str) -> Column:
    """Array of emit(state before the item, item), the state folded over `items` from left to right.

    A fold that appends to an array copies it at every step. So the items are cut into blocks of about the square root of their
    number: one fold carries the state from block to block, one inside each block makes its rows."""
    empty = F.array().cast(f"array<{row_type}>")

    def carried(b: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(b))).cast("int"))
        starts = F.sequence(F.lit(1), F.size(b), width)
        return F.aggregate(starts, F.struct(zero.alias("state"), F.slice(F.array(F.struct(zero.alias("state"), b.alias("block"))), 1, 0).alias("out")),
                           lambda acc, at: into(acc, F.slice(b, at, width)), lambda acc: acc["out"])

    def into(acc: Column, block: Column) -> Column:
        one = F.struct(acc["state"].alias("state"), block.alias("block"))
        return F.struct(F.aggregate(block, acc["state"], fold).alias("state"), F.concat(acc["out"], F.array(one)).alias("out"))

    def rows(block: Column) -> Column:
        return F.aggregate(block["block"], F.struct(block["state"].alias("state"), empty.alias("out")), lambda acc, m: F.struct(
            fold(acc["state"], m).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], m))).alias("out")), lambda acc: acc["out"])
    # an array of one element binds the items, worked out once, to a lambda's variable
    return F.flatten(F.transform(F.array(items), lambda b: F.when(
        F.size(b) > 0, F.flatten(F.transform(carried(b), rows))).otherwise(empty)))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (hit, part, start): each match, its group and its start in code points."""
    lit = F.lit(pattern)
    hits = F.regexp_extract_all(text, lit, F.lit(0))
    parts = F.regexp_extract_all(text, lit, F.lit(group)) if group else hits
    gaps = F.split(text, lit, -1)
    zipped = F.arrays_zip(hits.alias("hit"), parts.alias("part"),
                          F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    row_type = "struct<hit:string,part:string,start:int>"
    found = _scan(zipped, F.lit(0), lambda at, m: at + F.length(m["gap"]) + F.length(m["hit"]),
                  lambda at, m: F.struct(m["hit"].alias("hit"), m["part"].alias("part"), (at + F.length(m["gap"])).alias("start")), row_type)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{row_type}>"))


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _span(kind: str, rank: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column) -> list[Column]:
    """For each base kind, the array of its spans."""
    def one(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(_matches(text, FAST.get(kind, pattern), group), lambda m: F.length(m["part"]) >= least)
        return F.transform(kept, lambda m: _span(
            kind, rank, m["start"], m["start"] + F.length(m["hit"]))).cast(_SPANS)
    return [one(rank, *row) for rank, row in enumerate(BASE)]


def _threshold(token: Column) -> Column:
    limit = F.lit(CLASSES[-1][2])
    for _, chars, least in reversed(CLASSES[:-1]):
        limit = F.when(token.rlike(f"^{chars}$"), F.lit(least)).otherwise(limit)
    return limit


_RANGES = "array<struct<start:int,end:int>>"


def _allowed(token: Column) -> Column:
    return token.rlike("|".join(f"(?:{p})" for p in ALLOW[:3] + ALLOW[4:])) | token.rlike(ALLOW[3])


def _runs(token: Column) -> Column:
    """Array of (run, start, least): the token, and the candidates of narrower classes in it."""
    def run(text: Column, start: Column, least: Column) -> Column:
        return F.struct(text.alias("run"), start.cast("int").alias("start"), least.cast("double").alias("least"))
    found = [F.array(run(token, F.lit(0), _threshold(token)))]
    for name, chars, least in CLASSES[:-1]:
        inner = F.filter(_matches(token, INNER[name], 0), lambda m: ~_allowed(m["hit"]))
        limit = F.lit(least)
        runs = F.transform(inner, lambda m: run(m["hit"], m["start"], limit))  # noqa: B023
        found.append(F.when(token.rlike(f"^{chars}$"), F.slice(found[0], 1, 0)).otherwise(runs))
    return F.concat(*found)


def _merged(ranges: Column) -> Column:
    """Sorted ranges, those that overlap or touch made one."""
    start = F.struct(F.lit(-1).alias("open"), F.lit(-1).alias("end"), F.array().cast(_RANGES).alias("out"))

    def close(acc: Column) -> Column:
        one = F.array(F.struct(acc["open"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["open"] >= 0, F.concat(acc["out"], one)).otherwise(acc["out"])

    def step(acc: Column, r: Column) -> Column:
        joins = (acc["open"] >= 0) & (r["start"] <= acc["end"])
        return F.struct(F.when(joins, acc["open"]).otherwise(r["start"]).alias("open"),
                        F.when(joins, F.greatest(acc["end"], r["end"])).otherwise(r["end"]).alias("end"),
                        F.when(joins, acc["out"]).otherwise(close(acc)).alias("out"))
    return F.aggregate(F.array_sort(ranges), start, step, close)


def entropy_windows(token: Column, window: int = WINDOW) -> Column:
    """Merged [start, end) ranges of the windows of `token` whose entropy reaches the threshold of a run that holds them."""
    def ranges(r: Column) -> Column:
        codes = F.transform(F.split(r["run"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        # an array of one element binds what is worked out once per run to a lambda's variable
        bound = F.array(F.struct(codes.alias("codes"), F.length(r["run"]).alias("n")))
        found = F.element_at(F.transform(bound, lambda b: _slide(b["codes"], b["n"], r["least"], window)), 1)
        return F.transform(found, lambda f: F.struct((r["start"] + f["start"]).alias("start"), (r["start"] + f["end"]).alias("end")))
    return _merged(F.flatten(F.transform(_runs(token), ranges)))


def _slide(codes: Column, length: Column, threshold: Column, window: int) -> Column:
    f = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    bits, scale = math.log2(window), float(window)
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
                     F.lit(-1).alias("open"), F.lit(-1).alias("end"), F.array().cast(_RANGES).alias("out"))

    def change(acc: Column, code: Column, by: int) -> Column:
        n = F.get(acc["counts"], code)
        return F.struct(
            F.transform(acc["counts"], lambda v, j: F.when(j == code, v + F.lit(by)).otherwise(v)).alias("counts"),
            (acc["sum"] + F.get(f, n + by) - F.get(f, n)).alias("sum"),
            acc["open"].alias("open"), acc["end"].alias("end"), acc["out"].alias("out"))

    def close(acc: Column) -> Column:
        one = F.array(F.struct(acc["open"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["open"] >= 0, F.concat(acc["out"], one)).otherwise(acc["out"])

    def mark(acc: Column, i: Column) -> Column:
        high = (i >= window) & ((F.lit(bits) - acc["sum"] / scale) >= threshold - 1e-9)
        joins = (acc["open"] >= 0) & (i - window <= acc["end"])
        return F.struct(
            acc["counts"].alias("counts"), acc["sum"].alias("sum"),
            F.when(high & ~joins, i - window).otherwise(acc["open"]).alias("open"),
            F.when(high, i).otherwise(acc["end"]).alias("end"),
            F.when(high & ~joins, close(acc)).otherwise(acc["out"]).alias("out"))

    # one entering and one leaving character a step, each its own fold item, so that no nested
    # expression repeats the former state
    moves = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda i: F.array(
        F.struct(F.lit(-1).alias("by"), i.alias("i"), F.get(codes, i - window - 1).alias("code")),
        F.struct(F.lit(1).alias("by"), i.alias("i"), F.get(codes, i - 1).alias("code")),
        F.struct(F.lit(0).alias("by"), i.alias("i"), F.lit(None).cast("int").alias("code")))))

    def step(acc: Column, m: Column) -> Column:
        return (F.when(m["by"] == 0, mark(acc, m["i"]))
                .when(m["code"].isNull(), acc)
                .when(m["by"] == 1, change(acc, m["code"], 1))
                .otherwise(change(acc, m["code"], -1)))
    return F.aggregate(moves, start, step, close)


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy in the candidates of `text` that no allow-list pattern matches."""
    found = F.filter(_matches(text, CANDIDATE, 0), lambda m: ~_allowed(m["hit"]))

    def spans(m: Column) -> Column:
        ranges = entropy_windows(m["hit"])
        return F.transform(ranges, lambda r: _span("entropy", len(BASE), m["start"] + r["start"], m["start"] + r["end"]))
    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(found, spans)).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, entropy): arrays of spans (start, rank, end, kind) in code points."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    assign, access, hexes = base_spans(F.col("body"))
    rows = rows.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"),
                       entropy_spans(F.col("body")).alias("entropy"))
    # by start, pattern spans first: an entropy span lies in a pattern's if the greatest end so far reaches its own
    spans = F.array_sort(F.concat("assign", "access", "hex", "entropy"))
    judged = _scan(spans, F.lit(0), lambda reach, s: F.when(s["rank"] < len(BASE), F.greatest(reach, s["end"])).otherwise(reach),
                   lambda reach, s: F.struct(s.alias("span"), (reach >= s["end"]).alias("inside")),
                   "struct<span:struct<start:int,rank:int,end:int,kind:string>,inside:boolean>")
    kept = F.transform(F.filter(judged, lambda j: (j["span"]["rank"] == len(BASE)) & ~j["inside"]), lambda j: j["span"])
    both = (F.size("entropy") > 0) & (F.size("assign") + F.size("access") + F.size("hex") > 0)
    return rows.withColumn("entropy", F.when(both, kept).otherwise(F.col("entropy")))


def span_list(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@register("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    rows = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return rows.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.concat(base, "entropy")).alias("spans"))
