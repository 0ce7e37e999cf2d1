"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

1. Numbers, units behind numbers, and names become typed placeholders that remember their value; all other
   words are lower-cased without punctuation. An item's names are the capitalised words it has inside a
   sentence, at every place where they are capitalised. A document's capitalised word may be a name or its literal
   word, wherever it stands: its windows are hashed both ways, as far as the benchmark has names at those
   places (at most 2 ** WINDOW ways for a window of capitalised words alone). An item's window with names is also matched with the names as
   literal words, so lower-cased copies are found.
2. Windows of WINDOW consecutive template tokens are hashed. The benchmark's windows are joined
   with those of the documents on the hash: broadcast up to BROADCAST_WINDOWS windows, shuffled beyond.
3. Matches are grouped by alignment (document position minus item position). Equal item values should meet equal
   document values (different ones may meet one). Where they do not, the windows count that agree with each
   item value's most frequent document value or have equal values, if they are at least MIN_AGREEING of the item's.
   So a question with other numbers or names is found, as is a copy with an edited number; a chance mixture is not.
4. A document leaks an item if the consistent alignments cover at least MIN_COVERAGE of its windows.

Defined cases: a null or empty text leaks nothing, an item without words is leaked by nothing. An
item of fewer tokens than a window is one window of its own length. Windows with fewer literal words
than MIN_LITERAL are no evidence and are left out; an item of which none would be left keeps those with most literal
words, which must meet equal values. Windows of numbers and units alone are never kept. Rows that repeat an id are judged as
one document; a null id is an id of its own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import materialize, register, text_of
from memlake.sources.tables import read_table

#: Template tokens in a window.
WINDOW = 8
#: Literal (not placeholder) tokens that a window needs.
MIN_LITERAL = 3
#: Share of an item's windows that must be found.
MIN_COVERAGE = 0.5
#: Share of an item's windows that must agree in an alignment in which an item value meets several document values.
MIN_AGREEING = 0.75
#: Benchmark windows up to which they are broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Units (fixed words) that are canonicalised behind a number.
UNITS = ("mm|cm|km|m|mg|kg|g|lb|lbs|oz|ml|cl|l|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|"
         "meters?|metres?|miles?|feet|foot|inch|inches|grams?|kilograms?|liters?|litres?|dollars?|cents?|euros?|percent|degrees?")
#: Private-use characters that open a placeholder: number, unit, name; a capitalised word elsewhere; and the one behind them.
NUM, UNIT, NAME, CAP, PAST = "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"


def _has(text: Column, *chars: str) -> Column:
    found = text.contains(chars[0])
    for c in chars[1:]:
        found = found | text.contains(c)
    return found


def canonical(text: Column, inside: bool) -> Column:
    """The text's tokens, space-joined; a placeholder is its opening character and its value.

    Capitalised words are opened by CAP, those inside a sentence by NAME if `inside`."""
    clean = F.when(_has(text, NUM, UNIT, NAME, CAP), F.regexp_replace(text, f"[{NUM}-{CAP}]", " ")).otherwise(text)
    # the look-ahead comes first: it fails at once on all but capitals
    if inside:
        clean = F.regexp_replace(clean, r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;][\x20\t\n])", NAME)
    named = F.regexp_replace(clean, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{NAME}])", CAP)
    return F.regexp_replace(named, r"[0-9]+(?:[.,][0-9]+)*", f" {NUM}$0 ")


def plain_tokens(marked: Column) -> Column:
    """Units marked behind numbers, lower case, no punctuation but inside numbers, single spaces."""
    units = F.regexp_replace(marked, rf"(?i)({NUM}[0-9.,]+\x20+)({UNITS})\b", f"$1{UNIT}$2")
    inside = F.regexp_replace(F.lower(units), rf"(?<!{NUM}[0-9.,]{{0,30}})[.,]|[^\p{{L}}\p{{N}}{NUM}-{CAP}.,]+", " ")
    numbered = F.regexp_replace(inside, r"[.,]+(?=\x20|$)|\x20{2,}", " ")
    simple = F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}{NAME}{CAP}]+", " ")
    return F.trim(F.when(_has(marked, NUM), F.regexp_replace(numbered, r"\x20{2,}", " ")).otherwise(simple))


def token_rows(df: DataFrame, id_col: str, text_col: str, inside: bool = False) -> DataFrame:
    """(id, template, values): parallel arrays; values is null where no placeholder and no capitalised word occurs.

    The template has names as literal words; their values, opened by NAME, tell them from words. With `inside` only
    words that occur capitalised inside a sentence are names."""
    rows = (df.select(F.col(id_col).alias("id"), canonical(text_of(text_col), inside).alias("marked"))
            .select("id", plain_tokens(F.col("marked")).alias("canon"))
            .select("id", _has(F.col("canon"), NUM, UNIT, NAME, CAP).alias("slotted"),
                    F.when(F.col("canon") == "", F.array().cast("array<string>")).otherwise(F.split("canon", " ")).alias("tokens")))
    template = F.when(F.col("slotted"), F.transform("tokens", lambda t: F.when(
        (t < NUM) | (t >= PAST), t).when(t >= NAME, F.substring(t, 2, 1 << 30)).otherwise(F.substring(t, 1, 1)))).otherwise(F.col("tokens"))
    named = F.transform("tokens", lambda t: F.when((t >= CAP) & (t < PAST), F.concat(F.lit(NAME), F.substring(t, 2, 1 << 30))).otherwise(t))
    if inside:
        named = F.transform(named, lambda t: F.when((t < NAME) | (t >= PAST) | F.array_contains("tokens", t), t).otherwise(F.lit("")))
    values = F.when(F.col("slotted"), F.transform(named, lambda t: F.when((t >= NUM) & (t < PAST), t).otherwise(F.lit(""))))
    return rows.select("id", template.alias("template"), values.alias("values"))


def _mask(values: Column, at: Column, size: int) -> Column:
    """The window's names as bits, its first token the lowest."""
    bits = [F.when(F.get(values, at + k) >= NAME, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(size)]
    return F.when(values.isNull(), F.lit(0)).otherwise(sum(bits[1:], bits[0]))


def _hash(hashes: Column, at: Column, size: int, mask: Column) -> Column:
    """Hash of a window from its tokens' hashes, the names in `mask` as placeholders."""
    tokens = [F.get(hashes, at + k) for k in range(size)]
    typed = [F.when(mask.bitwiseAND(1 << k) != 0, F.xxhash64(F.lit(NAME))).otherwise(t) for k, t in enumerate(tokens)]
    return F.when(mask == 0, F.xxhash64(F.lit(size), *tokens)).otherwise(F.xxhash64(F.lit(size), *typed))


def _slots(values: Column, at: Column, size: Column, mask: Column) -> Column:
    """Values of a window's placeholders, the names in `mask` among them, in order."""
    found = F.filter(F.slice(values, at + 1, size), lambda v, k: (v != "") & (
        (v < NAME) | (mask.bitwiseAND(F.get(F.array(*[F.lit(1 << j) for j in range(WINDOW)]), k)) != 0)))
    return F.when(values.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def _windows(hashes: Column, values: Column, numbers: Column, size: int, masks: list[int]) -> Column:
    """Array of (at, h, slots) of all windows of `size` tokens with names as words, and with each other mask that its capitals allow."""
    last = F.size(hashes) - size

    def window(at: Column, mask: Column, slots: Column) -> Column:
        return F.struct(at.alias("at"), _hash(hashes, at, size, mask).alias("h"), slots.alias("slots"))
    none = F.array().cast("array<string>")
    plain = F.transform(F.sequence(F.lit(0), last), lambda at: window(at, F.lit(0), F.when(
        numbers.isNotNull(), F.filter(F.slice(numbers, at + 1, F.lit(size)), lambda v: v != "")).otherwise(none)))
    named = [m for m in masks if m]
    if named:
        allowed = F.from_json(F.lit(json.dumps([[m for m in named if m & ~c == 0] for c in range(1 << size)])), "array<array<int>>")
        ways = F.transform(F.sequence(F.lit(0), last), lambda at: F.struct(
            at.alias("at"), F.get(allowed, _mask(values, at, size)).alias("masks")))
        typed = F.flatten(F.transform(F.filter(ways, lambda w: F.size(w["masks"]) > 0), lambda w: F.transform(
            w["masks"], lambda m: window(w["at"], m, _slots(values, w["at"], F.lit(size), m)))))
        plain = F.when(values.isNull(), plain).otherwise(F.concat(plain, typed))
    return F.when(last >= 0, plain)


def _hashes() -> Column:
    return F.transform("template", lambda t: F.xxhash64(t)).alias("hashes")


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, size, mask, item_id, item_pos, item_slots, exact, n_windows) of the windows that carry evidence."""
    rows = (token_rows(items, id_col, text_col, inside=True).where(F.size("template") > 0)
            .select("id", "template", "values", _hashes(), F.least(F.size("template"), F.lit(WINDOW)).alias("size")))

    words = F.transform("template", lambda t, i: ~t.isin(NUM, UNIT) & ~F.coalesce(F.get("values", i) >= NAME, F.lit(False)))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda at: F.size(
        F.filter(F.slice("words", at + 1, F.col("size")), lambda w: w))))
    usual = F.least(F.lit(MIN_LITERAL), F.col("size"))
    rows = rows.withColumn("words", words).withColumn("needed", F.least(usual, best)).withColumn("exact", F.col("needed") < usual)

    def by_size(one) -> Column:
        return F.coalesce(*[F.when(F.col("size") == n, one(n)) for n in range(1, WINDOW + 1)])
    out = rows.select(F.col("id").alias("item_id"), "size", "template", "values", "hashes", "words", "needed", "exact",
                      F.explode(F.sequence(F.lit(0), F.size("template") - F.col("size"))).alias("item_pos"))
    out = out.withColumn("names", by_size(lambda n: _mask(F.col("values"), F.col("item_pos"), n)))
    literal = F.size(F.filter(F.slice("words", F.col("item_pos") + 1, F.col("size")), lambda w: w))
    text = F.exists(F.slice("template", F.col("item_pos") + 1, F.col("size")), lambda t: ~t.isin(NUM, UNIT))
    out = (out.where((literal >= F.col("needed")) & text)
           .withColumn("mask", F.explode(F.when(F.col("exact"), F.array(F.lit(0))).otherwise(F.array_distinct(F.array("names", F.lit(0))))))
           .select("item_id", "size", "item_pos", "mask", "exact",
                   by_size(lambda n: _hash(F.col("hashes"), F.col("item_pos"), n, F.col("mask"))).alias("h"),
                   _slots(F.col("values"), F.col("item_pos"), F.col("size"), F.col("mask")).alias("item_slots")).distinct())
    totals = out.groupBy(F.col("item_id").alias("id")).agg(F.countDistinct("item_pos").alias("n_windows"))
    return out.join(totals, F.col("item_id").eqNullSafe(F.col("id"))).drop("id")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, same_values) of every leaked item."""
    bench = materialize(benchmark_windows(items), "leak_windows")
    masks: dict[int, list[int]] = {}  # at most 2 ** size numbers for each of WINDOW sizes
    for r in bench.select("size", "mask").distinct().collect():
        masks.setdefault(r["size"], []).append(r["mask"])
    side = (F.broadcast(bench) if bench.count() <= BROADCAST_WINDOWS else bench).drop("size", "mask")
    rows = token_rows(docs, id_col, text_col)
    numbers = F.transform("values", lambda v: F.when(v < NAME, v).otherwise(F.lit("")))
    rows = rows.select("id", "values", F.when(F.exists("values", lambda v: (v != "") & (v < NAME)), numbers).alias("numbers"), _hashes())
    every = [_windows(F.col("hashes"), F.col("values"), F.col("numbers"), s, masks[s]) for s in sorted(masks)] or [
        F.lit(None).cast("array<struct<at:int,h:bigint,slots:array<string>>>")]
    found = None
    for part in every:
        one = (rows.select(F.col("id").alias("doc_id"), F.explode(part).alias("w"))
               .select("doc_id", F.col("w.at").alias("doc_pos"), F.col("w.h").alias("h"), F.col("w.slots").alias("doc_slots"))
               .join(side, "h"))
        found = one if found is None else found.unionByName(one)
    pairs = F.transform(F.arrays_zip("item_slots", "doc_slots"),
                        lambda p: F.struct(p["item_slots"].alias("a"), p["doc_slots"].alias("b")))
    aligned = (found.where(F.when(F.col("exact"), F.col("item_slots") == F.col("doc_slots"))
                           .otherwise(F.size("item_slots") == F.size("doc_slots")))
               .groupBy("doc_id", "item_id", "n_windows", (F.col("doc_pos") - F.col("item_pos")).alias("shift"))
               .agg(F.collect_set(F.struct("item_pos", pairs.alias("pairs"))).alias("windows")))  # at most the item's windows, twice
    every_pair = F.flatten(F.transform("windows", lambda w: w["pairs"]))
    aligned = aligned.withColumn("pairs", F.array_distinct(every_pair))
    clash = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) < F.size("pairs")
    # of an item value's document values the most frequent one, its own before others
    ranked = F.array_sort(F.transform("pairs", lambda p: F.struct(
        p["a"].alias("a"), (-F.size(F.filter(every_pair, lambda q: q == p))).alias("n"), (p["a"] != p["b"]).alias("other"), p["b"].alias("b"))))
    bound = F.array(ranked)  # an array of one element binds what is worked out once to a lambda's variable
    major = F.element_at(F.transform(bound, lambda r: F.filter(r, lambda p, i: (i == 0) | (F.get(r, i - 1)["a"] != p["a"]))), 1)
    major = F.transform(major, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    aligned = aligned.withColumn("clash", clash).withColumn("major", F.when(clash, major))
    agreeing = F.filter("windows", lambda w: F.size(F.array_except(w["pairs"], "major")) == 0)
    equal = F.filter("windows", lambda w: F.forall(w["pairs"], lambda p: p["a"] == p["b"]))
    aligned = aligned.withColumn("at", F.array_distinct(F.transform(
        F.when(F.col("clash"), F.array_union(agreeing, equal)).otherwise(F.col("windows")), lambda w: w["item_pos"])))
    consistent = aligned.where(~F.col("clash") | (F.size("at") >= MIN_AGREEING * F.col("n_windows")))
    same = F.forall("pairs", lambda p: p["a"] == p["b"])
    leaks = (consistent.select("doc_id", "item_id", "n_windows", F.explode("at").alias("item_pos"), same.alias("same"))
             .groupBy("doc_id", "item_id", "n_windows")
             .agg(F.countDistinct("item_pos").alias("n_matched"), F.max("same").alias("same_values")))
    return (leaks.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
            .where(F.col("coverage") >= min_coverage)
            .select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "same_values"))


@register("op6_template_decontamination")
def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: one row per document and leaked item."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
