"""Template decontamination: copies, other parameters, chance overlaps, edge cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.llm import decontaminate as D

QUESTION = "A train left Paris with 40 people and after 12 km another 40 people boarded while Anna counted 7 bags on board."
ITEMS = [(1, QUESTION), (2, "short item text"), (3, None), (4, ""), (5, "A boat left " + " ".join(reversed(QUESTION.split()))),
         (None, "an item without any identifier that is still long enough to be matched somewhere")]


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit(5))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    return {(r.doc_id, r.item_id): r.same_values for r in D.find_leaks(d, b).collect()}


def test_copies_and_reparameterised_questions(spark):
    other = QUESTION.replace("40", "55").replace("Paris", "Lyon").replace("12", "3.5").replace("Anna", "Bertha")
    mixed = QUESTION.replace("40 people and", "41 people and")  # 40 is now two values in one question
    docs = [(1, "Before it. " + QUESTION + " After it."), (2, "so " + other + " end"), (3, mixed), (4, None), (5, ""),
            (6, "we saw a SHORT item, text here"), (7, "short item of text"), (None, QUESTION), (8, QUESTION.upper()),
            (9, " ".join(QUESTION.split()[:9])), (10, "word " * 30_000 + QUESTION), (1, "the same id again"),
            (11, "an item without any identifier that is still long enough to be matched somewhere")]
    got = run(spark, docs)
    assert got[1, 1] is True and got[None, 1] is True and got[10, 1] is True
    assert got[2, 1] is False
    assert (3, 1) not in got and (9, 1) not in got and (4, 1) not in got
    assert got[6, 2] is True and (7, 2) not in got and (11, None) in got
    assert not any(i == 5 for _, i in got)


def test_names_are_names_wherever_they_stand(spark):
    items = [(1, "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"), (2, "What is the capital of France?"),
             (3, "In the year 1990 the city of Paris had 12 bridges and Lyon had only 7.")]
    docs = [(i, items[0][1].replace("Tom", "Anna")) for i in (1,)] + [
        (2, "Quiz\nWhat is the capital of France?"), (3, "so what is the capital of Spain"), (4, "WHAT IS THE CAPITAL OF FRANCE"),
        (5, items[2][1].lower()), (6, "Tom Tom Tom and Anna Has The Apples Of France And Spain In The Year"),
        (7, "Anna has. " + items[0][1].replace("Tom", "Bertha").replace("5", "9")), (8, "what was the capital of france"),
        (9, "Ｗhat \uf900 豈 Is The capital of France"), (10, "Ｗhat is the capital of France")]
    got = run(spark, docs, items)
    assert got == {(1, 1): False, (2, 2): True, (3, 2): False, (4, 2): True, (5, 3): True, (7, 1): False}


def test_short_items_with_few_literal_words_are_found_with_their_values(spark):
    items = [(1, "What is 12 + 7?"), (2, "Compute 12 * 34 + 56"), (3, "12 + 7"), (4, "go to Paris"), (5, "add 3 4 5 6 7 8 9 10 11 12")]
    docs = [(1, "Quiz: What is 12 + 7? Nineteen."), (2, "what is 12 + 8?"), (3, "Now compute 12 * 34 + 56."), (4, "compute 12 * 34 + 57"),
            (5, "12 + 7"), (6, "they go to Paris"), (7, "they go to Rome"), (8, "so add 3 4 5 6 7 8 9 10 11 12 now")]
    assert run(spark, docs, items) == {(1, 1): True, (3, 2): True, (6, 4): True, (8, 5): True}


def test_edited_copies_and_slots_that_get_one_value(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    items = [(1, " ".join(["in 2019 the first", *words, "and in 2019 the last was seen by all of them"])),
             (2, "In the basket are 3 apples and 5 pears, how many pieces of fruit are there now?")]
    docs = [(1, items[0][1].replace("2019 the last", "2020 the last")), (2, items[0][1].replace("2019 the first", "2020 the first")),
            (3, items[1][1].replace("3", "4").replace("5", "4")), (4, items[0][1].replace("2019", "2020"))]
    assert run(spark, docs, items) == {(1, 1): False, (2, 1): False, (3, 2): False, (4, 1): False}


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, QUESTION)], []) == {}


def test_every_whole_passage_is_found_and_nothing_else(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet").collect()
    items = [(r.item_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{sf_check}/benchmark.parquet").collect()]
    whole = {(d.doc_id, i) for d in docs for i, t in items if t in " ".join((d.text or "").split())}
    got = {(r.doc_id, r.item_id) for r in D.op6_template_decontamination(spark, sf_check).collect()}
    assert whole and whole <= got
    for d, i in got - whole:  # what more is found holds at least half of the passage's words in its order
        text = dict((x.doc_id, x.text) for x in docs)[d]
        words = dict(items)[i].split()
        grams = {" ".join(words[k:k + 8]) for k in range(len(words) - 7)}
        assert sum(g in " ".join(text.split()) for g in grams) >= 0.4 * len(grams)
