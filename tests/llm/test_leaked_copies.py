"""Verbatim copies of items with few plain words, and copies with one changed placeholder."""

from quillstream.llm import decontaminate

SHORT = "What is the largest river that flows through southern France"
POOR = "Anna Smith paid 5 USD, Bob Jones paid 7 USD"
TINY = "add 5 kg and 7"
LONG = (
    "a farmer has 5 cows and sells some of them at the market for a good price while the other animals stay at home in the old barn near the river"
    " where they eat grass and 5 more cows come back later in the evening"
)
TWO = "a shop sells 7 red pens and later it buys 5 blue pens from another shop before it closes in the evening"


def _leaks(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontaminate.find_leaks(docs, items).collect()}


def test_verbatim_copies_of_any_words(spark):
    docs = [f"words before it, {POOR} and after", f"so {TINY} now", f"list:\n- {SHORT}\n", f"see 1) {SHORT}", f"some title\n{SHORT}\nmore", f"then {SHORT.lower()} ok"]
    want = {(0, 0): False, (1, 1): False, (2, 2): False, (3, 2): False, (4, 2): False, (5, 2): False}
    assert _leaks(spark, [POOR, TINY, SHORT], docs) == want
    assert _leaks(spark, [POOR, TINY], ["Anna Smith paid 5 USD, Bob Jones paid 8 USD", "so add 5 kg and 8 now"]) == {}


def test_a_reworded_item_after_a_line_break(spark):
    item = "What does Anna pay when she buys 3 large apples today"
    assert _leaks(spark, [item], ["some title\n" + item.replace("Anna", "Bob").replace("3", "4")]) == {(0, 0): True}
