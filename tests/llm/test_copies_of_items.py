"""Copies of benchmark items: few plain words, other case, one edited slot."""

from tidewatch.llm import decontamination

LONG = (
    "The farmer keeps 12 sheep on a hill near a river and sells wool at every market in spring while"
    " The miller grinds corn for 12 villages along a road that leads to some old stone bridge"
)
ITEMS = {
    1: "What is 12 + 45 - 7?",
    2: "Great Expectations Bleak House Hard Times Little Dorrit Our Mutual Friend Barnaby Rudge Oliver Twist",
    3: "Ask Tom And Ann Why Their Uncle Paid For It. Then ask Bob about a boat, Sue about tea.",
    4: LONG,
}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(ITEMS.items()), "item_id bigint, text string")
    rows = decontamination.contamination(docs, items).where("contaminated").collect()
    return {r["doc_id"]: r["item_ids"] for r in rows}


def test_copies(spark):
    texts = [f"so then: {ITEMS[1]} indeed", f"we read {ITEMS[2]} last year"]  # few plain words
    texts += [ITEMS[3].lower(), ITEMS[3].upper(), ITEMS[2].lower()]  # case
    texts += [LONG.replace("while The", "while This"), LONG.replace("for 12", "for 99")]  # one of two equal slots
    texts += ["nothing of all this is said in here by anyone at all"]
    assert found(spark, texts) == {0: [1], 1: [2], 2: [3], 3: [3], 4: [2], 5: [4], 6: [4]}
