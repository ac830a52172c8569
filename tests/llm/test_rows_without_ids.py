"""Rows are judged by id and text: null and repeated ids get the verdict of their own text."""
import random

from caseloom.llm import decontaminate, near_dedup
from test_duplicates import changed, prose

BIG = 2**60 + 1   # no float has it


def test_one_row_of_each_group_stays(docs):
    r = random.Random(21)
    a, b, c, d = (prose(r, 200) for _ in range(4))
    rows = [(3, a), (5, changed(r, a, 1)), (5, b), (None, changed(r, b, 1)),      # id 5 goes with a and stays with b
            (BIG, c), (BIG, changed(r, c, 1)), (None, changed(r, c, 2)),           # one id, two near copies
            (None, d), (None, changed(r, d, 1)), (None, changed(r, d, 2)),         # no id at all
            (None, ""), (None, None)]
    left = [(x.doc_id, x.text) for x in near_dedup.keep_one(docs(rows)).collect()]
    family = lambda text: [x for x in left if x[1] and len(set(x[1].split()) & set(text.split())) > 100]
    assert family(a) == [rows[0]] and family(b) == [rows[2]]
    assert [x[0] for x in family(c)] == [BIG] and [x[0] for x in family(d)] == [None]
    assert (None, "") in left and (None, None) in left and len(left) == 6


def test_leaks_by_row(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = [(None, "x a b c"), (None, "z"), (4, "q"), (4, "a b c q"), (BIG, "a b c"), (5, None), (None, None)]
    left = {(x.doc_id, x.text) for x in decontaminate.clean(docs(rows), items).collect()}
    assert left == {(None, "z"), (4, "q"), (5, None), (None, None)}
