"""Deletes along declared keys, and the orphan audit."""

import pytest

from storytrack.operators import cascade as C
from storytrack.operators import merge as M


@pytest.fixture()
def tables(spark):
    return {
        "subreddit": spark.createDataFrame([(0,), (1,), (2,)], "id long"),
        "subreddit_history": spark.createDataFrame([(0, 1), (0, 2), (1, 3), (None, 4)], "subreddit long, active int"),
        "story": spark.createDataFrame([(10, 0), (11, 1), (12, 0), (13, None), (14, 2)], "id long, subreddit long"),
        "story_history": spark.createDataFrame([(10, 1), (11, 1), (12, 1), (12, 2), (13, 5), (None, 9)], "story long, score int"),
    }


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def rows(frames):
    return {k: sorted(map(tuple, v.collect()), key=str) for k, v in frames.items()}


def test_one_function_gives_the_three_deletes(spark, tables):
    got = rows(C.cascade(tables, {"subreddit": ids(spark, 0, 0, 77)}))
    plain = M.delete_subreddits(tables["subreddit"], tables["subreddit_history"], tables["story"],
                                tables["story_history"], ids(spark, 0))
    for name, want in zip(("subreddit", "subreddit_history", "story", "story_history"), plain, strict=True):
        assert got[name] == sorted((tuple(r) for r in want.select(tables[name].columns).collect()), key=str)
    got = rows(C.cascade(tables, {"story": ids(spark, 11)}))
    left, history = M.delete_stories(tables["story"], tables["story_history"], ids(spark, 11))
    assert got["story"] == sorted((tuple(r) for r in left.select("id", "subreddit").collect()), key=str)
    assert got["story_history"] == sorted((tuple(r) for r in history.select("story", "score").collect()), key=str)
    assert got["subreddit"] == rows(tables)["subreddit"]


def test_roots_in_several_tables_and_none(spark, tables):
    got = rows(C.cascade(tables, {"subreddit": ids(spark, 1), "story": ids(spark, 14, 10)}))
    assert got["story"] == [(12, 0), (13, None)] and got["subreddit_history"] == [(0, 1), (0, 2), (None, 4)]
    assert got["story_history"] == [(12, 1), (12, 2), (13, 5), (None, 9)]
    assert rows(C.cascade(tables, {})) == rows(tables)
    assert rows(C.cascade(tables, {"story": ids(spark).limit(0)})) == rows(tables)


def test_a_row_with_two_parents_goes_with_either(spark):
    keys = (C.ForeignKey("c", "a_id", "a"), C.ForeignKey("c", "b_id", "b"))
    tables = {"a": ids(spark, 1, 2), "b": ids(spark, 1, 2),
              "c": spark.createDataFrame([(1, 2), (2, 1), (2, 2), (None, 2)], "a_id long, b_id long")}
    got = C.cascade(tables, {"a": ids(spark, 1), "b": ids(spark, 1)}, keys)
    assert sorted(map(tuple, got["c"].collect()), key=str) == [(2, 2), (None, 2)]


def test_parents_come_first_and_cycles_are_errors():
    order = C.delete_order(["story_history", "story", "subreddit", "subreddit_history"])
    assert order.index("subreddit") < order.index("story") < order.index("story_history")
    keys = [C.ForeignKey("a", "b", "b"), C.ForeignKey("b", "a", "a")]
    with pytest.raises(ValueError, match="cycle"):
        C.delete_order(["a", "b"], keys)


def test_orphans(spark, tables):
    held = dict(tables, subreddit=ids(spark, 1))
    got = {(r.child, r.column): (r.references, r.orphans) for r in C.orphans(held).collect()}
    assert got == {("story", "subreddit"): (4, 3), ("story_history", "story"): (5, 0), ("subreddit_history", "subreddit"): (3, 2)}
    whole = C.cascade(tables, {"subreddit": ids(spark, 0, 2)})
    assert sum(r.orphans for r in C.orphans(whole).collect()) == 0
    only = C.orphans({k: tables[k] for k in ("story", "story_history")}).collect()
    assert [(r.child, r.orphans) for r in only] == [("story_history", 0)]
