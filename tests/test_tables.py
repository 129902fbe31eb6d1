from pyspark.sql import functions as F

from conftest import SF
from storytrack.operators import history as H
from storytrack.sources import archive as A
from storytrack.sources import tables as T


def test_canonical_layout_roundtrip(spark):
    root = A.scratch_path(spark, "t-canonical")
    T.write_canonical(spark, SF, root)
    tabs = T.read_canonical(spark, root)
    assert tabs["story"].count() == T.stories(spark, SF).count()
    h = tabs["story_history"]
    assert "day" in h.columns and h.count() == T.story_history(spark, SF).count()
    # Latest state computed from the stored layout equals the one from the binding.
    a = H.latest_state(h.drop("day")).select("story", "score")
    b = H.latest_state(T.story_history(spark, SF)).select("story", "score")
    assert a.exceptAll(b).count() == 0
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        h.filter(F.col("day") == "1996-01-02").explain()
    assert "PartitionFilters: [isnotnull(day" in buf.getvalue()  # partition pruning


def test_bindings_have_canonical_schemas(spark):
    from storytrack import schemas as S
    assert [f.name for f in T.stories(spark, SF).schema] == [f.name for f in S.STORY]
    assert [f.name for f in T.subreddits(spark, SF).schema] == [f.name for f in S.SUBREDDIT]
    assert [f.name for f in T.story_history(spark, SF).schema] == [f.name for f in S.STORY_HISTORY]
    assert [f.name for f in T.subreddit_history(spark, SF).schema] == [f.name for f in S.SUBREDDIT_HISTORY]


def test_bucketed_history_aggregates_without_shuffle(spark):
    root = A.scratch_path(spark, "t-bucketed")
    names = T.write_bucketed(spark, SF, root, buckets=4, prefix="tb")
    h = spark.table(names["story_history"])
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        H.latest_state(h).explain()
    assert "Exchange hashpartitioning" not in buf.getvalue()
    a = H.latest_state(h).select("story", "score")
    b = H.latest_state(T.story_history(spark, SF)).select("story", "score")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    st = spark.table(names["story"])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        st.join(h.withColumnRenamed("story", "id"), "id").explain()
    assert "Exchange hashpartitioning" not in buf.getvalue()


def test_pages_are_shuffled_once(spark):
    """The pages' children are grouped where the window for their ticks has brought them."""
    plan = T._build_listing_pages(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(feed") + plan.count("Exchange hashpartitioning(_feed") == 1
