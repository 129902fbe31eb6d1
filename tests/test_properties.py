import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from storytrack.operators import history as H
from storytrack.operators import merge as M

T0 = dt.datetime(2020, 1, 1)

samples_st = st.lists(
    st.tuples(st.integers(0, 5), st.integers(1, 10_000), st.integers(-100, 1000)),
    min_size=1, max_size=40, unique_by=lambda t: (t[0], t[1]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(samples_st)
def test_replaying_samples_leaves_latest_state(spark, samples):
    rows = [(s, T0 + dt.timedelta(minutes=m), 0, 0, 0, sc, float(sc), sc % 7, sc % 2) for s, m, sc in samples]
    hist = spark.createDataFrame(rows, "story long, timestamp timestamp, tie1 long, tie2 long, tie3 long, "
                                       "score int, hotness double, comments int, gilded int")
    story = spark.createDataFrame([(s, str(s), 0, 0.0, 0, 0, T0, T0) for s in range(6)],
                                  "id long, reddit_short_id string, score int, hotness double, comments int, "
                                  "gilded int, updated_at timestamp, checked_at timestamp")
    after = {r.id: (r.score, r.comments, r.updated_at) for r in
             M.apply_samples(story, hist.select("story", "timestamp", "score", "hotness", "comments", "gilded"))
             .collect()}
    latest = {r.story: (r.score, r.comments, r.updated_at) for r in H.latest_state(hist).collect()}
    for sid in range(6):
        assert after[sid] == latest.get(sid, (0, 0, T0))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(samples_st)
def test_chunked_arrays_concatenate_to_whole(spark, samples):
    rows = [(s, T0 + dt.timedelta(minutes=m), 0, 0, 0, sc, 0.0, 0, 0) for s, m, sc in samples]
    hist = spark.createDataFrame(rows, "story long, timestamp timestamp, tie1 long, tie2 long, tie3 long, "
                                       "score int, hotness double, comments int, gilded int")
    whole = {r.story: r.score for r in H.history_arrays(hist, max_points=None).collect()}
    parts = {}
    for r in sorted(H.history_arrays(hist, max_points=3).collect(), key=lambda r: (r.story, r.chunk)):
        assert len(r.score) <= 3
        parts.setdefault(r.story, []).extend(r.score)
    assert parts == whole
