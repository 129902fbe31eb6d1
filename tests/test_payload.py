import json

import pytest
from pyspark.sql import functions as F

from storytrack.sources import payload as P


def page(children, kind="Listing", after="t3_z"):
    return json.dumps({"kind": kind, "data": {"before": None, "after": after, "children": children}})


def story(**kw):
    base = {"id": "a", "title": "t", "author": "u", "created_utc": 1435795200.0, "domain": "d",
            "num_comments": 3, "gilded": 0, "score": 10, "permalink": "/p", "selftext": "",
            "subreddit": "news", "thumbnail": "", "url": "http://u", "distinguished": None,
            "is_self": False, "over_18": False, "sticked": True}
    base.update(kw)
    return {"kind": "t3", "data": base}


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "page long, value string")


def test_listing_cursors_and_positions(spark):
    df = frame(spark, [page([story(id="a"), story(id="b")])])
    rows = P.parse_listing(df).orderBy("pos").collect()
    assert [(r.pos, r.kind, r.before, r.after) for r in rows] == [(0, "t3", "", "t3_z"), (1, "t3", "", "t3_z")]


def test_page_rejects(spark):
    df = frame(spark, ["not json", page([], kind="t3"), page([story()])])
    rej = {r.page: r.reason for r in P.listing_page_rejects(df).collect()}
    assert rej == {0: "malformed", 1: "not_listing"}
    assert P.parse_listing(df).count() == 1


def test_child_rejects_and_defaults(spark):
    kids = [story(id="ok"), {"kind": "t5", "data": {"id": "x"}}, story(id="bad", score="many"),
            story(id=None), {"kind": "t3", "data": "oops"}]
    absent = story(id="absent")
    del absent["data"]["score"]
    del absent["data"]["num_comments"]
    kids.append(absent)
    df = frame(spark, [page(kids)])
    children = P.parse_listing(df)
    reasons = {r.pos: r.reason for r in P.thing_rejects(children).collect()}
    assert reasons == {1: "wrong_kind", 2: "bad_value", 3: "missing_field", 4: "malformed"}
    good = {r.short_id: r for r in P.story_fields(P.parse_things(children)).collect()}
    assert set(good) == {"ok", "absent"}
    assert good["absent"].score == 0 and good["absent"].comments == 0
    ok = good["ok"]
    assert ok.selftext is None and ok.thumbnail is None and ok.stickied is True and ok.score == 10
    assert str(ok.created_at) == "2015-07-02 00:00:00"


def test_strict_mode_raises(spark):
    df = frame(spark, [page([{"kind": "t5", "data": {"id": "x"}}])])
    with pytest.raises(Exception):
        P.parse_things(P.parse_listing(df), strict=True).collect()


def test_about_payload(spark):
    body = {"kind": "t5", "data": {"id": "2qh3l", "display_name": "news", "title": "News",
                                   "public_description": "", "subscribers": 7, "accounts_active": 3,
                                   "comment_score_hide_mins": 60, "created": 1201233135.0}}
    df = spark.createDataFrame([("news", 200, json.dumps(body))], "requested string, status int, value string")
    r = P.parse_about(df).first()
    assert (r.name, r.summary, r.subscribers, r.active, r.comment_hide_mins) == ("news", None, 7, 3, 60)


def test_read_landed_files_lines_and_whole(spark, tmp_path_factory):
    from storytrack.sources import archive as A
    root = A.scratch_path(spark, "t-landed")
    import os
    os.makedirs(root)
    with open(f"{root}/page-0.json", "w") as fh:
        fh.write(page([story(id="a"), story(id="b")]) + "\n" + page([story(id="c")]) + "\n")
    lines = P.read_landed(spark, root)
    assert sorted(r.short_id for r in P.parse_story_pages(lines).collect()) == ["a", "b", "c"]
    os.makedirs(f"{root}-whole")
    with open(f"{root}-whole/page-0.json", "w") as fh:
        fh.write(json.dumps(json.loads(page([story(id="z")])), indent=2))   # one pretty-printed envelope
    whole = P.read_landed(spark, f"{root}-whole", whole_file=True)
    assert [r.short_id for r in P.parse_story_pages(whole).collect()] == ["z"]


def test_out_of_range_epochs_are_rejected(spark):
    df = frame(spark, [page([story(id="big", created_utc=1e300), story(id="micros", created_utc=1.4e15),
                             story(id="ok"), story(id="early", created_utc=-1.0)])])
    assert sorted(r.short_id for r in P.parse_story_pages(df).collect()) == ["early", "ok"]
    rejects = P.thing_rejects(P.parse_listing(df)).collect()
    assert [r.reason for r in rejects] == ["bad_value", "bad_value"]
