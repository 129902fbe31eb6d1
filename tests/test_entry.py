import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 100 and df.columns == ["id", "reddit_short_id", "score", "hotness", "subreddit_name"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_every_branch_has_rows(spark):
    """Keys named after two outcomes show both of them on the driver's tables."""
    q = E.queries()

    def values(name, column):
        return {r[0] for r in q[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert values("check_outcomes", "outcome") == {"updated", "checked"}
    assert values("subreddit_upsert", "action") == {"seen", "inserted"}
    assert values("thing_rejects_by_reason", "reason") == {"wrong_kind", "missing_field", "bad_value"}
    assert values("listing_page_rejects", "reason") == {"malformed", "not_listing"}
    assert len(values("paged_listing", "tick")) > 1
    counters = {r.counter: r.n for r in q["run_counters"](spark, "/root/testdata/sf0.01").collect()}
    assert all(n > 0 for name, n in counters.items() if name != "update_bailed")
