"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from storytrack.llm import (decontaminate, exact_dedup, langid, license_scan, line_dedup, near_dedup, pieces, quality,
                            token_store, toxicity)
from storytrack.session import checkpoint_dir

LONG = " ".join(f"word{i}" for i in range(40_000))
CLASH = ("score double, predicted int, lang_pred string, ids string, kept string, _host string, _drop string, "
         "_id string, _s int, _doc long, _lid string, _q int, lines_dropped string, label int, v int, digest string")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
REST = (0.5, 1, "x", "x", "x", "h", "d", "i", 1, 7, "l", 1, "x", 3, 4, "g")
ROWS = [(1, "one two three four five six", "en", "a", 27), (2, "one  two three\tfour five six", "en", "a", 27),
        (2, "one  two three\tfour five six", "en", "a", 27), (3, None, "en", "a", None), (4, "", None, None, 0),
        (5, " \n ", "en", "b", 3), (None, "one two three four five six", "en", None, 1), (6, LONG, "en", "b", None),
        (7, LONG + " end", "en", None, None), (8, "12 34 !!", "de", "b", 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + REST for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_exact_dedup(docs, nothing):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    same = [r for r in got if r.keep_id == 1]
    assert sorted((r.doc_id or -1, r.kept, r.group_size) for r in same) == [
        (-1, False, 4), (1, True, 4), (2, False, 4), (2, False, 4)]
    assert {r.doc_id: (r.keep_id, r.kept) for r in got if r.doc_id in (3, 4, 5)} == {
        3: (3, True), 4: (3, False), 5: (5, True)}
    assert {r.text_sha256 for r in got if r.doc_id == 5} == {hashlib.sha256(b" ").hexdigest()}
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_exact_dedup_ids_all_null(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [(r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()] == [(None, 2, True)] * 2


def test_near_dedup(docs, nothing):
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True),
        None: (2, None, True), 6: (39_996, 6, True), 7: (39_997, 6, False), 8: (1, 8, True)}
    assert near_dedup.near_dedup(nothing).collect() == []
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 8]


def test_near_dedup_one_id_with_two_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l")],
                                 "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_dedup(rows).collect()} == {1}


def test_near_dedup_links_of_repeated_rows(spark):
    """A doubled row, and an id with two different texts, against near copies that are there once."""
    text = {k: [f"{k}{i}" for i in range(104)] for k in "abc"}

    def near(k, n=2):
        return " ".join(text[k][:-n] + [f"new{k}{i}" for i in range(n)])
    a, b, c = (" ".join(text[k]) for k in "abc")
    rows = [(1, a), (1, a), (2, near("a")), (2, near("a")), (3, near("a", 3)), (9, b), (9, c), (9, c), (4, near("b")),
            (5, near("c")), (6, "some other words that are like none of them")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 9: 4, 4: 4, 5: 4, 6: 6}
    named = spark.createDataFrame([(f"id{i}", t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(named).collect()} == {
        "id1": "id1", "id2": "id1", "id3": "id1", "id9": "id4", "id4": "id4", "id5": "id4", "id6": "id6"}


def test_line_dedup(spark, docs, nothing):
    out = line_dedup.drop_boilerplate(docs, "source", "text", 0.4, 2)
    assert sorted(out.columns) == sorted(docs.columns)
    got = {r.doc_id: (r.text, r.lines_dropped) for r in out.collect()}
    assert got[2] == ("", 1) and got[1] == (ROWS[0][1], 0) and got[3] == (None, 0) and got[4] == ("", 0)
    assert got[5] == (" \n ", 0) and got[6][0] == LONG
    assert out.count() == len(ROWS) and line_dedup.drop_boilerplate(nothing, "source", "text").collect() == []
    pages = spark.createDataFrame([(None, "x"), (None, "x"), (None, "x\ny"), ("h", "x")], "host string, text string")
    got = line_dedup.drop_boilerplate(pages, "host", "text", 0.5, 2).collect()
    assert sorted((r.host or "", r.text) for r in got) == [("", ""), ("", ""), ("", "y"), ("h", "x")]


def test_license_scan(docs, nothing):
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(ROWS) and all(r.licenses == [] and r.sentence_ids == [] for r in got)
    assert license_scan.license_scan(nothing).collect() == []


def test_decontaminate(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "word100 " + " ".join(f"word{i}" for i in range(101, 130))), (2, None), (3, ""),
                                   (4, "three words only"), (None, "one two three four five six"),
                                   (1, "word100 word5")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.mark_contaminated(docs, bench).collect()}
    assert got[6] == got[7] == [1] and got[3] == got[4] == got[5] == [] and len(got) == 9
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert pairs == {(6, 1), (7, 1), (1, None), (2, None), (None, None)}
    assert decontaminate.mark_contaminated(nothing, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.mark_contaminated(docs, bench.limit(0)).collect())


def test_language(docs, nothing):
    model = langid.fit(docs)
    out = langid.identify(docs, model)
    assert sorted(out.columns) == sorted(docs.columns)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[3] == got[4] == got[5] == got[8] == ("und", 0.0)
    assert got[6][0] in ("en", "de") and 0 <= got[6][1] <= 1
    assert langid.identify(nothing, model).collect() == []
    untaught = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(docs, untaught).collect()} == {"und"}
    assert langid.reject_undetermined(docs, model).columns == docs.columns


@pytest.mark.parametrize("op, score", [(quality, quality.score_quality), (toxicity, toxicity.score_toxicity)])
def test_classifiers(spark, docs, nothing, op, score):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, None), (None, 1), (99, 1), (6, 1)],
                                   "doc_id long, label int")
    for model in (op.fit(docs, labels), op.fit(docs, labels.limit(0))):
        out = score(docs, model)
        assert sorted(out.columns) == sorted(docs.columns)
        got = out.collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted == int(r.score >= op.THRESHOLD) for r in got)
        assert score(nothing, model).collect() == []


def test_pieces(spark, docs, nothing):
    out = pieces.encode(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.withColumn("back", pieces.decode(F.col("ids"), spark)).collect()
    assert len(got) == len(ROWS) and all(r.back == (r.text or "") for r in got)
    assert all(len(r.ids) == 0 for r in got if not r.text)
    assert pieces.encode(nothing).collect() == []


def test_token_store(spark, docs, nothing, tmp_path):
    path = f"{checkpoint_dir(spark).removeprefix('file://')}/store-{tmp_path.name}"
    token_store.write_store(docs, path)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert all(len(r.ids) == 4 * r.n_tokens and r.ids[-4:] == b"\x02\0\0\0" for r in got)
    for r in got:
        if r.doc_id is not None:
            assert token_store.read_document(path, r.doc_id).astype("<u4").tobytes() == r.ids
    assert token_store.read_document(path, 1_000) is None
    token_store.write_store(nothing, path + "-empty")
    assert token_store.read_store(spark, path + "-empty").collect() == []


def test_fold_is_crc32_of_the_id(docs):
    from storytrack.llm.common import fold
    for r in docs.select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect():
        assert r.f == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5
