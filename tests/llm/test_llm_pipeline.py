"""The pipeline's stages against brute force, each over what the one before kept."""

import re

import corpus_pipeline
import pytest

from storytrack.llm import decontaminate, langid, near_dedup, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(spark, steps):
    every = spark.read.parquet(f"{SF}/documents.parquet").schema
    for _, made in steps[:-1]:
        assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in every]


def test_language_keeps_clean_documents(steps):
    before, after = map(texts, steps[0])
    assert all(after[i] == before[i] for i in after)
    assert set(after) == {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}


def test_language_sends_few_texts_at_a_time(spark, monkeypatch):
    """Both jobs of the stage run inside it, in small batches; the session's setting is as before."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)

    def noted(f):
        return lambda *args: seen.append(int(spark.conf.get(key))) or f(*args)
    monkeypatch.setattr(langid, "fit_in_task", noted(langid.fit_in_task))
    monkeypatch.setattr(corpus_pipeline, "cut", noted(corpus_pipeline.cut))
    docs = spark.createDataFrame([(i, f"the words of text {i}", "en", "src0", 9) for i in range(20)],
                                 spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert len(texts(corpus_pipeline.language(spark, docs, SF))) == 20
    assert seen == [500, 500] and spark.conf.get(key) == before


def test_language_drops_texts_without_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, "12 34 !!", "en", "src0", 8), (900_002, None, "en", "src0", None)],
                                docs.schema)
    kept = texts(corpus_pipeline.language(spark, docs.union(odd), SF))
    assert not {900_001, 900_002} & set(kept) and len(kept) == docs.count()


def test_lines(steps):
    before = steps[1][0].collect()
    pages = {}
    for r in before:
        pages.setdefault(r.source, []).append({x.strip(" \t\r") for x in r.text.split("\n")} - {""})
    after = {r.doc_id: r for r in steps[1][1].collect()}
    assert len(after) == len(before)
    for r in before:
        own = pages[r.source]

        def bad(line, own=own):
            n = sum(line.strip(" \t\r") in p for p in own)
            return n >= 3 and n > 0.1 * len(own)
        expected = "\n".join(x for x in r.text.split("\n") if not bad(x))
        assert after[r.doc_id].text == expected and after[r.doc_id].n_chars == len(expected)


def test_lines_of_copies_are_not_boilerplate(spark):
    """A third of a source are copies of one document; its footer is on most other documents."""
    whole = "first line of it\nsecond line of it\nlast line of it"
    rows = [(i, whole if i % 3 == 0 else f"text {i}\nown line {i}" + "\nfooter" * (i % 4 > 0), "en", "src0", 0)
            for i in range(60)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    lines = corpus_pipeline.lines(spark, docs, SF).cache()
    after = texts(lines)
    assert after == {r[0]: whole if r[0] % 3 == 0 else r[1].replace("\nfooter", "") for r in rows}
    kept = texts(corpus_pipeline.near_duplicates(spark, lines, SF))
    assert [i for i, t in kept.items() if t == whole] == [0] and all(kept.values())


def test_near_duplicates(steps):
    before, after = map(texts, steps[2])
    sets = {}
    for i, t in before.items():
        w = t.encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert set(after) == {i for i in sets if top(i) == i} and all(after[i] == before[i] for i in after)


def test_near_duplicates_need_no_other_workers(spark, monkeypatch):
    """Rows made by createDataFrame start Python workers of a second kind, which stay in memory."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "src0", 0), (2, words + " more", "en", "src0", 0), (3, "another text", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)

    def refused(*_args, **_kwargs):
        raise AssertionError("createDataFrame")
    monkeypatch.setattr(type(docs.sparkSession), "createDataFrame", refused)
    assert set(texts(near_dedup.keep_one_of_each(docs))) == {1, 3}


def test_decontaminated(spark, steps):
    """Every aligned span of 20 item words with 16 that agree, sought at every place."""
    before, after = map(texts, steps[3])
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for i, t in before.items():
        w = words(t)
        place = {}
        for k, x in enumerate(w):
            place.setdefault(x, []).append(k)
        for item in items:
            n = min(20, len(item))
            shifts = {}
            for k, x in enumerate(item):
                for p in place.get(x, ()):
                    shifts.setdefault(p - k, set()).add(k)
            if any(len([k for k in at if f <= k < f + n]) >= 0.8 * n for at in shifts.values() if len(at) >= 0.8 * n
                   for f in range(len(item) - n + 1)):
                bad.add(i)
    assert set(after) == set(before) - bad


def test_tokens(steps):
    before = texts(steps[4][0])
    lex = pieces.lexicon(pieces.default_model())
    got = {r.doc_id: r for r in steps[4][1].collect()}
    assert set(got) == set(before)
    assert all(r.round_trip and r.n_tokens == len(lex.encode(before[i])) for i, r in got.items())


def test_tokens_are_the_same_with_a_small_cache(spark):
    """The bound of the words kept is the caller's; the words of both generations stay within it."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(300)), "en", "src0", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    few = pieces.encoded_and_decoded(docs, spark, cache_bytes=1).collect()
    assert sorted(few) == sorted(pieces.encoded_and_decoded(docs, spark).collect())
    assert all(r.round_trip and r.n_tokens > 300 for r in few)
    lex = pieces.Lexicon(open(pieces.default_model(), "rb").read())
    lex.cache_bytes = corpus_pipeline.CACHE_BYTES
    for i in range(0, 120_000, 4_000):
        lex.encode(" ".join(f"v{k}" for k in range(i, i + 4_000)))
    assert sum(len(w) + len(ids) + 180 for c in (lex.known, lex.older) for w, ids in c.items()) < 2 * (9 << 20)


def test_stages_are_the_named_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    assert decontaminate.MIN_MATCH == 0.8 and corpus_pipeline.NEAR_DUPLICATE == 80


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[4][1].collect()))
