"""Vector codes, sharding and source divergence: against brute force, SQL and their laws."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from storytrack.llm import divergence, sharding, vector_codes
from storytrack.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("op11_vector_codes", "embeddings"), ("op13_source_divergence", "documents")])
def test_queries_equal_sql(spark, name, table):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    at = [got.columns.index(c[0]) for c in want.description]
    assert sorted(tuple(r[i] for i in at) for r in got.collect()) == sorted(want.fetchall())


# -- vector codes --------------------------------------------------------------------------
def lloyd(vectors, parts, entries, rounds):
    """Plain rounds over all pairs of part and entry, in Python integers."""
    width = len(vectors[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else book[e]
                        for e in range(len(book))]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [[e for _, e in f] for f in found], [sum(d for d, _ in f) for f in found], books


def rows_of(spark, vectors, kind="array<double>"):
    return spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], f"vec_id long, embedding {kind}, label int")


@pytest.mark.parametrize("seed, n, spread", [(1, 300, 40), (2, 97, 2), (3, 40, 1000), (4, 700, 5)])
def test_codes_equal_plain_rounds(spark, seed, n, spread):
    """Narrow spreads give ties, equal entries and repeated vectors; 40 rows give fewer entries."""
    rng = random.Random(seed)
    ints = [[rng.randint(-spread, spread) for _ in range(32)] for _ in range(n)]
    ints[n // 2] = list(ints[0])
    rows, books = vector_codes.vector_codes(rows_of(spark, [[x / 256 for x in v] for v in ints]), rounds=2)
    codes, errors, plain = lloyd(ints, 16, 64, 2)
    got = sorted(rows.collect())
    assert books.tolist() == plain
    assert [r.codes for r in got] == codes and [r.error for r in got] == errors


def test_nodes_go_whole_to_an_entry_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 3, (600, 8)) for c in (-400, 0, 500)]).astype(np.int64)
    rng.shuffle(points)
    tree = vector_codes.grow(points.reshape(-1, 2, 4).transpose(1, 0, 2), vector_codes.LEAF)
    centres = np.stack([[np.full(4, c) for c in (-400, 0, 500, 500)]] * 2)
    whole, single = vector_codes.assign(tree, centres)
    by_part = sum(len(item) for item, _ in single)  # only leaves that hold points of two groups
    assert by_part < 0.05 * 2 * len(points) and len(whole[0][1]) + len(whole[1][1]) + len(whole[2][1])
    assert 3 not in np.concatenate([e for _, _, e in whole])  # an equal entry with a lower index is there
    sums, counts = vector_codes.gathered(tree, centres)
    assert counts.reshape(2, 4)[:, :3].tolist() == [[600] * 3] * 2
    assert (sums.reshape(2, 4, 4).sum(axis=1) == points.reshape(-1, 2, 4).sum(axis=0)).all()
    vectors = rows_of(spark, (points / 256).tolist()).repartition(3)
    once = sorted(vector_codes.vector_codes(vectors, parts=2, entries=5)[0].collect())
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    assert sorted(vector_codes.vector_codes(vectors, parts=2, entries=5)[0].collect()) == once


def test_vectors_that_cannot_be_coded(spark):
    good = [0.5] * 16
    rows = [(1, good, 7), (2, None, 7), (3, [None, *good[1:]], 7), (4, [float("nan"), *good[1:]], 7),
            (5, [float("-inf"), *good[1:]], 7), (6, [], 7), (7, good * 2, 7), (None, good, None),
            (8, [1e300, *good[1:]], None), (1, good, 7)]
    made = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "vec_id long, embedding array<double>, label int, id int, raw string")
    got = vector_codes.vector_codes(made)[0].collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.label or 0) for r in got) == [
        (False, 1, 7), (False, 1, 7), (False, 8, 0), (True, 0, 0)]
    assert {tuple(r.codes) for r in got if r.vec_id != 8} == {(0,) * 16}
    assert vector_codes.vector_codes(made.limit(0))[0].collect() == []
    assert vector_codes.vector_codes(made.filter("vec_id = 2"))[0].collect() == []


# -- sharding ------------------------------------------------------------------------------
def test_shards_of_documents(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sharding.op12_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in got)
    check_slots(got)
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 8) for r in got)


def check_slots(rows):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def placed(spark, n, weights):
    rows = spark.range(n).select("id", sharding.rendezvous(F.col("id"), weights).alias("s")).collect()
    return {r.id: r.s for r in rows}


def test_few_records_move(spark):
    n, weights = 20_000, [1.0, 2.0, 1.0, 4.0]
    before = placed(spark, n, weights)
    share = Counter(before.values())
    assert all(abs(share[s] / n - w / 8) < 0.02 for s, w in enumerate(weights))
    grown = placed(spark, n, [*weights, 2.0])
    moved = [i for i in before if grown[i] != before[i]]
    assert all(grown[i] == 4 for i in moved) and abs(len(moved) / n - 0.2) < 0.02
    heavier = placed(spark, n, [1.0, 4.0, 1.0, 4.0])
    moved = [i for i in before if heavier[i] != before[i]]
    assert all(heavier[i] == 1 for i in moved) and moved
    gone = placed(spark, n, [1.0, 0.0, 1.0, 4.0])
    assert all(gone[i] == before[i] for i in before if before[i] != 1) and 1 not in gone.values()
    with pytest.raises(ValueError, match="weight"):
        sharding.rendezvous(F.col("id"), [0.0])


def test_rendezvous_by_definition(spark):
    """The least exponential draw wins, each from the hash of key and shard alone."""
    weights = [1.0, 3.0, 0.5]
    rows = spark.range(300).select("id", sharding.rendezvous(F.col("id"), weights).alias("s"), *[
        F.xxhash64(F.lit(sharding.SALT), F.lit(s), F.col("id").cast("string")).alias(f"h{s}") for s in range(3)]).collect()
    for r in rows:
        draw = [-math.log((((r[f"h{s}"] & (2**64 - 1)) >> 11) + 0.5) / 2**53) / w for s, w in enumerate(weights)]
        assert r.s == draw.index(min(draw))


def test_shard_files_and_edges(spark, tmp_path):
    rows = [(None, None, 1, 2, "f"), (None, "", 1, 2, "f"), (3, "x", 1, 2, "f"), (3, "x", 1, 2, "f"), (4, "ß" * 10**6, 1, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int, file string")
    got = sharding.shard_documents(docs, path=str(tmp_path / "s")).collect()
    check_slots(got)
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 1), (0, 1), (3, 2), (3, 2), (4, 2 * 10**6 + 1)]
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 3}) == 1
    back = spark.read.parquet(str(tmp_path / "s" / "records"))
    assert back.columns == [*docs.columns, "shard_"]
    assert sorted(back.drop("shard_").collect(), key=str) == sorted(docs.collect(), key=str)
    assert sharding.shard_documents(docs.limit(0)).collect() == []


def test_a_hot_key_is_split_into_files(spark, tmp_path):
    """A third of all rows share one id: their shard is written by several tasks."""
    docs = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
                                               F.sha2(F.col("id").cast("string"), 512).alias("text"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        got = sharding.shard_documents(docs, path=str(tmp_path / "s")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    check_slots(got)
    hot = next(r.shard for r in got if r.doc_id == 7)
    assert spark.read.parquet(str(tmp_path / "s" / "manifest")).filter(F.col("shard") == hot).count() > 3


# -- source divergence ---------------------------------------------------------------------
def divergence_sql(spark, docs, tmp_path):
    path = str(tmp_path / "documents")
    docs.write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    return sorted(con.execute(ORACLE["op13_source_divergence"]).fetchall())


def test_tiles_buckets_and_spills_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(map(tuple, divergence.divergences(docs).collect()))
    assert sorted(map(tuple, divergence.divergences(docs, tile=6, bucket=40, cells=2000).collect())) == want


def test_divergence_of_odd_rows(spark, tmp_path):
    """Nulls, languages without kept terms, a source without terms, one source alone, ties."""
    many = [(i, "Aa bb É-éé 12 " + ("cc " * (i % 4)) + f"u{i}", "xx", f"s{i % 3}") for i in range(90)]
    rows = [*many, (100, None, "xx", "none"), (101, "aa", None, None), (102, "aa aa", "yy", "s1"),
            (103, "", "yy", "s2"), (104, "zz", "alone", "s"), (105, "aa", "xx", None), *many[:2]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, term int")
    got = sorted(map(tuple, divergence.divergences(docs).collect()))
    assert got == divergence_sql(spark, docs.select("doc_id", "text", "lang", "source"), tmp_path)
    assert any(r[1] == "none" for r in got) and ("yy", "s1", "pair", "s2", 0, 1) in got
    assert divergence.divergences(docs.limit(0)).collect() == []


def test_terms_of_long_texts_and_exact_shares(monkeypatch):
    text = "Ab cd1ef é　日本 " * 200 + "x" * 500
    def counts():
        return Counter(w for words in divergence.terms(text) for w in words)

    whole = counts()
    assert whole["ab".encode()] == 200 and whole["é　日本".encode()] == 200 and whole[b"ef"] == 200
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert counts() == whole
    rng = random.Random(9)
    for _ in range(300):
        total, terms = rng.randrange(1, 9 * 10**15 - 10**8), rng.randrange(1, 10**7)
        count = rng.randrange(total + 1)
        assert divergence.share(np.int64(count), np.int64(total), terms) == 1 + 10**9 * (count + 5) // (total + 5 * terms)
