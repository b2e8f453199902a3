"""Packing, nearest neighbours, and the pipeline over them."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kerbline.llm import ann, packing
from kerbline.llm.queries import ORACLES, QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, ids):
    """Every id of every document in one piece, every window gapless; returns tokens by window and source."""
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        place = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (place, len(ids[doc])) and r.length > 0
            place += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][r.start : place], "<u4").tobytes())
        assert place == len(ids[doc])
    fills, shares = [], []
    for k in range(len(windows)):
        place = 0
        for r in sorted(windows[k], key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        fills.append(place)
        shares.append(Counter())
        for r in windows[k]:
            shares[-1][r.source] += r.length
    assert all(f == packing.WINDOW for f in fills[:-1]) and 0 < fills[-1] <= packing.WINDOW
    return shares


def test_ids_are_the_tokenizer_s(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    texts += ["", " a  b\n\nc ", "<|endoftext|>x<|endoftext|>", "naïve 日本 👩‍🚀 ͏ ", "a" * 3000, "\r\n\t", "<|endoftext|", "it's 1234567 don't"]
    for text in texts:
        assert packing.token_ids(text, RANKS).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0, "": 1.0}])
def test_windows_hold_the_mixture(spark, tokenizer, monkeypatch, targets):
    monkeypatch.setattr(packing, "BLOCK", 9_000)
    pick = np.random.Generator(np.random.PCG64(8))
    data = [(i, " ".join(pick.choice(["lorem", "ipsum", "dolor", "sit"], pick.integers(1, 400))), ["a", "b", "c", None][int(pick.integers(4))], "q") for i in range(300)]
    data += [(1000, None, "a", "q"), (1001, "", "b", "q"), (1002, "word " * 9_000, "a", "q")]
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in data}
    frame = spark.createDataFrame(data, "doc_id long, text string, source string, queue string").repartition(4)
    shares = check_pieces(packing.pack(frame, RANKS, targets).collect(), ids)
    totals = Counter()
    for d, _, source, _ in data:
        totals[source or ""] += len(ids[d])
    if targets is None:
        want = {s: packing.WINDOW * n / sum(totals.values()) for s, n in totals.items()}
        assert all(abs(share[s] - w) <= 4 * packing.PACKET + 1 for share in shares[:-1] for s, w in want.items())
        running = Counter()
        for k, share in enumerate(shares[:-1]):
            running.update(share)  # what a window lacks, later ones make up
            assert all(abs(running[s] - (k + 1) * w) <= 8 * packing.PACKET for s, w in want.items())
    else:
        early = sum(shares[: len(shares) // 4], Counter())
        assert early["a"] / early["b"] == pytest.approx(3, rel=0.15)


def test_packing_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, "same text", "a"), (1, "same text", "a"), (None, None, None)], "doc_id long, text string, source string")
    rows = packing.pack(frame, RANKS).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * rows[[r.doc_id for r in rows].index(1)].doc_tokens
    assert [(r.start, r.length) for r in rows if r.doc_id is None] == [(0, 1)]
    assert packing.pack(frame.limit(0), RANKS).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame, RANKS, {"a": 0.0}).collect()


def exact(vectors, every, most):
    out = {}
    for q, v in vectors:
        if q % every == 0:
            scores = sorted((-float(np.dot(v, w)), i) for i, w in vectors if i != q)
            out[q] = [(i, -s) for s, i in scores[:most]]
    return out


def test_walk_goes_by_falling_sums():
    pick = np.random.Generator(np.random.PCG64(2))
    first, second, counts = pick.normal(size=7), pick.normal(size=5), pick.integers(0, 3, 35)
    order = sorted((c for c in range(35) if counts[c]), key=lambda c: -(first[c // 5] + second[c % 5]))
    assert ann.walk(first, second, counts, 10**9) == order
    some = ann.walk(first, second, counts, 6)
    assert some == order[: len(some)] and counts[some].sum() >= 6 > counts[some[:-1]].sum()


def test_neighbours_of_odd_rows(spark):
    same = [(i, [1.0, 2.0]) for i in (40, 7, 3, 60)]
    data = [*same, (20, [0.0, 1.0]), (21, [0.0, 0.0]), (22, None), (23, [1.0, None]), (24, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (25, [1.0]), (9, [-1.0, 0.5]), (9, [-1.0, 0.5])]
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in data], "vec_id long, embedding array<double>, cell int, first int")
    rows = ann.neighbours(frame).collect()
    want = exact([*same, (20, [0.0, 1.0]), (9, [-1.0, 0.5])], 20, 20)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == want
    assert [r["rank"] for r in sorted(rows) if r.query_id == 20] == [1, 2, 3, 4, 5]
    assert ann.neighbours(frame.limit(0)).collect() == []


def test_recall_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST", 100)
    monkeypatch.setattr(ann, "BLOCK", 64)
    pick = np.random.Generator(np.random.PCG64(3))
    centres = pick.normal(size=(20, 12))
    vectors = [(i, (centres[i % 20] + 0.3 * pick.normal(size=12)).tolist()) for i in range(1500)] + [(5000 + i, [3.0] * 12) for i in range(500)]
    rows = ann.neighbours(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    want, got = exact(vectors, 20, 20), defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
    assert np.mean([len({i for i, _ in want[q]} & got[q]) / 20 for q in want]) >= 0.9
    assert got[5000] == set(range(5001, 5021)), "ties go to the smaller ids"


def test_the_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert docs.where("n_chars <> length(text)").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == sizes[-1]


def test_stages_on_odd_rows(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six seven"), (None, "one two three four five six"), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "s", "k") for r in rows], "doc_id long, text string, source string, kept_id string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None"]
    twice = docs.unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(9).cast("long")))
    lines = corpus_pipeline.drop_repeated_lines(spark, twice, DATA)
    # The lines of documents 1 and 2 share 23 of 29 shingles: nothing is left of 2, nor of its copy 9.
    assert lines.columns == docs.columns and sorted(str(r.doc_id) for r in lines.collect()) == ["1", "1", "3", "4", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == []


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = QUERIES[name](spark, DATA)
    cursor = duck.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})")
    by_id = lambda row: (row[0], str(row))
    assert sorted(map(tuple, frame.collect()), key=by_id) == sorted(cursor.fetchall(), key=by_id)
