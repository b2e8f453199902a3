"""Importance resampling, spelling variants and the set join against brute force, and their edge cases."""

import hashlib
import math
import pathlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kerbline.llm import resampling, signature_trees, spelling
from kerbline.llm.common import shared_folder

DOCS = "doc_id long, text string, word string, n long, weight string, score string, id string, cluster string, label string, `a.b` string"
OTHER = ["x", 1, *["x"] * 6]
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *OTHER) for i, t in rows], DOCS).repartition(3)


def by_id(frame):
    return {row["doc_id"]: row for row in frame.collect()}


# --- resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def drawn(rows, target):
    """(n_features, weight, score, rank) per row, by the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return {r[0]: (*r[1:4], rank.get(r[0])) for r in out}


def texts_of_words(n, seed=5):
    pick = random.Random(seed)
    words = ["Uno", "dos", "Ärger", "x1", "été", "b" * 90, "日本語", *(f"w{i}" for i in range(60))]
    return [pick.choice([" ", "-", ". ", "\n"]).join(pick.choices(words, k=pick.choice([0, 1, 2, 3, 19, 20, 25, 70]))) for _ in range(n)]


def test_resampling_is_the_definition(spark):
    rows = list(enumerate([*texts_of_words(300), None, "", "  ...  ", "q" * 5000, "one " * 3000]))
    target = [*texts_of_words(20, 9), None, ""]
    out = by_id(resampling.resampled(frame(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")))
    assert {d: (r["n_features"], r["weight"], r["score"], r["rank"]) for d, r in out.items()} == drawn(rows, target)
    assert sum(r["rank"] is not None for r in out.values()) == 5


def test_ranks_where_all_slots_are_few(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLOTS", 3)
    rows = spark.createDataFrame([(i, 20 + i % 2, 1, 0, (i * 7) % 11) for i in range(400)] + [(900, 19, 1, 0, 99)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in resampling.ranked(rows).collect()}
    best = sorted(range(400), key=lambda i: (-((i * 7) % 11), i))[:20]
    assert {d: r for d, r in got.items() if r} == {d: k + 1 for k, d in enumerate(best)} and len(got) == 401


def test_resampling_edges(spark):
    empty = frame(spark, [])
    words = "one two three " * 10
    assert resampling.resampled(empty, empty).count() == 0
    rows = [(None, words), (3, words), (3, words), (4, None), *((100 + i, words) for i in range(60))]
    out = resampling.resampled(frame(spark, rows), empty).collect()
    assert len(out) == 64 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]
    assert [(r["score"], r["rank"], r["n_features"]) for r in out if r["doc_id"] is None] == [(None, None, 87)]
    assert [(r["n_features"], r["weight"], r["rank"]) for r in out if r["doc_id"] == 4] == [(0, 0, None)]


@pytest.mark.parametrize("length", [1, 63, 64, 65, 1000, 70001])
def test_payloads_compose(length):
    a, b = b"ab" * 3, b"z" * length
    got = resampling.composed(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([length]))
    assert int(got[0]) == zlib.crc32(a + b" " + b)


def test_runs_stay_inside_their_texts():
    first, crcs = resampling.runs(pa.array(["a b", None, "", "c"]))
    assert first.tolist() == [0, 2, 2, 2, 3] and resampling._inside(first, 1).tolist() == [0] and len(crcs[0]) == 3


# --- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelt(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    counts = {w: n for w, n in counts.items() if n >= 3}
    forms, out = {}, {}
    for w in counts:
        beside = sorted((-counts[v], v) for v in counts if near(v, w))
        forms[w] = beside[0][1] if beside and -beside[0][0] >= 2 * counts[w] else None
        out[w] = (counts[w], len(beside))
    def root(w):
        return root(forms[w]) if forms[w] else w
    return {w: (forms[w], root(w), n, k, counts.get(forms[w])) for w, (n, k) in out.items()}


def spellings(spark, rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame(spark, rows)).collect()}


def test_variants_are_the_definition(spark):
    pick = random.Random(8)
    stems = ["".join(pick.choices("abeÄéñst", k=pick.randrange(4, 9))) for _ in range(60)]
    def letter(w):
        i, c = pick.randrange(len(w)), pick.choice("abeé")
        return pick.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
    rows = []
    for doc in range(400):
        words = [pick.choice(stems) if pick.random() < 0.7 else letter(pick.choice(stems)) for _ in range(pick.randrange(60))]
        rows.append((doc, pick.choice([" ", "_", "1", "\n"]).join(words)))
    rows += [(900, None), (901, ""), (902, "a" * 5000), (903, "Straße " * 97), (None, "Strasse " * 5)]
    assert spellings(spark, rows) == spelt(rows)


def test_variants_with_ties_chains_and_one_letter_words(spark):
    words = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "bcdef": 4, "bcdeg": 8, "bcdeh": 8, "fedcb": 50, "zzzzz": 3}
    rows = [(None, " ".join(w for w, n in words.items() for _ in range(n)))]
    assert spellings(spark, rows) == spelt(rows)
    assert spellings(spark, rows)["aaaaa"][:2] == ("aaaaaa", "aaaaaaa") and spellings(spark, rows)["bcdef"][0] == "bcdeg"
    assert spellings(spark, []) == {} and spellings(spark, [(1, None), (2, "ab")]) == {}


# --- set join


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def groups(rows):
    sets = [(d, sets_of(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def of(x):
        return x if root[x] == x else of(root[x])

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                low, high = sorted((of(d), of(e)))
                root[high] = low
    return {d: of(d) for d in root}


def family(seed, n, base=None, share=0.05):
    """Texts that differ from one another in some words, around the limit of similarity."""
    pick = random.Random(seed)
    base = base or [f"v{pick.randrange(900)}" for _ in range(pick.choice([4, 12, 30, 90, 260]))]
    out = []
    for _ in range(n):
        own = list(pick.choice(out) if out and pick.random() < 0.5 else base)
        for _ in range(pick.randrange(int(len(own) * share) + 2)):
            own[pick.randrange(len(own))] = f"u{pick.randrange(5000)}"
        out.append(own)
    return [" ".join(o) for o in out]


def joined(spark, rows):
    return {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in signature_trees.jaccard_components(frame(spark, rows)).collect()}


@pytest.mark.parametrize("block", [500_000, 900])
def test_join_is_the_definition(spark, monkeypatch, block):
    """Once with clusters whole, once with all larger ones in blocks."""
    monkeypatch.setattr(signature_trees, "BLOCK", block)
    texts = [t for seed in range(25) for t in family(seed, 12)] + ["", None, " \n", "one", "ONE", "one two", "a b c d"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    want = groups(rows)
    assert joined(spark, rows) == {(d, len(sets_of(t))): want[d] for d, t in rows}
    assert 30 < len(set(want.values())) < 250


def test_join_edges(spark):
    assert joined(spark, []) == {}
    text = " ".join(f"k{i}" for i in range(40))
    rows = [(5, text), (5, text + " more"), (3, text), (7, text + " more"), (8, None), (None, text), (9, "lone"), (9, text)]
    out = signature_trees.jaccard_components(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in out) == sorted(
        [(5, 38, 3), (5, 39, 3), (3, 38, 3), (7, 39, 3), (8, 0, 8), (0, 38, 0), (9, 1, 3), (9, 38, 3)]
    )
    long = [" ".join(f"k{i}" for i in range(30_000)), " ".join(f"k{i}" for i in range(50, 30_020))]
    assert joined(spark, [(1, long[0]), (2, long[1]), (3, long[0])]) == {(1, 29998): 1, (2, 29968): 1, (3, 29998): 1}


@pytest.mark.parametrize("size", [1, 5, 9, 10, 11, 19, 40, 333])
def test_alike_sets_share_a_part(size):
    """Whatever is left out or replaced up to the limit, a key stays common."""
    pick = random.Random(size)
    for _ in range(60):
        a = np.unique(np.array([pick.getrandbits(64) for _ in range(size)], np.uint64))
        gone = pick.randrange(len(a) // 10 + 1)
        b = np.unique(np.r_[a[gone:], np.array([pick.getrandbits(64) for _ in range(pick.randrange(len(a) // 8 + 2))], np.uint64)])
        if not np.array_equal(a, b) and signature_trees.alike(a, b, 90):
            assert set(signature_trees.part_keys(a, 90).tolist()) & set(signature_trees.part_keys(b, 90).tolist())


def test_trees_lose_no_pair():
    pick = random.Random(4)
    pool = [np.array([pick.getrandbits(64) for _ in range(60)], np.uint64) for _ in range(6)]
    sets = []
    for _ in range(90):
        own = pick.choice(pool).copy()
        for _ in range(pick.randrange(5)):
            own[pick.randrange(60)] = pick.getrandbits(64)
        sets.append(np.unique(own[: pick.randrange(50, 61)]))
    pairs = {(i, j) for i in range(90) for j in range(i) if signature_trees.alike(sets[i], sets[j], 90)}

    def closed(links):
        root = list(range(90))
        for a, b in links:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    own = signature_trees.linked(sets, np.arange(90), None, 90)
    assert closed(own) == closed(pairs) and len(own) <= 90
    cross = signature_trees.linked(sets[:50], np.arange(50), (sets[50:], np.arange(50, 90)), 90)
    inside = [p for p in pairs if (p[0] < 50) == (p[1] < 50)]
    assert closed(cross + inside) == closed(pairs)


def test_a_worker_of_resampling_stays_small():
    """A batch of 16 MB of ever new words: the worker's memory may not grow by much more than the batch."""
    code = """
import resource
import numpy as np, pyarrow as pa
from kerbline.llm import resampling
pick = np.random.default_rng(1)
texts = [" ".join(f"{x:x}" for x in pick.integers(1 << 28, 1 << 32, 100)) for _ in range(18_000)]
batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
list(resampling._counted([batch]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    root = pathlib.Path(resampling.__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(done.stdout) < 250


def test_join_leaves_no_signatures(spark):
    """Keys of all documents go once they have met."""
    text = " ".join(f"k{i}" for i in range(40))
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    assert set(joined(spark, [(1, text), (2, text + " more"), (3, "other words here")]).values()) == {1, 3}
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert not left & {"set-signatures", "classes", "sets"}
