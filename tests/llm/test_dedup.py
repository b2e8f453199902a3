"""Line, near-duplicate and substring deduplication against brute force, and their edge cases."""

import pathlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm import components, hashing, line_dedup, near_dedup, substring_dedup
from kerbline.llm.common import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, label string, id string, bucket string, part string, of string, rep string"


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages, empty ones and a null."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        kind = pick.random()
        if texts and kind < 0.3:
            copy = pick.choice(texts).split(" ")
            for _ in range(pick.randrange(3)):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts.append(" ".join(copy))
        elif texts and kind < 0.5:
            part = pick.choice(texts).split(" ")[3:25]
            texts.append(" ".join([*pick.choices(words, k=10), *part, *pick.choices(words, k=10)]))
        else:
            texts.append(" ".join(pick.choices(words, k=pick.choice([1, 3, 4, 5, 12, 13, 40, 90]))))
    return [*texts, "", None, "  \n\t ", "Ä word", "ä word"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in enumerate(texts)], DOCS).repartition(5)


def lowered(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def grouped(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_words_of_bytes():
    column = pa.array([" a  bc\nd", None, "", "ÄÖ x", "a"])
    words = hashing.split_words(column)
    assert np.diff(words.first).tolist() == [3, 0, 0, 2, 1]
    assert words.hashes[0] == words.hashes[-1]
    found, place = hashing.windows(words, 2)
    assert place.tolist() == [0, 1, 3] and len(set(found.tolist())) == 3


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = corpus()
    sets = {}
    for i, t in enumerate(texts):
        w = lowered(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(i, j) for i in sets for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = grouped(links, sets)
    rows = near_dedup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)
    assert any(r.kept is False for r in rows)


def test_open_buckets_are_compared_whole(spark, monkeypatch):
    """A chain of texts, each like the next one only, in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    words = [f"v{i}" for i in range(140)]
    texts = [" ".join(words[5 * i : 5 * i + 70]) for i in range(12)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(66)} for i, t in enumerate(texts)}
    want = grouped([(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])], sets)
    rows = near_dedup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_near_duplicates_of_odd_rows(spark):
    data = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words are here now"), (3, "other words are here now"), (None, "a b c d e f"), (9, None)]
    rows = sorted(near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect(), key=str)
    assert len(rows) == 6
    assert {r.component_id for r in rows if r.doc_id in (3, 7)} == {3}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id == 9] == [(0, 9, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_takes_chance_matches_off():
    random_sets = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, (2, 20_000), dtype=np.uint64) * np.uint64(2)
    a, b = (near_dedup.sketch([np.unique(s)]) for s in random_sets)
    value, used = near_dedup.estimate(a, b, np.array([20_000]), np.array([20_000]))
    assert value[0] < 0.01 and used[0] == near_dedup.BUCKETS
    half = np.unique(np.r_[random_sets[0][:10_000], random_sets[1][:10_000]])
    value, _ = near_dedup.estimate(a, near_dedup.sketch([half]), np.array([20_000]), np.array([20_000]))
    assert abs(value[0] - 1 / 3) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 21), (21, 20), (3, 30), (30, 31)], "a long, b long")
    got = {r.id: r.label for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 31: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    assert components.components(links.limit(0)).collect() == []
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in components.components(path).collect()} == {0}


@pytest.mark.parametrize("width", [13, 4])
def test_repeated_windows_are_those_of_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    texts = corpus(5)
    words = {i: WORD.findall(t or "") for i, t in enumerate(texts)}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    rows = substring_dedup.without_repeats(frame(spark, texts), width).collect()
    assert len(rows) == len(texts)
    for row in rows:
        own = words[row.doc_id]
        gone = {j for k in range(len(own) - width + 1) if first[tuple(own[k : k + width])] < row.doc_id for j in range(k, k + width)}
        assert row.text == " ".join(w for j, w in enumerate(own) if j not in gone)
        assert row.n_words == len(own)
        assert [j for s in row.removed for j in range(s.start, s.end)] == sorted(gone)
        assert all(a.end < b.start for a, b in zip(row.removed, row.removed[1:]))


def test_repeated_windows_of_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(20))
    data = [(4, text), (4, text), (2, text), (None, text), (None, None), (1, "")]
    rows = substring_dedup.without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    kept = defaultdict(list)
    for r in rows:
        kept[r.doc_id].append(r.text)
    assert kept == {4: ["", ""], 2: [text], None: kept[None], 1: [""]} and sorted(kept[None]) == ["", text]
    assert substring_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def line_sets(line):
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def test_lines_are_those_of_brute_force(spark):
    pick = random.Random(2)
    vocabulary = ["".join(pick.choices("abcdefgh", k=pick.randint(2, 8))) for _ in range(300)]
    lines = [" ".join(pick.choices(vocabulary, k=pick.choice([1, 2, 6, 20, 30]))) for _ in range(60)]
    for _ in range(60):
        copy = pick.choice(lines).split(" ")
        if len(copy) > 5:
            copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
        lines.append(" ".join(copy))
    texts = ["\n".join(pick.choices([*lines, "", "  ", "---"], k=5)) for _ in range(40)] + ["A b C\n a b c ", "x" * 70 + "\n" + "x" * 70, None, ""]
    places, sets = defaultdict(list), {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            norm = re.sub(r"\s+", " ", line.lower()).strip()
            if norm:
                places[norm].append((i, k))
                sets[norm] = line_sets(norm)
    names = sorted(sets)
    links = [(a, b) for a in names for b in names if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = grouped(links, names)
    groups = defaultdict(list)
    for name in names:
        groups[root[name]] += places[name]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    rows = line_dedup.dedup_lines(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if texts[r.doc_id] is None:
            assert r.text is None and r.n_lines == 0
            continue
        own = texts[r.doc_id].split("\n")
        assert r.text == "\n".join(line for k, line in enumerate(own) if (r.doc_id, k) not in gone)
        assert (r.n_lines, r.n_removed) == (len(own), sum((r.doc_id, k) in gone for k in range(len(own))))


def test_lines_of_odd_rows(spark):
    data = [(5, "same line here\nown"), (5, "same line here\nown"), (2, "Same line here"), (None, "same line here")]
    rows = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "same line here"), (2, "Same line here"), (5, "own"), (5, "own")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_pass_any_other_column_on(spark):
    names = ["_gone", "_doc", "repeated_in", "Repeated_Lines", "n_lines", "n_removed", "a.b"]
    docs = spark.createDataFrame([(1, "same line here\nown", *names), (2, "same line here", *names)], ["doc_id", "text", *names])
    kept = line_dedup.dedup_lines(docs, ("lines", "removed")).collect()
    assert sorted((tuple(r)[1], *tuple(r)[2:9], r.lines, r.removed) for r in kept) == [("", *names, 1, 1), ("same line here\nown", *names, 2, 0)]
    stage = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert [tuple(r) for r in stage.collect()] == [(1, "same line here\nown", *names)] and stage.columns == docs.columns


def removed_lines(spark, lines):
    """Whether each line, in a document of its own, is removed: by the operator, and by comparing all pairs of full sets."""
    sets = [{n[i : i + 5] for i in range(max(1, len(n) - 4))} for n in (" ".join(line.lower().split()) for line in lines)]
    root = grouped([(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])], range(len(sets)))
    rows = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    return [r.n_removed == 1 for r in sorted(rows, key=lambda r: r.doc_id)], [root[i] != i for i in range(len(lines))]


def test_lines_with_a_changed_letter_are_those_of_brute_force(spark):
    pick = random.Random(9)
    lines = []
    for _ in range(80):
        line = " ".join("".join(pick.choices("abcdeghijklmnop", k=pick.randint(2, 9))) for _ in range(pick.randint(6, 15)))
        at = pick.randrange(len(line))
        lines += [line, line[:at] + "z" + line[at + 1 :]]
    lines += ["abc", "abd", "x"]
    got, want = removed_lines(spark, lines)
    assert got == want and sum(want) > 60


def test_lines_of_any_script_and_white_space_are_those_of_brute_force(spark):
    pick = random.Random(4)

    def text(n):
        return "".join(chr(pick.randrange(0x4E00, 0x9000)) for _ in range(n))

    lines = []
    for n in (12, 31, 50, 63, 65, 90):
        own = text(n)
        lines += [own, own[:-1] + "x", own[: n // 2] + "x" + own[n // 2 + 1 :], "1. " + own, "1. " + own[:-1] + "y"]
    long, rest = text(63), text(70)
    lines += [f"{long} {rest}", f"{long}ab {rest}"]
    lines += ["off to a tab and back\toff", "off to  a tab\u00a0and back off ", "\u3000off to a tab and back off"]
    lines += ["fluffy ends of a line in f", "luffy ends of a line in", "f", "ff", "fff"]
    got, want = removed_lines(spark, lines)
    assert got == want and sum(want) > 20


def test_a_shingle_meets_few_minima_and_lines_are_dealt_once(spark):
    """The 64 min-hashes come from 16 minima a shingle, each in the bin of its hash."""
    plan = line_dedup._signed(frame(spark, ["a line of text", None]))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("min(") <= 16
    assert plan.sparkPlan().toString().count("first(") > 0 and plan.executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_lines_at_the_threshold_share_a_band(spark):
    """Pairs just above the threshold, of short and long lines: nearly all share a band, and enough min-hashes."""
    pick = random.Random(7)
    lines = []
    for _ in range(300):
        line = near = "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.choice((8, 20, 40, 90, 300))))
        own = {line[i : i + 5] for i in range(len(line) - 4)}
        for at in pick.sample(range(len(line)), len(line)):
            other = near[:at] + "-" + near[at + 1 :]
            sets = {other[i : i + 5] for i in range(len(line) - 4)}
            if 100 * len(own & sets) >= 75 * len(own | sets):
                near = other
        lines += [line, near if near != line else line + "-"]
    ids = [r.id for r in frame(spark, lines).orderBy("doc_id").select(F.xxhash64("text").alias("id")).collect()]
    signed = {r.id: r for r in line_dedup._signed(frame(spark, lines)).collect()}
    missed = 0
    for a, b in zip(ids[::2], ids[1::2]):
        one, two = signed[a], signed[b]
        shared = any(one[f"k{i}"] is not None and one[f"k{i}"] == two[f"k{i}"] for i in range(16))
        apart = [((one[f"p{i}"] or 0) ^ (two[f"p{i}"] or 0)) % 2**64 for i in range(4)]
        missed += not shared or sum(x >> 4 * k & 15 > 0 for x in apart for k in range(16)) > 36
    assert missed <= 4


def test_unlike_lines_of_one_family_leave_no_pairs(spark, monkeypatch):
    """A family of lines below the threshold shares buckets; its pairs, which grow with its square, are tested but not written."""
    pick = random.Random(5)
    start = "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=70))
    lines = [start + "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(150)]
    lines += [line + "x" for line in lines[:20]]
    rows, write = [], line_dedup.written

    def counted(frame, name):
        out = write(frame, name)
        if name in ("close-pairs", "like-lines"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    got, want = removed_lines(spark, lines)
    assert got == want and sum(want) == 20
    assert max(rows) <= 16 * len(lines), rows


def test_stages_leave_no_large_intermediates(spark):
    """What a stage has written on its way is gone when its result is there."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    docs = frame(spark, [*corpus(), "a line of text here\na line of text hers"])
    assert len(line_dedup.dedup_lines(docs).collect()) == len(near_dedup.near_duplicates(docs).collect()) == 66
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert not left & {"line-signatures", "line-places", "line-texts", "grouped-lines", "open-buckets", "links", "sketches", "representatives", "shingle-sets", "hopeful-pairs"}, left
