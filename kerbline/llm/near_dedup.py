"""Near duplicates by HyperMinHash over 5-word shingles.

A document's set holds the distinct shingles of its lower-cased words. Its sketch splits the hashes into ``BUCKETS`` by their
top bits and keeps, of the smallest hash in each bucket, the count of leading zeros and ``MANTISSA`` bits after the leading
one, in 16 bits. Empty registers borrow a filled one in a fixed random order for the bands only. Bands of ``ROWS`` registers
name candidate buckets, ``link_buckets`` turns those into pairs, the sketches' collision-corrected estimate drops hopeless
pairs (five standard deviations below the threshold), and full sets confirm the rest.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import hashing
from kerbline.llm.common import discard, map_batches, written
from kerbline.llm.components import bucket_components

SHINGLE = 5
BUCKET_BITS, MANTISSA = 9, 10
#: 42 bands of 6: a pair at the threshold is missed with probability 0.0003, one of similarity 0.3 is a candidate with 0.03.
BUCKETS, ROWS, BANDS = 1 << BUCKET_BITS, 6, 42
THRESHOLD = 75  # per cent
EMPTY = 0xFFFF
#: Members of a bucket that are compared with as many others at once: about 1 MB of sketches.
BLOCK = 500
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
#: For each register that a band takes, the order in which others stand in for it; it comes first itself.
_ORDER = np.argsort(np.argsort(np.random.Generator(np.random.PCG64(7)).random((BANDS * ROWS, BUCKETS)), axis=1), axis=1).astype(np.int16)
_ORDER[np.arange(BANDS * ROWS), np.arange(BANDS * ROWS)] = -1

Batches = Iterator[pa.RecordBatch]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where it has fewer words; empty without words."""
    words = hashing.split_words(column, lower=True)
    shingles, place = hashing.windows(words, SHINGLE)
    bounds = np.searchsorted(place, words.first)
    short = hashing.whole(words)
    sets = []
    for i in range(len(words.first) - 1):
        if bounds[i] < bounds[i + 1]:
            s = np.sort(shingles[bounds[i] : bounds[i + 1]])
            sets.append(s if len(s) < 2 else s[np.r_[True, s[1:] != s[:-1]]])
        else:
            sets.append(short[i : i + 1] if words.first[i] < words.first[i + 1] else shingles[:0])
    return sets


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BUCKETS`` registers for each set."""
    rest, filled = np.zeros((len(sets), BUCKETS), np.uint64), np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _EDGES)
        filled[i] = np.diff(np.r_[at, len(s)]) > 0
        rest[i, filled[i]] = s[at[filled[i]]] << np.uint64(BUCKET_BITS)
    # The top 53 bits behind the bucket's convert to a float exactly, whose exponent is the place of the leading one.
    top = rest >> np.uint64(11)
    place = np.frexp(top.astype(np.float64))[1]  # 0 for none
    shift = place - 1 - MANTISSA
    bits = np.where(shift >= 0, top >> np.maximum(shift, 0).astype(np.uint64), top << np.maximum(-shift, 0).astype(np.uint64))
    registers = (53 - place) << MANTISSA | (bits & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    return np.where(filled, registers, EMPTY).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of registers, and how many buckets it rests on.

    Equal registers of different hashes are expected ``0.1699 * buckets / 2**mantissa * 4x / (1 + x)**2`` times for sets of
    size ratio x (the published approximation for large sets); that many matches are taken off.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487159739 * BUCKETS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(same - chance, 0) / np.maximum(used, 1), used


def bands(registers: np.ndarray) -> np.ndarray:
    """Band keys of non-empty sketches."""
    full = np.empty((len(registers), BANDS * ROWS), np.uint64)
    for row, own in zip(full, registers):
        filled = np.flatnonzero(own != EMPTY)
        row[:] = own[filled[_ORDER[:, filled].argmin(axis=1)]]
    parts = full.reshape(len(full), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(ROWS):
        key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _signatures(batches: Batches) -> Batches:
    for batch in batches:
        for start, stop in hashing.slices(batch.column("text")):
            sets = shingle_sets(batch.column("text").slice(start, stop - start))
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = [np.array([hashing.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (0x1234567, 0xFEDCBA987)]
            registers = sketch(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, stop - start), pa.array(sizes), _signed(digests[0]), _signed(digests[1]), pa.array([r.tobytes() for r in registers], pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "registers"],
            )


def _bands(batches: Batches) -> Batches:
    for batch in batches:
        if len(batch):
            keys = bands(_matrix(batch.column("registers")))
            ids = np.repeat(np.asarray(batch.column("doc_id")), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["bucket", "id"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def hopeful(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of registers may be at the threshold: five standard deviations of a sample without replacement are allowed."""
    value, used = estimate(a, b, n, m)
    limit = THRESHOLD / 100
    union = (n + m) / (1 + limit)
    unseen = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    least = limit - 5 * np.sqrt(limit * (1 - limit) / np.maximum(used, 1) * unseen) - 2 / np.maximum(used, 1)
    return (value >= least) & (np.minimum(n, m) * 100 >= THRESHOLD * np.maximum(n, m))


def _hopeful(batches: Batches) -> Batches:
    for batch in batches:
        if len(batch):
            keep = hopeful(_matrix(batch.column("ra")), _matrix(batch.column("rb")), np.asarray(batch.column("na")), np.asarray(batch.column("nb")))
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _block_pairs(group: pa.Table) -> pa.Table:
    """Hopeful pairs of two blocks of a bucket, or of one with itself, in different components; each in its first common band."""
    group = group.combine_chunks()
    ids, labels, sizes, blocks = (np.asarray(group.column(k)) for k in ("id", "label", "n_shingles", "block"))
    registers, bucket = _matrix(group.column("registers")), group.column("bucket")[0].as_py()
    keys = bands(registers)
    own = keys == bucket
    out = []
    one, two = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    for i in one:
        js = two[(ids[two] > ids[i]) & (labels[two] != labels[i])] if blocks.min() == blocks.max() else two[(ids[two] != ids[i]) & (labels[two] != labels[i])]
        if len(js):
            js = js[hopeful(registers[i][None, :], registers[js], np.full(len(js), sizes[i]), sizes[js])]
            common = keys[js] == keys[i]
            js = js[(common & own[i]).any(axis=1) & (common.argmax(axis=1) == own[i].argmax())]
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _sets(batches: Batches) -> Batches:
    for batch in batches:
        for start, stop in hashing.slices(batch.column("text")):
            sets = shingle_sets(batch.column("text").slice(start, stop - start))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "items"])


def _confirmed(batches: Batches) -> Batches:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("xa"), batch.column("xb")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
            keep.append(shared > 0 and 100 * shared >= THRESHOLD * (len(a) + len(b) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs (doc_id, text, ...)``.

    Documents are linked if 100 * intersection >= 75 * union of their sets; ``component_id`` is the smallest doc_id
    reachable. Documents without words (null or blank text) have ``n_shingles`` 0 and stand alone. Rows that repeat a doc_id
    are one node. A row without doc_id takes no part: its ``component_id`` is null and it is kept. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(map_batches(texts, _signatures, "doc_id long, n_shingles long, d1 long, d2 long, registers binary"), "sketches")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets, copies included, are one class that its smallest doc_id stands for.
    classes = linked.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classed = written(signed.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes")
    reps = signed.join(classes.withColumnRenamed("rep", "doc_id"), ["n_shingles", "d1", "d2", "doc_id"], "left_semi").select("doc_id", "n_shingles", "registers").dropDuplicates(["doc_id", "n_shingles", "registers"])
    reps = written(reps, "representatives")
    discard(signed)
    fetched: list[DataFrame] = []
    members = map_batches(reps, _bands, "bucket long, id long")

    def confirm(pairs: DataFrame) -> DataFrame:
        one = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
        two = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
        able = written(map_batches(pairs.join(one, "a").join(two, "b"), _hopeful, "a long, b long").distinct(), "hopeful-pairs")
        needed = able.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = written(map_batches(texts.join(needed, "doc_id", "left_semi"), _sets, "id long, items binary"), "shingle-sets")
        fetched.extend([able, sets])
        a, b = sets.select(F.col("id").alias("a"), F.col("items").alias("xa")), sets.select(F.col("id").alias("b"), F.col("items").alias("xb"))
        return map_batches(able.join(a, "a").join(b, "b"), _confirmed, "a long, b long").distinct()

    def rest_pairs(live: DataFrame) -> DataFrame:
        sizes = live.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = live.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        rows = rows.join(reps.withColumnRenamed("doc_id", "id"), "id").select("bucket", "low", "high", "block", "id", "label", "n_shingles", "registers")
        return rows.groupBy("bucket", "low", "high").applyInArrow(_block_pairs, "a long, b long").distinct()

    several = classed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    known = classed.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = bucket_components(members, confirm, lambda live: confirm(rest_pairs(live)), known)
    discard(reps, *fetched)
    out = classed.join(labels, classed["rep"] == labels["id"], "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
