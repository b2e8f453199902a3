"""Importance resampling of documents towards a target's distribution of hashed word runs.

Texts are handled in slices of some megabytes. The distinct words of a slice, each between two delimiters, make an Aho-Corasick
dictionary whose payloads are a word's CRC and length. One scan of the slice emits the payloads of its words in order, and
payloads of neighbours compose: the CRC of "a b" follows from those of "a", " " and "b" and the length of "b" alone. So runs
of one to three words get their buckets without being built. A first scan counts buckets over all texts, a second one sums
the buckets' gains per document.
"""

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm import hashing
from kerbline.llm.common import map_batches, written

BUCKETS, RUN, SEED = 10_000, 3, 42
#: Least words of a document that can be drawn, and how many of a hundred of these are.
LEAST_WORDS, SHARE = 20, 5
#: Text whose distinct words one dictionary holds: with its payloads it takes some 40 MB, and an idle worker keeps that.
SLICE_BYTES = 1 << 20
#: Ranks are counted in slots between that many quantiles of the upper tenth of scores.
SLOTS = 1000

#: A-Z become a-z, what can't be in a word becomes a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACE_CRC = np.uint32(zlib.crc32(b" "))
_BYTES = np.arange(256, dtype=np.uint32)

Batches = Iterator[pa.RecordBatch]


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on each byte (4 x 256)."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _zeros() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps of a CRC to that behind n more zero bytes: for all n below 64, and for each power of two from 64."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    step = np.stack([one] + [(_BYTES << np.uint32(8 * k)) >> np.uint32(8) for k in (1, 2, 3)])
    short = [np.stack([_BYTES << np.uint32(8 * k) for k in range(4)])]
    for _ in range(64):
        short.append(np.stack([_applied(step, row) for row in short[-1]]))
    long = [short.pop()]
    for _ in range(25):
        long.append(np.stack([_applied(long[-1], row) for row in long[-1]]))
    return np.stack(short, axis=1), long


_SHORT, _LONG = _zeros()


def _behind(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs with so many zero bytes appended, without the constant part: what ``a`` contributes to the CRC of ``a + b``."""
    low = length & 63
    out = _SHORT[0][low, crc & 255] ^ _SHORT[1][low, crc >> 8 & 255] ^ _SHORT[2][low, crc >> 16 & 255] ^ _SHORT[3][low, crc >> 24]
    for k, tables in enumerate(_LONG):
        far = length >> (6 + k) & 1 == 1
        if not (length >> (6 + k)).any():
            break
        out[far] = _applied(tables, out[far])
    return out


def composed(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of ``a + " " + b`` from those of ``a`` and ``b`` and the length of ``b``."""
    spaced = _behind(crc, np.ones(len(crc), np.int64)) ^ _SPACE_CRC
    return _behind(spaced, length) ^ other


def _dictionary(text: str) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in set(text.split(" ")):
        if word:
            automaton.add_word(f" {word} ", zlib.crc32(word.encode("latin-1")) | len(word) << 32)
    automaton.make_automaton()
    return automaton


def runs(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For texts: where each one's words begin among all words, and for 1 to ``RUN`` words the CRCs of the runs at each word.

    A run that would leave its text has no place: the arrays of longer runs come with a mask.
    """
    texts = [(t or "").encode().translate(_NORMAL) for t in column.to_pylist()]
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = b"".join([b" ", *(t + b" " for t in texts)]).decode("latin-1")  # one character a byte
    if not data.strip(" "):
        return np.zeros(len(texts) + 1, np.int64), [np.zeros(0, np.uint32)] * RUN
    found = np.fromiter(chain.from_iterable(_dictionary(data).iter(data)), np.int64).reshape(-1, 2)
    first = np.r_[0, np.searchsorted(found[:, 0], ends, "right")]
    crc, length = (found[:, 1] & 0xFFFFFFFF).astype(np.uint32), found[:, 1] >> 32
    out = [crc]
    for k in range(1, RUN):
        out.append(composed(out[-1][:-1], crc[k:], length[k:]) if len(crc) > k else np.zeros(0, np.uint32))
    return first, out


def _inside(first: np.ndarray, k: int) -> np.ndarray:
    """Places of words that have ``k`` more words of their text behind them."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(n) + k < last)


def _slices(batches: Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Slices of the texts with their words' bounds and runs' buckets; small batches are read together."""
    held, size = [], 0

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
        for start, stop in hashing.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(start, stop - start)
            first, crcs = runs(part.column("text"))
            yield part, first, [(c % np.uint32(BUCKETS)).astype(np.int64) for c in crcs]

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield from cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size = [], 0
    if size:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from cut(batch)


def _counted(batches: Batches) -> Batches:
    total = np.zeros(BUCKETS, np.int64)
    for _, first, buckets in _slices(batches):
        for k, b in enumerate(buckets):
            total += np.bincount(b[_inside(first, k)], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``(bucket, n)`` of all runs of one to three words of ``texts (text)``; a task sends on one number for each bucket."""
    counted = map_batches(texts.select(F.col("text").cast("string").alias("text")), _counted, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of each bucket to the documents', one added to every count.

    There are ``BUCKETS`` of them whatever the tables' size.
    """
    both = bucket_counts(docs).withColumn("side", F.lit(0)).unionByName(bucket_counts(target).withColumn("side", F.lit(1)))
    n = np.zeros((2, BUCKETS), np.int64)
    for row in both.collect():
        n[row["side"], row["bucket"]] = row["n"]
    (s, t), (all_s, all_t) = n.astype(np.float64), n.sum(axis=1).astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def _weighed(gain: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for part, first, buckets in _slices(batches):
            at = np.zeros(int(first[-1]) + 1, np.int64)
            features = np.zeros(len(part), np.int64)
            for k, b in enumerate(buckets):
                places = _inside(first, k)
                at[places] += gain[b[places]]
                features += np.maximum(np.diff(first) - k, 0)
            sums = np.r_[0, np.cumsum(at)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first)), pa.array(features), pa.array(sums[first[1:]] - sums[first[:-1]])], ["doc_id", "n_words", "n_features", "weight"]
            )

    return run


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row of ``docs (doc_id, text)``: the sum of its runs' gains."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, _weighed(gain), "doc_id long, n_words long, n_features long, weight long")


def _noise(doc_id: Column) -> Column:
    """Thousandths of a Gumbel variable that the id alone decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame) -> DataFrame:
    """``scored (doc_id, n_words, n_features, weight, score)`` with ``rank`` for the best of those with enough words.

    Scores are cut into slots at approximate quantiles, which are few; exact counts of the slots tell at which rank each begins,
    and only slots that reach into the drawn share are sorted, each in a task of its own.
    """
    able = scored.where(f"n_words >= {LEAST_WORDS} AND score IS NOT NULL")
    shares = [1 - 0.1 * i / SLOTS for i in range(1, SLOTS + 1)]
    cuts = able.agg(F.percentile_approx("score", shares, 20 * SLOTS).alias("cuts"), F.count("*").alias("n")).first()
    wanted = SHARE * cuts["n"] // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    limits = sorted(set(cuts["cuts"]), reverse=True)
    slot = F.size(F.filter(F.array(*map(F.lit, limits)), lambda limit: limit > F.col("score")))
    counts = able.groupBy(slot.alias("slot")).count().collect()  # at most a row for each cut and one more
    begins, upto = {}, 0
    for row in sorted(counts, key=lambda r: r["slot"]):
        if upto < wanted:
            begins[row["slot"]] = upto
        upto += row["count"]
    low = limits[max(begins)] if max(begins) < len(limits) else None
    reach = F.lit(True) if low is None else F.col("score") >= low
    reach = F.coalesce((F.col("n_words") >= LEAST_WORDS) & F.col("score").isNotNull() & reach, F.lit(False))
    starts = F.create_map(*chain.from_iterable((F.lit(s), F.lit(b)) for s, b in begins.items()))
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "doc_id", "n_features")
    best = scored.where(reach).withColumn("slot", slot).withColumn("rank", F.row_number().over(order) + starts[F.col("slot")]).drop("slot")
    best = best.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return best.unionByName(scored.where(~reach).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``, a row for each row of ``docs (doc_id, text, ...)``.

    ``weight`` sums the gains of the document's runs towards the texts of ``target (text, ...)``, ``score`` adds noise that the
    id decides, and ``rank`` numbers the drawn ones, best first, ties to the smaller doc_id. A null or wordless text has no
    runs and weight 0; it counts for nothing. A row without doc_id is counted and weighed, but has no score and no rank. Rows that repeat a
    doc_id each have a rank. An empty target makes every document's gains follow from the counts alone. Other columns are ignored.
    """
    scored = weighed(docs, gains(docs, target)).withColumn("score", F.col("weight") + _noise(F.col("doc_id")))
    return ranked(written(scored, "resampling-scores"))
