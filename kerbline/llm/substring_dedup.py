"""Repeated passages by Rabin-Karp hashes of every fixed-length word window.

Tasks hash all windows of their texts. Of each hash a run of texts (a chunk) holds several times, all but the smallest
doc_id's are known to be repeats at once; the smallest is sent on, so a passage that fills a third of the corpus sends one
entry for each chunk and not for each document. Entries travel sorted, as differences, packed by hash range, and each range
finds the smallest doc_id of every hash. What comes back, packed for parts of the documents, are their repeated hashes, which
a part's texts turn into maximal intervals of words.
"""

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import hashing
from kerbline.llm.common import find_package, map_batches

WIDTH = 13
#: Windows of a hash range, which one task holds at a time: about 100 MB.
RANGE_WINDOWS = 3_000_000
CHUNK_BYTES = 12 << 20
#: Text of a part of the documents, which one task holds at a time.
PART_BYTES = 16 << 20

Batches = Iterator[pa.RecordBatch]


def _pack(values: np.ndarray) -> bytes:
    """Integers with like bytes side by side, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), "zstd", asbytes=True) if len(values) else b""


def _unpack(packed: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(packed, n * width, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _entries(width: int, ranges: int) -> Callable[[Batches], Batches]:
    limits = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)

    def chunk(texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, ids = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
        known, index = np.unique(ids, return_inverse=True)
        order = np.lexsort((index, hashes))
        hashes, index = hashes[order], index[order].astype(np.uint32)
        head = np.r_[True, hashes[1:] != hashes[:-1]]
        lead = index[np.flatnonzero(head)][np.cumsum(head) - 1]
        again = (index != lead) & np.r_[True, (hashes[1:] != hashes[:-1]) | (index[1:] != index[:-1])]
        out = {k: [] for k in ("range", "n", "hashes", "docs", "n_again", "again", "again_docs", "ids")}
        parts = [(hashes[head], index[head]), (hashes[again], index[again])]
        cuts = [np.r_[0, np.searchsorted(h, limits), len(h)] for h, _ in parts]
        for r in range(ranges):
            (h, d), (g, e) = [tuple(x[c[r] : c[r + 1]] for x in part) for part, c in zip(parts, cuts)]
            if len(h):  # every hash has a head, so nothing else can be there
                used = np.unique(np.r_[d, e])
                small = np.uint16 if len(used) <= 1 << 16 else np.uint32
                values = (r, len(h), _pack(np.diff(h, prepend=np.uint64(0))), _pack(np.searchsorted(used, d).astype(small)), len(g), _pack(np.diff(g, prepend=np.uint64(0))), _pack(np.searchsorted(used, e).astype(small)), _pack(np.diff(known[used], prepend=np.int64(0))))
                for k, v in zip(out, values):
                    out[k].append(v)
                out.setdefault("n_ids", []).append(len(used))
        kinds = {"range": pa.int32(), "n": pa.int32(), "n_again": pa.int32(), "n_ids": pa.int32()}
        names = ["range", "n", "hashes", "docs", "n_again", "again", "again_docs", "n_ids", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(out[k] if k in out else [], kinds.get(k, pa.binary())) for k in names], names)

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            for start, stop in hashing.slices(batch.column("text")):
                words = hashing.split_words(batch.column("text").slice(start, stop - start))
                found, place = hashing.windows(words, width)
                ids = np.asarray(batch.column("doc_id").slice(start, stop - start))
                if len(found):
                    held.append((found, ids[np.searchsorted(words.first, place, "right") - 1]))
                    size += len(words.data)
                if size >= CHUNK_BYTES:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    return run


_ENTRY = "range int, n int, hashes binary, docs binary, n_again int, again binary, again_docs binary, n_ids int, ids binary"


def _repeats(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Of one hash range: the documents' windows that a smaller doc_id has as well, a row for each part of the documents."""

    def run(group: pa.Table) -> pa.Table:
        hashes, docs, more = [], [], []
        for row in group.to_pylist():
            small = np.uint16 if row["n_ids"] <= 1 << 16 else np.uint32
            ids = np.cumsum(_unpack(row["ids"], row["n_ids"], np.int64))
            hashes.append(np.cumsum(_unpack(row["hashes"], row["n"], np.uint64), dtype=np.uint64))
            docs.append(ids[_unpack(row["docs"], row["n"], small)])
            more.append((np.cumsum(_unpack(row["again"], row["n_again"], np.uint64), dtype=np.uint64), ids[_unpack(row["again_docs"], row["n_again"], small)]))
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        late = d > np.repeat(np.minimum.reduceat(d, head), np.diff(np.r_[head, len(h)]))
        h, d = np.concatenate([h[late], *(m[0] for m in more)]), np.concatenate([d[late], *(m[1] for m in more)])
        known, index = np.unique(d, return_inverse=True)
        part = np.array([_part(k, parts) for k in known.tolist()], np.int64)
        order = np.lexsort((index, part[index])) if len(d) else index
        h, d, place = h[order], d[order], part[index][order] if len(d) else index
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(d) else index
        rows = list(zip(cuts, np.r_[cuts[1:], len(d)] if len(d) else cuts))
        columns = [pa.array(place[cuts], pa.int64()), pa.array([int(b - a) for a, b in rows], pa.int64()), pa.array([_pack(np.diff(d[a:b], prepend=np.int64(0))) for a, b in rows], pa.binary()), pa.array([h[a:b].tobytes() for a, b in rows], pa.binary())]
        return pa.table(columns, ["part", "n", "docs", "hashes"])

    return run


def _part(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CLEANED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", _SPANS), ("text", pa.string())])


def _cleaned(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        held: dict[int, list[np.ndarray]] = {}
        for row in repeats.to_pylist():
            docs = np.cumsum(_unpack(row["docs"], row["n"], np.int64))
            known = np.frombuffer(row["hashes"], np.uint64)
            heads = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            for doc, own in zip(docs[heads].tolist(), np.split(known, heads[1:])):
                held.setdefault(doc, []).append(own)
        out = []
        for batch in texts.to_batches():
            for start, stop in hashing.slices(batch.column("text")):
                out.append(_batch(batch.slice(start, stop - start), held, width))
        return pa.Table.from_batches(out, _CLEANED)

    return run


def _batch(part: pa.RecordBatch, held: dict[int, list[np.ndarray]], width: int) -> pa.RecordBatch:
    words = hashing.split_words(part.column("text"))
    found, place = hashing.windows(words, width)
    bounds = np.searchsorted(place, words.first)
    counts, spans, texts = np.diff(words.first), [], []
    for i, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())):
        tokens, here = (text or "").encode().split(), []
        if doc in held:
            mine = slice(bounds[i], bounds[i + 1])
            at = place[mine][np.isin(found[mine], np.concatenate(held[doc]))] - words.first[i]
            steps = np.bincount(at, minlength=len(tokens) + 1) - np.bincount(at + width, minlength=len(tokens) + 1)
            gone = np.cumsum(steps)[: len(tokens)] > 0
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            here = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            tokens = compress(tokens, ~gone)
        spans.append(here)
        texts.append(b" ".join(tokens))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(texts, pa.binary()).cast(pa.string())], schema=_CLEANED)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, removed, text)``, a row for each row of ``docs (doc_id, text, ...)``.

    ``removed`` holds the maximal intervals [start, end) of words covered by windows that also start in a document with a
    smaller doc_id; ``text`` is the other words, joined by a space. Windows are judged on the input. Null texts have no words.
    Rows that share a doc_id don't remove from each other; a row without doc_id keeps all and removes nothing elsewhere.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, size // (6 * RANGE_WINDOWS))
    parts = max(8, size // PART_BYTES)
    entries = map_batches(texts.where("doc_id IS NOT NULL"), _entries(width, ranges), _ENTRY)
    find_package(docs.sparkSession)
    found = entries.groupBy("range").applyInArrow(_repeats(parts), "part long, n long, docs binary, hashes binary")
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(parts))).otherwise(F.crc32(F.col("doc_id").cast("string")) % parts).cast("long")
    kind = "doc_id long, n_words long, removed array<struct<start: long, end: long>>, text string"
    return texts.withColumn("part", part).groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_cleaned(width), kind)
