"""Mixture-controlled packing of tokenised documents into fixed windows by deficit round-robin.

Each source is a queue of tokens. The queues' common order is cut into blocks of about ``BLOCK`` tokens so that every block
takes its exact share of each queue: block b of B takes tokens ``T*b//B`` to ``T*(b+1)//B``, which carries what a queue is owed
(less than a token) over from block to block. A block is one task's work: in each round, a window's worth, every queue is
credited its quantum and hands out whole packets as far as its credit goes; the rest of the credit, its deficit, stays for the
next rounds. The first window of a block continues the last of the block before, whose fill follows from the totals alone, so
blocks leave no padding between them: only the very last window has any.
"""

import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import find_package, map_batches, written
from kerbline.llm.hashing import slices

WINDOW, PACKET = 2048, 64
BLOCK = 4_000_000
END = 1  # closes each document
SPECIAL = "<|endoftext|>"
#: Beyond so many sources, sources share queues by hash: each window can't hold a part of every one.
MOST_QUEUES = 4096

Batches = Iterator[pa.RecordBatch]


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that the byte-level BPE of this vocabulary gives, special tokens in the text included, and the closing id."""
    encoding = _encoding(path)
    ids = encoding.encode(text, allowed_special={SPECIAL}) if SPECIAL in text else encoding.encode_ordinary(text)
    ids.append(END)
    return np.array(ids, "<u2" if encoding.n_vocab <= 1 << 16 else "<u4")


def _tokenised(path: str):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                ids = [token_ids(text or "", path) for text in part.column("text").to_pylist()]
                packed = [pa.compress(x, "zstd", asbytes=True) for x in ids]
                widths = [x.dtype.itemsize for x in ids]
                columns = [part.column("row"), part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array(widths, pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "source", "n", "width", "ids"])

    return run


def _dealt(block: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one block: every queue's share in rounds, cut at documents and windows."""
    block = block.sort_values(["queue", "q"], kind="stable")
    queues, firsts = np.unique(block["queue"].to_numpy(), return_index=True)
    b, blocks, start = int(block["b"].iloc[0]), int(block["blocks"].iloc[0]), int(block["before"].iloc[0])
    totals = [int(t) for t in block["total"].to_numpy()[firsts]]
    low = np.array([t * b // blocks for t in totals], np.int64)
    share = np.array([t * (b + 1) // blocks for t in totals], np.int64) - low
    rounds = max(1, -(-int(share.sum()) // WINDOW))
    credit = share[:, None] * np.arange(1, rounds + 1)[None, :] // rounds
    served = credit // PACKET * PACKET
    served[:, -1] = share
    lengths = np.diff(served, axis=1, prepend=0)
    begins = start + np.r_[0, np.cumsum(lengths.T.ravel())[:-1]].reshape(rounds, len(queues)).T
    out, lasts = [], np.r_[firsts[1:], len(block)]
    columns = [block[c].to_numpy() for c in ("row", "q", "n", "at")]
    for k in range(len(queues)):
        used = lengths[k] > 0
        segment, place = low[k] + served[k][used] - lengths[k][used], begins[k][used]
        row, q, n, at = (c[firsts[k] : lasts[k]] for c in columns)
        end = low[k] + share[k]
        cuts = np.unique(np.r_[segment, q[(q > low[k]) & (q < end)]])
        size = np.diff(np.r_[cuts, end])
        s, d = np.searchsorted(segment, cuts, "right") - 1, np.searchsorted(q, cuts, "right") - 1
        out.append((row[d], at[d] + cuts - q[d], size, place[s] + cuts - segment[s]))
    row, at, size, position = (np.concatenate(x) for x in zip(*out))
    # Cut where a piece runs over the end of a window.
    parts = (position + size - 1) // WINDOW - position // WINDOW + 1
    which = np.repeat(np.arange(len(row)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.where(nth == 0, position[which], (position[which] // WINDOW + nth) * WINDOW)
    end = np.minimum(position[which] + size[which], (begin // WINDOW + 1) * WINDOW)
    return pd.DataFrame({"row": row[which], "start": at[which] + begin - position[which], "length": end - begin, "position": begin})


def _with_ids(batches: Batches) -> Batches:
    for batch in batches:
        for first in range(0, len(batch), 500):
            part = batch.slice(first, 500)
            pieces = part.column("pieces")
            flat = pieces.flatten()
            counts = np.asarray(pieces.value_lengths())
            start, length, position = (np.asarray(flat.field(k)) for k in ("start", "length", "position"))
            crcs, k = np.empty(len(start), np.int64), 0
            ends = np.cumsum(counts)
            for i, (packed, n, width) in enumerate(zip(part.column("ids").to_pylist(), part.column("n").to_pylist(), part.column("width").to_pylist())):
                ids = memoryview(np.frombuffer(pa.decompress(packed, n * width, "zstd"), f"<u{width}").astype("<u4").tobytes())
                while k < ends[i]:
                    crcs[k] = zlib.crc32(ids[4 * start[k] : 4 * (start[k] + length[k])])
                    k += 1
            again = pa.array(np.repeat(np.arange(len(part)), counts))
            columns = [part.column("doc_id").take(again), pa.array(start), pa.array(length), pa.array(crcs), part.column("n").take(again), pa.array(position // WINDOW), pa.array(position % WINDOW), part.column("source").take(again)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _phases(totals: DataFrame, size: int, targets: Mapping[str, float] | None) -> DataFrame:
    """``(queue, skip, total, blocks, block, tokens)``: of each queue, the part it gives to each phase of the mixture.

    Without targets there is one phase, in the queues' own proportions. With targets a phase lasts until the next queue is
    empty and the others go on in their proportions; there are as many phases as targets at most.
    """
    spark = totals.sparkSession
    if targets is None:
        return totals.select("queue", F.lit(0).cast("long").alias("skip"), "total", F.lit(max(1, -(-size // BLOCK))).cast("long").alias("blocks"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("tokens"))
    have = {r["queue"]: r["total"] for r in totals.collect()}  # as many as targets, and one for the rest
    if any(targets.get(q, 0) <= 0 for q in have):
        raise ValueError("every target must be positive, and '' names the one of all other sources")
    rows, given, left, block, tokens = [], dict.fromkeys(have, 0), {q: t for q, t in have.items() if t}, 0, 0
    while left:
        span = min(t / targets[q] for q, t in left.items())
        part = {q: min(t, int(targets[q] * span + 1e-9)) for q, t in left.items()}
        part |= {q: left[q] for q in left if left[q] / targets[q] <= span}
        blocks = max(1, -(-sum(part.values()) // BLOCK))
        rows += [(q, given[q], t, blocks, block, tokens) for q, t in part.items() if t]
        block, tokens = block + blocks, tokens + sum(part.values())
        given = {q: given[q] + part.get(q, 0) for q in given}
        left = {q: t - part[q] for q, t in left.items() if t > part[q]}
    return spark.createDataFrame(rows, "queue string, skip long, total long, blocks long, block long, tokens long")


def pack(docs: DataFrame, vocabulary: str, targets: Mapping[str, float] | None = None) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source)`` of all rows of ``docs``.

    ``docs`` has doc_id, text, source and maybe more. ``vocabulary`` is a rank file of a byte-level BPE. ``targets`` maps
    sources to token proportions, '' stands for all sources that it doesn't name; by default each source's own share of the
    tokens. A null text is empty and yields its closing id alone; null sources are one source named ''; rows that repeat a
    doc_id are packed each; an empty table gives no pieces.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    tokens = written(map_batches(rows, _tokenised(vocabulary), "row long, doc_id long, source string, n long, width int, ids binary"), "tokens")
    queue = F.col("source")
    if targets is not None:
        queue = F.when(F.col("source").isin(*targets), F.col("source")).otherwise(F.lit(""))
    elif tokens.select("source").distinct().count() > MOST_QUEUES:
        queue = F.pmod(F.xxhash64("source"), F.lit(MOST_QUEUES)).cast("string")
    narrow = tokens.select("row", queue.alias("queue"), "n", F.xxhash64("doc_id", "row").alias("order"))
    size = narrow.agg(F.sum("n")).first()[0] or 0
    # A queue's order is random but fixed. Its running sums are taken in parts, so a large source is many tasks' work.
    parts = max(1, -(-size // BLOCK))
    narrow = narrow.withColumn("part", F.pmod("order", F.lit(parts)))
    sums = narrow.groupBy("queue", "part").agg(F.sum("n").alias("sum"))
    base = sums.withColumn("base", F.sum("sum").over(Window.partitionBy("queue").orderBy("part")) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("queue", "part").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.withColumn("inner", F.sum("n").over(inside) - F.col("n")).join(base, ["queue", "part"]).select("row", "queue", "n", (F.col("base") + F.col("inner")).alias("q"))
    phases = written(_phases(sums.groupBy("queue").agg(F.sum("sum").alias("total")), size, targets), "phases")
    # The part of each document that falls into each phase, then the blocks that this part touches.
    placed = placed.join(phases, "queue").where("q < skip + total AND q + n > skip")
    placed = placed.withColumn("at", F.greatest(F.lit(0), F.col("skip") - F.col("q"))).withColumn("n", F.least("n", F.expr("skip + total - q")) - F.col("at")).withColumn("q", F.expr("q + at - skip"))
    of = "(CAST({} + 1 AS DECIMAL(20,0)) * CAST(blocks AS DECIMAL(12,0)) + CAST(total AS DECIMAL(20,0)) - 1) DIV CAST(total AS DECIMAL(20,0)) - 1"
    touched = placed.withColumn("b", F.explode(F.sequence(F.expr(of.format("q")), F.expr(of.format("(q + n - 1)"))))).withColumn("id", F.expr("block + b"))
    before = phases.withColumn("b", F.explode(F.expr("sequence(0L, blocks - 1)"))).groupBy(F.expr("block + b").alias("id")).agg(F.sum(F.expr("CAST(total AS DECIMAL(20,0)) * CAST(b AS DECIMAL(12,0)) DIV CAST(blocks AS DECIMAL(12,0))")).alias("inner"), F.first("tokens").alias("tokens"))
    before = before.select("id", F.expr("tokens + inner").cast("long").alias("before"))
    find_package(docs.sparkSession)
    work = touched.join(before, "id").select("id", "row", "queue", "q", "n", "at", "total", "blocks", "b", "before")
    pieces = work.groupBy("id").applyInPandas(_dealt, "row long, start long, length long, position long")
    held = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "position")).alias("pieces"))
    return map_batches(tokens.join(held, "row"), _with_ids, _PIECE)
