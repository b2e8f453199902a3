"""Secrets in texts, told apart by how many owners share them.

Three base kinds are found by fixed patterns. The method adds bare tokens that look random: their hashes and those of all base
values are counted over the corpus by distinct repositories (documents) and owners (sources). A value that several owners have
is a copied example; one that stays with few is live-looking. Live-looking bare tokens are reported as further spans.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import map_batches, written

# The base kinds, in the order in which they are listed, and their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+(?<=[0-9a-f]{32})")
KINDS = ("assign", "access", "hex", "token")
LEAST = {"assign": 8, "access": 16}

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
#: Bits a character that a bare token must have to look random.
ENTROPY = 3.5
#: Owners from which on a value is a copied example.
SHARED = 3

Span = tuple[str, int, int, str]
Batches = Iterator[pa.RecordBatch]


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end, value)`` of the base kinds, by start and then kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def looks_random(token: str) -> bool:
    """Letters and digits, and characters spread widely enough."""
    if token.isalpha() or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) >= ENTROPY


def bare_tokens(text: str, base: list[Span]) -> list[Span]:
    """Random-looking tokens that no base span touches."""
    return [("token", m.start(), m.end(), m[0]) for m in TOKEN.finditer(text) if looks_random(m[0]) and not any(s[1] < m.end() and m.start() < s[2] for s in base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


def _scanned(batches: Batches) -> Batches:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))
    for batch in batches:
        columns = ([], [], [], [], [])
        for scalar in batch.column("text"):
            text = scalar.as_py() or ""
            base = base_spans(text)
            counts = Counter(s[0] for s in base)
            spans = [{"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest()} for k, a, b, v in base + bare_tokens(text, base)]
            for column, value in zip(columns, (counts["assign"], counts["access"], counts["hex"], joined(base), spans)):
                column.append(value)
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("owner"), *arrays], ["row", "doc_id", "owner", "n_assign", "n_access", "n_hex", "base", "found"])


_SCANNED = "row long, doc_id long, owner string, n_assign long, n_access long, n_hex long, base string, found array<struct<kind: string, start: long, end: long, value: binary>>"


def ownership(spans: DataFrame) -> DataFrame:
    """``(value, repositories, owners)`` of ``spans (value, row, owner)``: how many distinct ones hold each value hash.

    Copies inside a repository and an owner's repositories are added up first, so a value that a third of the corpus holds is
    one row for each owner and task by the time it is counted.
    """
    held = spans.select("value", "owner", "row").distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    return held.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs (doc_id, text, source, ...)``.

    ``n_assign, n_access, n_hex`` count the base spans, ``base`` lists them as kind:start:end in code points, joined by commas;
    ``spans`` lists these and the added ones; ``n_live`` and ``n_shared`` count spans whose value few or several owners have.
    Null texts are empty, null sources are one owner, and rows that repeat a doc_id are repositories of their own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"), F.col("text").cast("string").alias("text"))
    scanned = written(map_batches(rows, _scanned, _SCANNED), "secret-candidates")
    spans = scanned.select("row", "owner", F.explode("found").alias("s")).select("row", "owner", "s.*")
    judged = spans.join(ownership(spans), "value").withColumn("live", F.col("owners") < SHARED)
    kept = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("live") | (F.col("kind") != "token"), F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "kind", "end")))).alias("kept"),
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_shared"),
    )
    listed = F.array_join(F.transform("kept", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    zero = F.lit(0).cast("long")
    return scanned.drop("found").join(kept, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce(listed, F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_shared", zero).alias("n_shared"))
