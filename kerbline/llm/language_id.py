"""Languages by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of its labelled text recognises exactly the sample's substrings. A text
is parsed greedily into the longest phrases that the automaton knows; the fewer phrases for its length, the nearer it is to
that language. Tasks parse many pieces of text side by side: one numpy step moves all of them by a byte. A piece is parsed as if
a phrase began with it; then the phrase that the piece before has left open goes on into it, until both parses begin one at the
same byte, from where on they are the same.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import map_batches
from kerbline.llm.hashing import slices
from kerbline.llm.quality import held_out

#: Bytes of text that a language's automaton is built of, at most.
SAMPLE_BYTES = 40_000
#: Whole texts are cut into passages of so many characters; some of a language's passages, drawn by hash, are its sample.
PASSAGE_CHARS, SAMPLE_PASSAGES = 2_000, 120
#: Bytes of the pieces of a text that are parsed side by side.
PIECE = 512
UNKNOWN = "und"

Batches = Iterator[pa.RecordBatch]


class Model(NamedTuple):
    """``steps[k]`` is language k's transition table (states x symbols, 0 for none; state 1 is the start)."""

    languages: list[str]
    symbol: np.ndarray
    steps: list[np.ndarray]


def plain(text: str) -> bytes:
    """Lower-case letters of the text, other characters as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()


def automaton(sample: np.ndarray, symbols: int) -> np.ndarray:
    """Transition table of the suffix automaton of a sequence of symbols."""
    most = 2 * len(sample) + 2
    steps, link, length = np.zeros((most, symbols), np.int32), [0] * most, [0] * most
    rows: list[dict[int, int]] = [{} for _ in range(most)]
    last, used = 1, 2
    for c in sample.tolist():
        new, used = used, used + 1
        length[new], p = length[last] + 1, last
        while p and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        elif length[q := rows[p][c]] == length[p] + 1:
            link[new] = q
        else:
            copy, used = used, used + 1
            length[copy], rows[copy], link[copy] = length[p] + 1, dict(rows[q]), link[q]
            while p and rows[p].get(c) == q:
                rows[p][c] = copy
                p = link[p]
            link[q] = link[new] = copy
        last = new
    for state in range(1, used):
        for c, to in rows[state].items():
            steps[state, c] = to
    return steps[:used]


def learn(texts: dict[str, list[str]]) -> Model:
    """A model of the texts of each language; texts without letters teach nothing."""
    samples = {k: b" ".join(p for p in map(plain, v) if p)[:SAMPLE_BYTES] for k, v in sorted(texts.items())}
    samples = {k: v for k, v in samples.items() if v}
    known = sorted({b for v in samples.values() for b in v})
    symbol = np.zeros(256, np.int64)  # symbol 0: a byte no sample has
    symbol[known] = np.arange(1, len(known) + 1)
    return Model(list(samples), symbol, [automaton(symbol[np.frombuffer(v, np.uint8)], len(known) + 1) for v in samples.values()])


def _moved(state: np.ndarray, c: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after a symbol each, and where a phrase begins with it: where none goes on; an unknown symbol is one by itself."""
    flat, width = steps.ravel(), steps.shape[1]
    to = flat[state * width + c]
    begun = (to == 0) | (state == 1)
    at = np.flatnonzero(begun)
    if len(at):
        fresh = flat[width + c[at]]
        to[at] = np.where(fresh == 0, 1, fresh)
    return to, begun


def phrases(pieces: np.ndarray, lengths: np.ndarray, before: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Phrases that begin in each row of symbols (longest rows first); ``before`` is the row that a row's text comes from, or -1."""
    state = np.ones(len(pieces), np.int64)
    begins = np.zeros(pieces.T.shape, bool)
    columns = np.ascontiguousarray(pieces.T)
    alive = np.searchsorted(-lengths, -np.arange(columns.shape[0]), "left")
    for k in range(columns.shape[0]):
        n = alive[k]
        state[:n], begins[k, :n] = _moved(state[:n], columns[k, :n], steps)
    after = np.full(len(pieces), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    rows = np.flatnonzero(before >= 0)
    while len(rows):  # once, but for open phrases that never meet the piece's own parse
        now, changed = state[before[rows]], []
        for k in range(columns.shape[0]):
            ended = lengths[rows] <= k
            if ended.any():
                changed.append(rows[ended][state[rows[ended]] != now[ended]])
                state[rows[ended]] = now[ended]
                rows, now = rows[~ended], now[~ended]
            if not len(rows):
                break
            now, begun = _moved(now, columns[k, rows], steps)
            met = begun & begins[k, rows]
            begins[k, rows] = begun
            rows, now = rows[~met], now[~met]
        changed.append(rows[state[rows] != now])
        state[rows] = now
        following = after[np.concatenate(changed)]
        rows = following[following >= 0]
    return begins.sum(axis=0)


def costs(model: Model, texts: list[bytes]) -> np.ndarray:
    """Phrases per byte of each text (a row) in each language (a column)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    owner = np.repeat(np.arange(len(texts)), -(-sizes // PIECE))
    lengths = np.array([len(p) for p in pieces], np.int64)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    follows = np.r_[False, owner[1:] == owner[:-1]][: len(owner)]
    before = np.where(follows, np.r_[-1, rank[:-1]][: len(owner)], -1)[order]
    table = np.frombuffer(b"".join(pieces[i].ljust(PIECE) for i in order), np.uint8).reshape(-1, PIECE) if pieces else np.zeros((0, PIECE), np.uint8)
    symbols = model.symbol[table[:, : lengths.max(initial=0)]].astype(np.int32)
    out = [np.bincount(owner[order], phrases(symbols, lengths[order], before, steps), len(texts)) / np.maximum(sizes, 1) for steps in model.steps]
    return np.stack(out, axis=1) if out else np.zeros((len(texts), 0))


def fit(docs: DataFrame) -> Model:
    """Learn from whole texts and languages of documents outside the held-out fold.

    Of each language some ``SAMPLE_PASSAGES`` passages are drawn by hash from all places of all its texts, so that long
    documents or common headers don't stand for it, and the first ``SAMPLE_BYTES`` of them are learned.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    passages = F.greatest(F.ceil(F.length("text") / PASSAGE_CHARS), F.lit(1)).cast("int")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.sum(passages).alias("n")).collect()}
    cut = usable.select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(0), passages - 1)).alias("at"))
    draw = F.pmod(F.xxhash64("doc_id", "at", F.lit(17)), F.lit(1_000_000_000))
    least = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000_000, 1_000_000_000 * SAMPLE_PASSAGES // n + 1)))), F.col("lang")) if counts else F.lit(0)
    passage = F.col("text").substr(F.col("at") * PASSAGE_CHARS + 1, F.lit(PASSAGE_CHARS))
    texts: dict[str, list[str]] = {}
    for row in sorted(cut.where(draw < least).select("lang", draw.alias("draw"), passage.alias("text")).collect()):
        texts.setdefault(row["lang"], []).append(row["text"])
    return learn(texts)


def _predicted(model: Model):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start, stop in slices(batch.column("text"), 2 << 20):
                part = batch.slice(start, stop - start)
                texts = [plain(t or "") for t in part.column("text").to_pylist()]
                cost = costs(model, texts)
                best = cost.argmin(axis=1) if model.languages else np.zeros(len(texts), int)
                # How far the runner-up is: 1 if no other language comes near, 0.5 for a tie.
                low = np.sort(cost, axis=1)
                score = low[:, 1] / np.maximum(low[:, 0] + low[:, 1], 1e-12) if len(model.languages) > 1 else np.ones(len(texts))
                known = [bool(t) and bool(model.languages) for t in texts]
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, a row for each row of ``docs (doc_id, text, ...)``.

    ``und`` with score 0 for a text that is null or has no letter, or if nothing was learned; ties go to the first language in
    order. The score is the runner-up's share of both costs: 0.5 for a tie.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_batches(texts, _predicted(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
