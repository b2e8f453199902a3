"""Benchmark items inside documents, up to a share of edits, by pigeonhole pieces and bit-parallel edit distance.

Texts are lower-cased words of letters and digits, joined by a space. An item of m characters may differ by ``m * ERRORS // 100``
edits; cut into one piece more than that, one piece at least must occur unchanged. An automaton finds all pieces of a block of
items in one pass over a text; where one is hit, Myers' bit-parallel distance is taken of the item in the stretch around it.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import map_batches

ERRORS = 7  # per cent of an item's characters
#: Of a shorter item a few edits make another phrase: it counts where it stands unchanged, as whole words.
LEAST_CHARS = 32
#: Items and characters that one pass over the documents looks for; they go out with the task.
BLOCK_ITEMS, BLOCK_CHARS = 4000, 2_000_000

_WORD = re.compile(r"[^\W_]+")

Batches = Iterator[pa.RecordBatch]
Item = tuple[int, str]


class Hit(NamedTuple):
    item: int
    edits: int
    start: int
    end: int


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def best_end(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Fewest edits between a pattern of m characters and a substring of the text, and where the first such substring ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = pattern.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        plus = (plus << 1) & full
        up = ((minus << 1) & full) | (full & ~(vertical | plus))
        down = plus & vertical
    return best, end


class Matcher:
    """Looks for one block of items."""

    def __init__(self, items: list[Item], errors: int = ERRORS, least: int = LEAST_CHARS) -> None:
        self.items: list[tuple[int, str, int, dict[str, int], dict[str, int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            if not text:
                continue
            budget, k = (len(text) * errors // 100 if len(text) >= least else -1), len(self.items)
            self.items.append((item, text, budget, masks(text), masks(text[::-1])))
            if budget < 0:
                pieces.setdefault(text, []).append((k, len(text)))
                continue
            cuts = [i * len(text) // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def hits(self, text: str) -> list[Hit]:
        """The best place of each item that the text holds."""
        found: dict[int, Hit] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for last, places in self.automaton.iter(text) if self.any else ():
            for k, offset in places:
                item, wanted, budget, forward, backward = self.items[k]
                if item in found and found[item].edits == 0:
                    continue
                begin = last + 1 - offset  # of the item, if no edit moves it
                if budget < 0:
                    if text[max(begin - 1, 0) : begin] in ("", " ") and text[last + 1 : last + 2] in ("", " "):
                        found[item] = Hit(item, 0, begin, last + 1)
                    continue
                spans = tried.setdefault(k, [])
                if any(a <= begin <= b for a, b in spans[-4:]):
                    continue
                # The stretch searched holds the item wherever it begins, within twice the budget.
                low = max(0, begin - 2 * budget)
                spans.append((begin - budget, begin + budget))
                stretch = text[low : begin + len(wanted) + 2 * budget]
                at = stretch.find(wanted)
                if at >= 0:
                    edits, end, start = 0, at + len(wanted), at
                else:
                    edits, end = best_end(forward, len(wanted), stretch)
                    if edits > budget:
                        continue
                    start = end - best_end(backward, len(wanted), stretch[:end][::-1])[1]
                if item not in found or edits < found[item].edits:
                    found[item] = Hit(item, edits, low + start, low + end)
        return list(found.values())


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """All items, in blocks of bounded size."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    count = max(1, -(-n * 5 // (4 * BLOCK_ITEMS)), -(-chars * 5 // (4 * BLOCK_CHARS)))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect()
        if rows:
            yield sorted((r["item_id"], normal(r["text"])) for r in rows)


def _found(items: list[Item]):
    def run(batches: Batches) -> Batches:
        matcher = Matcher(items)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                clean = normal(text.as_py())
                rows += [(doc, h.item, h.edits, clean.count(" ", 0, h.start + 1), clean.count(" ", 0, h.end) + 1) for h in matcher.hits(clean)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "start_word", "end_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, start_word, end_word)``: each item of ``benchmark (item_id, text)`` in each document that holds it.

    The words [start_word, end_word) are those of the normalised document, at the item's best and first place. An item below
    ``LEAST_CHARS`` normalised characters is found where its words stand unchanged, anywhere in a document. Null or blank
    texts and items match nothing, repeated rows are reported each, a row without doc_id with a null one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, edits long, start_word long, end_word long"
    out = texts.sparkSession.createDataFrame([], kind)
    for items in _blocks(benchmark):
        out = out.unionByName(map_batches(texts, _found(items), kind))
    return out


def _clean(items: list[Item]):
    def run(batches: Batches) -> Batches:
        matcher = Matcher(items)
        for batch in batches:
            keep = [not matcher.hits(normal(text.as_py())) for text in batch.column("text")]
            yield batch.filter(pa.array(np.array(keep, bool)))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text holds no item."""
    for items in _blocks(benchmark):
        docs = map_batches(docs, _clean(items), docs.schema)
    return docs
