"""Fuzzy line deduplication with DataFrame functions only.

A line is lower-cased and trimmed, each run of white space in it is one space. Its set holds the shingles of ``SHINGLE`` characters that begin at each of its places; a
shorter line is one shingle. The signature is ``HASHES`` min-hashes by one permutation: each shingle falls into one of ``BINS``
bins by its hash, and of a bin's hashes the one nearest (by XOR) to each of its ``ORDERS`` points is taken. Each band takes ``ROWS``
min-hashes of a bin, none twice; empty bins have no bands. By simulation a pair at the threshold is missed with probability 0.002
at most, 0.0034 for sets of four shingles. Candidate pairs from the bands of which ``LEAST`` min-hashes agree (four bits of each are
kept), four standard deviations less than at the threshold, are confirmed on full sets and joined to components; the first line of each component stays.
Pairs of buckets that stay open pass a bound by parities of their sets first, which no pair at the threshold fails.
"""

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import BROADCAST_ROWS, discard, join_checked, written
from kerbline.llm.components import bucket_components

SHINGLE = 5
BINS, ORDERS, ROWS, LEAST = 4, 16, 4, 28
HASHES = BINS * ORDERS
THRESHOLD = 75  # per cent
#: Numbers of 64 bits that a set's parities take.
WORDS = 16
#: One bit of each four: a number holds four bits of each of a bin's min-hashes.
LOWEST = 0x1111111111111111
_RANDOM = random.Random(11)
#: A point in each sixteenth of the numbers. A band has two and two neighbours: short lines still fill it, long lines by four hashes.
_POINTS = [(part << 60 | _RANDOM.getrandbits(60)) - (1 << 63) for part in (0, 1, 8, 9, 2, 3, 10, 11, 4, 5, 12, 13, 6, 7, 14, 15)]
#: White space other than a single space between words.
_WIDE_SPACES = ("  ", "\t", "\v", "\f", "\r", "\u00a0", "\u3000")


def _shingles(line: Column) -> Column:
    places = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(places)


def _normal(line: Column) -> Column:
    """Runs of white space are one space; lines that have single spaces between words only are passed over."""
    odd = reduce(Column.__or__, (F.contains(line, F.lit(space)) for space in _WIDE_SPACES))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\s\u00a0\u3000]+", " ")).otherwise(line))


def _raw_lines(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank, of documents with an id, in lower case."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.lower(F.col("text").cast("string")), "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\s\u00a0\u3000]"))


def _lines(docs: DataFrame) -> DataFrame:
    """Place, normal form and its hash of the lines that aren't blank."""
    rows = _raw_lines(docs).select("doc_id", "line_no", _normal(F.col("line")).alias("normal"))
    return rows.withColumn("id", F.xxhash64("normal"))


def _signed(docs: DataFrame) -> DataFrame:
    """``(id, k0, k1, ..., p0, p1, ...)`` of each distinct line: keys of its bands, and for each bin four bits of each min-hash; null for an empty bin.

    Shingles are cut from the line's characters of four bytes each, where a place is found without walking the line. Lines are
    dealt by ``id`` once; all grouping after that stays in place.
    """
    lines = _lines(docs).groupBy("id").agg(F.first("normal").alias("normal"))
    wide = lines.select("id", F.encode("normal", "UTF-32").alias("wide"))
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("wide") - 4 * SHINGLE + 1, F.lit(1)).cast("int"), F.lit(4))
    rows = wide.select("id", "wide", F.explode(starts).alias("start"))
    rows = rows.select("id", F.xxhash64(F.substring("wide", F.col("start"), F.lit(4 * SHINGLE))).alias("h"))
    least = (F.min(F.col("h").bitwiseXOR(F.lit(point))).alias(f"m{i}") for i, point in enumerate(_POINTS))
    found = rows.groupBy("id", F.col("h").bitwiseAND(F.lit(BINS - 1)).alias("bin")).agg(*least)
    bands = range(ORDERS // ROWS)
    keys = [F.xxhash64("bin", F.lit(b), *(F.col(f"m{b * ROWS + r}") for r in range(ROWS))).alias(f"key{b}") for b in bands]
    # The lowest bits of a min-hash tell the bin.
    prints = sum((F.shiftleft(F.shiftright(F.col(f"m{i}"), 4).bitwiseAND(F.lit(15)), 4 * i) for i in range(ORDERS)), F.lit(0).cast("long")).alias("print")
    found = found.select("id", "bin", *keys, prints)
    return found.groupBy("id").agg(
        *(F.max(F.when(F.col("bin") == n, F.col(f"key{b}"))).alias(f"k{n * len(bands) + b}") for n in range(BINS) for b in bands),
        *(F.max(F.when(F.col("bin") == n, F.col("print"))).alias(f"p{n}") for n in range(BINS)),
    )


def _fresh_name(taken: list[str], name: str) -> str:
    """A column name that ``taken`` lacks, whatever its case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def line_groups(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(id, label)``: the component of every distinct line (by hash of its normal form) that is like another one.

    ``places (id, doc_id, line_no)`` are all places of lines.
    """
    signed = written(_signed(docs), "line-signatures")
    bands, parts = range(HASHES // ROWS), range(BINS)
    members = signed.select("id", F.explode(F.array(*(f"k{b}" for b in bands))).alias("bucket")).where("bucket IS NOT NULL")
    prints = signed.select("id", *(F.coalesce(F.col(f"p{i}"), F.lit(0).cast("long")).alias(f"p{i}") for i in parts))
    texts: list[DataFrame] = []

    def named(frame: DataFrame, end: str) -> DataFrame:
        return frame.select(*(F.col(c).alias({"id": end, "bucket": "bucket", "label": f"l{end}", "items": f"x{end}"}.get(c, f"{c}{end}")) for c in frame.columns))

    # A four-bit part that differs leaves its lowest bit set.
    halves = [x.bitwiseOR(F.shiftrightunsigned(x, 1)) for x in (F.col(f"p{i}a").bitwiseXOR(F.col(f"p{i}b")) for i in parts)]
    differing = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(LOWEST))) for x in halves), F.lit(0))
    close = differing <= HASHES - LEAST

    def with_texts(needed: DataFrame) -> DataFrame:
        """Normal forms of lines; those that no round before has read are read, each at one of its places."""
        missing = needed
        for known in texts:
            missing = missing.join(known, "id", "left_anti")
        missing = written(missing, "lines-missing")
        if not texts or not missing.isEmpty():
            place = F.struct("doc_id", "line_no")
            wanted = join_checked(places, missing, "id", "left_semi").groupBy("id").agg(F.min(place).alias("place"))
            wanted = written(wanted.select(F.col("id").alias("of"), F.xxhash64("place.doc_id", "place.line_no").alias("place"), F.col("place.doc_id").alias("doc")), "lines-wanted")
            inside = written(wanted.select("doc").distinct(), "documents-wanted")
            # Few documents: only those are cut into lines.
            source = docs.join(F.broadcast(inside), F.col("doc_id").cast("long") == inside["doc"], "left_semi") if inside.count() <= BROADCAST_ROWS else docs
            rows = join_checked(_raw_lines(source).withColumn("place", F.xxhash64("doc_id", "line_no")), wanted.select("of", "place"), "place", "inner")
            rows = rows.select("of", _normal(F.col("line")).alias("normal")).where(F.xxhash64("normal") == F.col("of"))
            texts.append(written(rows.select(F.col("of").alias("id"), "normal"), "line-texts"))
            discard(wanted, inside)
        discard(missing)
        found = [known.join(needed, "id", "left_semi") for known in texts]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        return found[0]

    def sets(needed: DataFrame) -> DataFrame:
        shingles = F.array_distinct(F.transform(_shingles(F.col("normal")), lambda s: F.hash(s)))
        return written(with_texts(needed).dropDuplicates(["id"]).select("id", shingles.alias("items")), "line-sets")

    shared, total = F.size(F.array_intersect("xa", "xb")), F.size("xa") + F.size("xb")
    sizes = 100 * F.least(F.size("xa"), F.size("xb")) >= THRESHOLD * F.greatest(F.size("xa"), F.size("xb"))
    alike = sizes & (100 * shared >= THRESHOLD * (total - shared))

    def exact(pairs: DataFrame, items: DataFrame) -> DataFrame:
        return pairs.join(named(items, "a"), "a").join(named(items, "b"), "b").where(alike)

    def confirm(pairs: DataFrame) -> DataFrame:
        """Of pairs whose min-hashes are close, those whose sets are."""
        pairs = written(pairs.join(named(prints, "a"), "a").join(named(prints, "b"), "b").where(close).select("a", "b").distinct(), "close-pairs")
        needed = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "lines-needed")
        items = sets(needed)
        found = written(exact(pairs, items).select("a", "b"), "like-lines")
        discard(pairs, needed, items)
        return found

    def meeting(rows: DataFrame, test: Column, how: str) -> DataFrame:
        """Rows of ``rows (bucket, id, label, ...)`` with those of other components in their bucket, tested inside the join."""
        one, two = named(rows, "a"), named(rows, "b").withColumnRenamed("bucket", "other_bucket")
        other = (F.col("bucket") == F.col("other_bucket")) & (F.col("la") != F.col("lb"))
        return one.hint("merge").join(two, other & test, how)

    def able(live: DataFrame) -> DataFrame:
        """Members with min-hashes close to those of another component's in their bucket; no pair leaves the join."""
        return meeting(live.join(prints, "id"), close, "left_semi").select("bucket", F.col("a").alias("id"), F.col("la").alias("label"))

    def parities(items: DataFrame) -> DataFrame:
        """``(id, o0, o1, ...)``: which of ``64 * WORDS`` bits an odd number of a set's hashes fall on."""
        rows = items.select("id", F.explode("items").alias("h"))
        word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, h & 63)")
        return rows.groupBy("id").agg(*(F.coalesce(F.bit_xor(F.when(word == w, bit)), F.lit(0).cast("long")).alias(f"o{w}") for w in range(WORDS)))

    # A hash in one of two sets only changes one bit; at the threshold there are no more such hashes than a part of both sizes.
    odd = sum((F.bit_count(F.col(f"o{w}a").bitwiseXOR(F.col(f"o{w}b"))) for w in range(WORDS)), F.lit(0))
    within = (100 + THRESHOLD) * odd <= (100 - THRESHOLD) * (F.col("na") + F.col("nb"))

    def rest(live: DataFrame) -> DataFrame:
        """Labels of components that a link joins. Members bring their sets' parities into the bucket, which few pairs but links leave."""
        live = written(able(live), "open-buckets")
        needed = written(live.select("id").distinct(), "lines-needed")
        items = sets(needed)
        described = prints.join(items.select("id", F.size("items").alias("n")), "id").join(parities(items), "id")
        pairs = meeting(live.join(described, "id"), (F.col("la") < F.col("lb")) & close & within, "inner")
        pairs = written(pairs.select("a", "b", "la", "lb").distinct(), "close-pairs")
        links = written(exact(pairs, items).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "like-lines")
        discard(live, needed, items, pairs)
        return links

    found = bucket_components(members, confirm, rest, rounds=3, able=able)
    discard(signed, *texts)
    return found


def _repeated(docs: DataFrame, doc: str, gone: str) -> DataFrame:
    """``(doc, gone)``: of each document the numbers of its lines that aren't the first of their group."""
    places = written(_lines(docs).select("id", "doc_id", "line_no"), "line-places")
    groups = line_groups(docs, places).withColumnRenamed("id", "of")
    grouped = places.join(groups, places["id"] == groups["of"], "left").select(F.coalesce("label", "id").alias("label"), "doc_id", "line_no")
    grouped = written(grouped, "grouped-lines")
    discard(places)
    first = grouped.groupBy("label").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("label", "first")
    later = grouped.join(first, "label").where(F.struct("doc_id", "line_no") > F.col("first"))
    removed = written(later.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(gone)), "removed-lines")
    discard(grouped)
    return removed


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows and columns of ``docs (doc_id, text, ...)``, the text without repeated lines, and ``counts`` (long): lines, removed ones.

    Of each group of lines of similarity 0.75 or more, equal ones included and links followed on, the line with the smallest
    (doc_id, line number) stays. Blank lines always stay. A null text has no lines and stays null. Rows that repeat a doc_id
    count as one document and keep the same lines; a row without doc_id keeps all its lines and removes none elsewhere. Columns
    of the counts' names are replaced; any other column, whatever its name, is passed on.
    """
    doc, gone = (_fresh_name([*docs.columns, *counts], name) for name in ("repeated_in", "repeated_lines"))
    joined = join_checked(docs.withColumn(doc, F.col("doc_id").cast("long")), _repeated(docs, doc, gone), doc, "left")
    text = F.col("text").cast("string")
    line = F.split(text, "\n")
    kept = F.array_join(F.filter(line, lambda _, i: ~F.array_contains(gone, i)), "\n")
    numbers = [F.coalesce(F.size(line), F.lit(0)).cast("long"), F.coalesce(F.size(gone), F.lit(0)).cast("long")]
    passed = [F.when(F.col(gone).isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return joined.select(*passed, *(n.alias(c) for n, c in zip(numbers, counts)))
