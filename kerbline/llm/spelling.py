"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letter multisets.

A word's vector has a one for each (letter, how many of it came before). One replaced letter changes two places of it, one
inserted or deleted letter one place. The places are dealt to ``PARTS`` parts; words of one length agree in all but two parts
at least, words whose lengths differ by one in all but one. Each word gives a signature for every choice of parts left out, so
an equi-join of signatures finds all near words, and their edit distance confirms them.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import written

PARTS = 6
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One in so many occurrences loses a letter.
LOSS = 97
#: A form occurs at least so many times as often as its variant.
RATIO = 2
_RUN = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """``(word, n)``: words of at least five letters and three occurrences, some of which have lost a letter by their hash.

    A row without doc_id loses no letters; null texts have no words.
    """
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))).alias("run"))
    rows = rows.where(F.length("run") >= LEAST_LETTERS)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % LOSS == 0, cut).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _folded(places: Column) -> Column:
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, place: total.bitwiseXOR(place))


def _parts(word: Column) -> Column:
    """Per part the XOR of the hashes of the places that it holds, and then the XOR of all."""
    letters = F.array_sort(F.split(word, ""))
    places = F.transform(letters, lambda c, i: F.xxhash64(c, i - F.array_position(letters, c).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: _folded(F.filter(places, lambda p: F.pmod(F.shiftright(p, 7), F.lit(PARTS)) == k)))


def near_words(counted: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: all ordered pairs of words of ``counted (word, n)`` that are exactly one edit apart."""
    parted = counted.select("word", "n", F.length("word").alias("length"), _parts(F.col("word")).alias("parts"))
    parted = written(parted.withColumn("all", _folded(F.col("parts"))), "word-parts")

    def signatures(length: Column, left_out: list[tuple[int, ...]]) -> DataFrame:
        keys = []
        for n, gone in enumerate(left_out):
            rest = F.col("all")
            for k in gone:
                rest = rest.bitwiseXOR(F.col("parts")[k])
            keys.append(F.xxhash64(rest, length, F.lit(n)))
        return parted.select(F.explode(F.array(*keys)).alias("signature"), "word", "n")

    def met(one: DataFrame, two: DataFrame, ordered: bool) -> DataFrame:
        two = two.select(F.col("signature").alias("other_signature"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        found = (F.col("signature") == F.col("other_signature")) & (F.levenshtein("word", "other", 1) == 1)
        if ordered:
            found = found & (F.col("word") < F.col("other"))
        return one.join(two, found).select("word", "n", "other", "other_n")

    same = signatures(F.col("length"), list(combinations(range(PARTS), 2)))
    single = [(k,) for k in range(PARTS)]
    pairs = met(same, same, True).unionByName(met(signatures(F.col("length"), single), signatures(F.col("length") + 1, single), False))
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.distinct().select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms (word, form)``: each round follows what is known once more, so rounds double the steps.

    Counts at least double with every step, so there are few.
    """
    known = written(forms.withColumnRenamed("form", "root"), "roots")
    while True:
        ahead = known.select(F.col("word").alias("via"), F.col("root").alias("next"))
        further = known.join(ahead, known["root"] == ahead["via"], "left")
        further = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        known = further.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, a row for each word of ``docs (doc_id, text, ...)``.

    ``form`` is the word's near word of the largest count, ties to the smaller one, if it is ``RATIO`` times as frequent at
    least; ``root`` is where following forms ends, the word itself without a form; ``n_near`` counts near words. No documents
    or words give no rows. Repeated rows of a document count again. Other columns are ignored.
    """
    counted = written(words(docs), "words")
    # The largest count first, then the smallest word: the maximum of a struct would take the largest word.
    near = near_words(counted).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    near = near.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.other").alias("form"), (-F.col("best.n") >= RATIO * F.col("n")).alias("formed"))
    near = written(near, "near-words")
    formed = near.where("formed").select(F.col("word").alias("of"), "form", "form_n")
    rooted = _roots(formed.select(F.col("of").alias("word"), "form")).withColumnRenamed("word", "from")
    out = counted.join(near.select(F.col("word").alias("near"), "n_near"), F.col("word") == F.col("near"), "left")
    out = out.join(formed, F.col("word") == F.col("of"), "left").join(rooted, F.col("word") == F.col("from"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
