"""Spelling variants: words within one edit, by an even-partition pigeonhole join, all in DataFrame operations.

A word of length l is cut into two segments, [0, l // 2) and [l // 2, l). If another word of that length, or one longer,
is one edit away, the edit lies in one segment and the other is in both words: the first at the same place, the second
moved by the difference of the lengths. So words are indexed by (length, segment's place, segment), and every word
probes, for its own length and for one less, the substrings at those places. Candidates of a bucket are verified, and
a pair that two buckets propose is taken from one: that of the leftmost edit.

A bucket with more than ``DENSE`` candidates (words that share a long stem) isn't compared. The segment with the edit is
cut in two again: one half must agree as well, so its words go to two finer buckets each, and so on until buckets are
small or the edit's place is one character. Nothing is dropped, and the work of a shared stem stays near its pairs.

Forms go from a word to its most frequent near word; each is at least ``RATIO`` times as frequent, so paths end, and
pointers are doubled until they do.

Edge cases: null and empty texts have no words; a null id counts as an empty one in the hash. Long texts and words are
taken whole. Ties: of near words with equal counts the first in code-point order. Repeated rows count as often as they
are there; a table without words gives no rows. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize

LETTERS = "[a-zÀ-ÿ]+"
#: One run in so many loses a character, chosen by a hash of document and run.
DAMAGED = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
DENSE = 10_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: the runs of letters, lower-cased from A to Z only, some short of a character, by how often they occur."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(LETTERS), F.lit(0))).alias("w"))
    runs = runs.where(F.char_length("w") >= LEAST_LENGTH)  # a run only gets shorter
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    short = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    word = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, short).otherwise(F.col("w")).alias("word"))
    return word.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with head and tail, what must agree outside [a, b) of the shorter word, for words ``longer`` by 0 or 1."""
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("a")), "tail": F.substring("word", F.col("b") + F.col("longer") + 1, F.char_length("word"))})


def _places(low: Column, high: Column) -> Column:
    """The two halves in which the edit may lie: the right one if the left agrees, and the left one."""
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(middle.alias("a"), high.alias("b")), F.struct(low.alias("a"), middle.alias("b")))


BUCKET = ["l", "a", "b", "head", "tail"]


def _finer(rows: DataFrame) -> DataFrame:
    cut = rows.withColumn("__at", F.explode(_places(F.col("a"), F.col("b"))))
    return _keyed(cut.select("word", "n", "l", "longer", F.col("__at.a").alias("a"), F.col("__at.b").alias("b")))


def near_pairs(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """s, r and their counts sn and rn of all words within one edit, each pair once: ``s`` is the shorter word or, of
    equal ones, the first."""
    length = F.char_length("word")
    whole = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).withColumn("l", length - F.col("longer"))
    # longer 0 stands for the index and for probes of equal length, 1 for probes of one more
    level = _finer(whole.withColumns({"a": F.lit(0), "b": F.col("l")}))
    out = None
    while True:
        level = materialize(level, "segments")
        sizes = level.groupBy(*BUCKET).agg(F.count_if(F.col("longer") == 0).alias("i"), F.count_if(F.col("longer") == 1).alias("j")).where("i > 0 and i + j > 1")
        heavy = (F.col("i") * (F.col("i") - 1) / 2 + F.col("i") * F.col("j") > dense) & (F.col("b") - F.col("a") > 1)
        sizes = materialize(sizes.select(*BUCKET, heavy.alias("heavy")), "buckets")
        shared = level.join(sizes, BUCKET)
        light = shared.where("not heavy")
        index = light.where("longer = 0").select(*BUCKET, F.col("word").alias("s"), F.col("n").alias("sn"))
        probe = light.select(*BUCKET, F.col("word").alias("r"), F.col("n").alias("rn"), "longer")
        once = (F.col("longer") == 1) | (F.col("s") < F.col("r"))
        # the leftmost edit lies before b, unless b is the word's end
        here = (F.col("b") == F.col("l")) | (F.substring("s", F.lit(1), F.col("b")) != F.substring("r", F.lit(1), F.col("b")))
        found = index.join(probe, BUCKET).where(once & here & (F.levenshtein("s", "r", 1) == 1)).select("s", "r", "sn", "rn")
        out = found if out is None else out.unionByName(found)
        if sizes.where("heavy").isEmpty():
            return out
        level = _finer(shared.where("heavy").select("word", "n", "l", "longer", "a", "b"))


def variants(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form and form_n: the number of near words, and the most frequent if it is ``ratio`` times as
    frequent as the word."""
    both = pairs.select(F.col("s").alias("word"), F.struct((-F.col("rn")).alias("m"), F.col("r").alias("o")).alias("x"))
    both = both.unionAll(pairs.select(F.col("r").alias("word"), F.struct((-F.col("sn")).alias("m"), F.col("s").alias("o")).alias("x")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x").alias("x"))
    found = words.join(near, "word", "left")
    strong = -F.col("x.m") >= F.col("n") * ratio
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("x.o")).alias("form"), F.when(strong, -F.col("x.m")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form and more) with root: where following forms ends. Pointers are doubled, so a path of k
    words takes about log2 k rounds."""
    up = forms.select("word", "form")
    pointers = materialize(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "pointers")
    while True:
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = materialize(pointers.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "pointers")
        pointers = moved.select("word", "root")
        if moved.where("__moved").isEmpty():
            return forms.join(pointers, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = materialize(word_counts(docs, key, text), "words")
    forms = materialize(variants(words, near_pairs(words, dense)), "forms")
    return rooted(forms).select("word", "form", "root", "n", "n_near", "form_n")
