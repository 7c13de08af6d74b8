"""Words that are one edit apart, found by asymmetric q-chunks, and the frequent form that a rare word stands for.

Of two words the longer one (of equal lengths the later one) gives two disjoint chunks, its first and its
last half; the other gives its positional grams of a chunk's length. One edit leaves one of the two chunks whole,
and moves it by one place at most: an edit behind the first chunk does not move it, and an edit before the last
chunk moves it by the difference of the lengths. Grams at other places meet no chunk and are not sent. What
meets is verified by its edit distance within the join, so only pairs that are near leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import write_shared

#: Letters of a word: A to Z, a to z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words with one chunk beyond which they are dealt out by their own hash.
CROWD = 500


def spelt_words(docs: DataFrame, least_length: int = 6, slip: int = 199) -> DataFrame:
    """(word) of each run of at least ``least_length`` letters in ``docs`` (doc_id, text), some with one letter left out.

    Only A to Z are lower-cased. Where ``slip`` divides the crc32 of ``<doc_id>:<run>``, the run loses
    the letter at crc32 modulo its length; what is then too short is dropped. A null text has no runs and
    a null id counts as the empty text. Texts of any length are read whole, a row for every run.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    low = low.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    crc = low.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_crc"))
    at = (F.col("_crc") % F.length("_run")).cast("int")
    without = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    spelt = F.when(F.col("_crc") % slip == 0, without).otherwise(F.col("_run"))
    return crc.select(spelt.alias("word")).filter(F.length("word") >= least_length)


def count_words(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times; partial counts leave each task first."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _chunks(words: DataFrame) -> DataFrame:
    """The first and the last half of every word: (length, place, gram, word, n)."""
    half = _half(F.length("word"))
    both = F.array(
        F.struct(F.lit(0).alias("place"), F.substring("word", F.lit(1), half).alias("gram")),
        F.struct(F.lit(1).alias("place"), F.substring("word", F.length("word") - half + 1, half).alias("gram")),
    )
    return words.select(F.length("word").alias("length"), "word", "n", F.inline(both))


def _grams(words: DataFrame) -> DataFrame:
    """The positional grams of every word that a chunk of an equally long or one letter longer word can meet."""
    own = F.length("word")
    reached = []
    for more in (0, 1):
        half = _half(own + more)
        reached += [
            F.struct((own + more).alias("length"), F.lit(0).alias("place"), F.substring("word", F.lit(1), half).alias("gram")),
            F.struct((own + more).alias("length"), F.lit(1).alias("place"), F.substring("word", own - half + 1, half).alias("gram")),
        ]
    return words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.inline(F.array(*reached)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of every two of ``words`` (word, n) one edit apart, once each.

    Words are taken as distinct and have two code points at least; shorter ones have no chunk and are near to none.
    A chunk of more than ``CROWD`` words is dealt out by word and meets its grams in every part, so that
    no task holds a whole crowd; every pair is still compared.
    """
    words = words.filter(F.length("word") >= 2).select("word", "n")
    key = ["length", "place", "gram"]
    chunks = _chunks(words)
    crowded = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > CROWD)
    crowded = write_shared(crowded.select(*key, F.ceil(F.col("_size") / CROWD).cast("int").alias("_parts")), "crowds")
    dealt = chunks.join(crowded, key, "left").withColumn("_part", F.pmod(F.xxhash64("word"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    met = _grams(words).join(crowded, key, "left")
    met = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    a, b = dealt.alias("a"), met.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*key, "_part")]
    half = _half(F.col("a.length"))
    first_differs = F.substring("a.word", F.lit(1), half) != F.substring("b.other", F.lit(1), half)
    once = (F.col("a.place") == 0) | first_differs
    turn = (F.length("b.other") < F.col("a.length")) | (F.col("b.other") < F.col("a.word"))
    return a.join(b, [*same, turn, F.levenshtein("a.word", "b.other", 1) == 1, once]).select("a.word", "a.n", "b.other", "b.other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends; every round doubles the steps taken."""
    hops = write_shared(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        hops = write_shared(hops.join(ahead, "root", "left").select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")), "hops")
        if hops.filter("_moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.drop("_moved")


def spelling_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    ``form`` is the near word of largest n, of equal ones the first in code-point order, if its n is at
    least ``ratio`` times the word's; else null. ``root`` follows forms to the last one, the word itself if it
    has none; as n grows with every step, this ends. ``n_near`` counts near words, 0 if there are none.
    Null words and counts take no part; more columns of ``words`` are left behind. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    words = write_shared(words.select("word", "n").filter("word IS NOT NULL AND n IS NOT NULL"), "words")
    pairs = near_pairs(words)
    sides = F.array(
        F.struct("word", F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")).alias("near")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("near")),
    )
    best = pairs.select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("_best"))
    often = -F.col("_best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("_best.form")).alias("form"), F.when(often, -F.col("_best.less")).alias("form_n")
    )
    found = write_shared(found, "forms")
    rooted = found.join(_roots(found.filter("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
