"""Spelling variants: words of a corpus grouped under the spelling they are a slip of.

Words are runs of ASCII and Latin-1 letters, counted over all texts. Two words are near
if one code point inserted, deleted or replaced turns one into the other.

Permuterm rotations. Every word is closed by a terminator and rotated at each place.
Rotated so that an edited character comes last, a word is the same up to that character
as each word that differs from it there only: ``b$a`` + ``c`` and ``b$a`` + ``d`` for a
replacement, ``b$a`` alone for the word without the character. Rotations are
range-partitioned and sorted, so words near by one edit share a key that is the
rotation without its last character, and stand next to each other. A key has at most one row for each letter
and one for the shorter word (``LETTERS`` + 1), whatever the corpus. One scan of the
sorted rows gives each row the number of its neighbours and the best of them, from the
two best rows of the key; no pair is written out. A character within a run of equal ones
is skipped for its first place only, so that no pair is met twice.

Roots are found by doubling: a form has at least ``RATIO`` times the occurrences, so a
chain is no longer than the logarithm of the largest count.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import texts, written

# The letters of a run, the only ones put in lower case, and the terminator, which is no letter.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"
LETTERS = 26 + 64
SLIP = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5


def word_counts(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, slip=SLIP, id_column="doc_id", text_column="text"):
    """``word, n``: distinct words of at least ``least_length`` code points and ``least_count`` occurrences.

    The run of a document whose hash with the document's id is divisible by ``slip``
    loses one code point (None: no run does). Equal runs are counted before they are
    shuffled.
    """
    low = F.translate("text", UPPER, LOWER)
    runs = texts(docs, id_column, text_column).select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("word"))
    runs = runs.where(F.length("word") >= least_length)
    if slip is not None:
        tagged = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
        at = (F.col("hash") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("hash", F.crc32(tagged.cast("binary")))
        runs = runs.select(F.when(F.col("hash") % slip == 0, shorter).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rotations(words):
    """``key, word, n, skipped, first``: each rotation whole, and without its last character.

    ``skipped``: a letter was left out of the key; ``first``: the letter before it in
    the word is another one.
    """
    length = F.length("word")
    turn = F.explode(F.sequence(F.lit(0), length)).alias("at")
    rows = words.select("word", "n", turn, F.concat("word", F.lit(END), "word").alias("twice"))
    whole = F.substring("twice", F.col("at") + 1, length + 1)
    skipped = F.substring("twice", F.col("at") + 1, length)
    first = F.substring("word", F.col("at"), F.lit(1)) != F.substring("word", F.col("at") - 1, F.lit(1))
    entry = lambda key, left_out, head: F.struct(key.alias("key"), left_out.alias("skipped"), head.alias("first"))
    full = entry(whole, F.lit(False), F.lit(False))
    # Rotated by ``at`` letters, the letter before that place comes last; unrotated, the terminator does.
    both = F.when(F.col("at") > 0, F.array(full, entry(skipped, F.lit(True), (F.col("at") == 1) | first))).otherwise(F.array(full))
    return rows.select("word", "n", F.explode(both).alias("e")).select("e.key", "word", "n", "e.skipped", "e.first")


def neighbours(rotated):
    """``word, n_near, best``: of each word the number of near words, and the most frequent one."""
    by_key = Window.partitionBy("key").orderBy(F.desc("skipped"), F.desc("n"), "word")
    group = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    scanned = (
        rotated.repartitionByRange("key")
        .withColumn("own", own)
        .withColumn("others", F.count_if("skipped").over(group))
        .withColumn("heads", F.count_if(F.col("skipped") & F.col("first")).over(group))
        .withColumn("best_skipped", F.first("own").over(group))
        .withColumn("second", F.nth_value("own", 2).over(group))
        .withColumn("best_head", F.first(F.when(F.col("skipped") & F.col("first"), F.col("own")), ignorenulls=True).over(group))
        # The whole rotation comes last, if there is one.
        .withColumn("shorter", F.last(F.when(~F.col("skipped"), F.col("own")), ignorenulls=True).over(group))
    )
    # A second row without a skipped letter is the shorter word, not another replacement.
    another = F.when(F.col("best_skipped") != F.col("own"), F.col("best_skipped")).when(F.col("others") > 1, F.col("second"))
    met = F.col("first") & F.col("shorter").isNotNull()
    near = F.when(F.col("skipped"), F.col("others") - 1 + met.cast("long")).otherwise(F.col("heads"))
    best = F.when(F.col("skipped"), F.least(another, F.when(F.col("first"), F.col("shorter")))).otherwise(F.col("best_head"))
    return (
        scanned.select("word", near.alias("near"), best.alias("best"))
        .groupBy("word")
        .agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    )


def with_roots(spark, forms, longest):
    """``word, root``: the end of the chain of forms that starts at each word, ``longest`` steps at most."""
    reached = written(spark, forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(longest, 1)))):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reached = written(spark, reached.join(ahead, "root").select("word", F.col("beyond").alias("root")), "roots")
    return reached


def spelling_variants(
    spark, docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, ratio=RATIO, slip=SLIP, id_column="doc_id", text_column="text"
):
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of the largest count (of equal ones the smallest in
    code-point order) if that is at least ``ratio`` (2 or more) times the word's own,
    else null; ``root`` is the last of the chain of forms, the word itself without one.
    Null and empty texts have no words; long texts are cut into words like others.
    Repeated rows count again; a null id hashes like the empty text. An empty table
    gives no rows. Other columns are not read.
    """
    counted = word_counts(docs, least_length, least_count, slip, id_column, text_column)
    words = written(spark, counted, "words")
    near = neighbours(rotations(words))
    taken = -F.col("best.minus") >= ratio * F.col("n")
    forms = words.join(near, "word").select(
        "word", "n", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")
    )
    forms = written(spark, forms, "forms")
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(largest, ratio)) + 1
    return forms.join(with_roots(spark, forms, steps), "word").select("word", "form", "root", "n", "n_near", "form_n")
