"""Log lines: time, severity, windows of batches, lines of failures, page text.

A log table has ``app_id, file, line_no, line``; line numbers are gap-free
per file. Time is epoch millis.
"""

from pyspark.sql import functions as F

from ..functions.ordered import carried, spread_join, tail_by_number, union_all
from ..functions.text import error_token, line_ms, severity
from ..session import written

FILE = ["app_id", "file"]
LINES_PER_CHUNK = 65536
# The shortest piece of a window is 2**13 ms, some 8 seconds; 51 levels of doubled length take any window.
PIECE_BITS = 13
PIECE_LEVELS = 51
# Units of 2**PIECE_BITS ms are counted in chunks of 2**UNIT_BITS, some 70 minutes.
UNIT_BITS = 9
# Lines that are joined with windows together.
LINES_PER_CELL = 256
# Characters of a run by which error words are looked up.
GRAM = 4
DRIVER = "driver"


def timed(lines):
    return lines.withColumn("ts_ms", line_ms("line"))


def fill_time(lines, keys=FILE):
    """``ts_ms`` of each line and ``time_ms``, carried from the last dated line before it.

    Carried chunk by chunk, so a long file is spread over tasks.
    """
    chunked = timed(lines).withColumn("_chunk", F.floor(F.col("line_no") / LINES_PER_CHUNK))
    return carried(chunked, keys, ["_chunk"], ["line_no"], fill={"time_ms": F.col("ts_ms")}).drop("_chunk")


def driver_lines(lines):
    """Lines of the drivers' logs; without ``executor_id`` all lines are taken as such."""
    return lines.where(F.col("executor_id") == DRIVER) if "executor_id" in lines.columns else lines


def log_time_profile(lines):
    """Dated and undated lines per file and hour, with first and last time."""
    return (
        timed(lines)
        .groupBy(*FILE, F.floor(F.col("ts_ms") / 3_600_000).alias("hour"))
        .agg(F.count(F.lit(1)).alias("lines"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    )


def severity_counts(lines):
    """Lines per file, hour and severity; undated lines belong to the hour before them."""
    return (
        fill_time(lines)
        .groupBy(*FILE, F.floor(F.col("time_ms") / 3_600_000).alias("hour"), severity("line").alias("severity"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def log_slice(lines, start_ms, end_ms):
    """Lines in ``[start, end]``: undated lines go with the dated line before them.

    Reading stops for good at the first line dated after the end.
    """
    filled = fill_time(lines)
    past = F.when(F.col("ts_ms") > end_ms, F.col("line_no"))
    cut = timed(lines).where(F.col("ts_ms") > end_ms).groupBy(*FILE).agg(F.min(past).alias("_cut"))
    inside = filled.where(F.col("time_ms").between(start_ms, end_ms))
    return (
        spread_join(inside, cut, FILE, ["line_no"], "left")
        .where(F.col("_cut").isNull() | (F.col("line_no") < F.col("_cut")))
        .drop("_cut")
    )


def _shifted(value, by):
    return F.call_function("shiftright", value, by)


def window_pieces(windows):
    """Windows (``from_ms, to_ms`` and more) cut into pieces ``_level, _piece`` of power-of-two length.

    Piece p of level k covers ``[p, p + 1) * 2**(PIECE_BITS + k)`` ms. The pieces
    of a window are disjoint, at most two a level, and reach past its ends by less
    than the shortest piece. A window that ends before it starts has none.
    """
    first = _shifted(F.col("from_ms"), F.lit(PIECE_BITS))
    end = _shifted(F.col("to_ms"), F.lit(PIECE_BITS)) + 1

    def of_level(k):
        left, right = -_shifted(-first, k), _shifted(end, k)
        odd = lambda n: F.pmod(n, F.lit(2)) == 1
        left_piece = F.when((left < right) & odd(left), F.struct(k.alias("_level"), left.alias("_piece")))
        right_piece = F.when((left < right) & odd(right), F.struct(k.alias("_level"), (right - 1).alias("_piece")))
        return F.array_compact(F.array(left_piece, right_piece))

    levels = F.sequence(F.lit(0), F.lit(PIECE_LEVELS - 1))
    return windows.withColumn("_at", F.explode(F.flatten(F.transform(levels, of_level)))).select("*", "_at.*").drop("_at")


def _at_ranks(windows, filled):
    """Ranks of times and windows among the dated lines of their app, from one running count.

    Time is counted in units of ``2**PIECE_BITS`` ms. Rows with ``_order`` 1 are units
    with lines (``_n`` lines after ``_before`` earlier ones); the others are windows
    (``_w``), 0 at their start and 2 at their end, after ``_upto`` lines.
    """
    unit = lambda time: _shifted(time, F.lit(PIECE_BITS))
    units = filled.where(F.col("time_ms").isNotNull()).groupBy("app_id", unit(F.col("time_ms")).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    closed = windows.where(F.col("from_ms") <= F.col("to_ms")).select("app_id", F.struct(*windows.columns).alias("_w"))
    ends = F.array(*[F.struct(unit(F.col(f"_w.{c}")).alias("_unit"), F.lit(o).alias("_order")) for c, o in (("from_ms", 0), ("to_ms", 2))])
    marks = union_all([
        units.select("app_id", F.lit(None).cast(closed.schema["_w"].dataType).alias("_w"), "_unit", F.lit(1).alias("_order"), "_n"),
        closed.select("app_id", "_w", F.inline(ends), F.lit(0).cast("long").alias("_n")),
    ]).withColumn("_chunk", _shifted(F.col("_unit"), F.lit(UNIT_BITS)))
    ranked = carried(marks, ["app_id"], ["_chunk"], ["_unit", "_order"], total={"_upto": F.col("_n")})
    return ranked.select("app_id", "_w", "_order", "_unit", "_n", "_upto", (F.col("_upto") - F.col("_n")).alias("_before"))


def time_cells(windows, filled):
    """Windows and dated lines with the cell ``_cell`` of their app in which they meet.

    Lines are ranked by time, those of one unit of some 8 seconds in no order, and
    every ``LINES_PER_CELL`` ranks of an app are a cell. A line is in one cell; a
    window is repeated for each cell its ranks reach into, which is one row for
    ``LINES_PER_CELL`` of its lines, and two more. A busy time is many cells.
    """
    ranks = written(filled.sparkSession, _at_ranks(windows, filled), "log-ranks")
    cell = lambda rank: F.floor(rank / LINES_PER_CELL)
    units = ranks.where(F.col("_order") == 1).select("app_id", "_unit", "_n", "_before")
    lines = (
        filled.where(F.col("time_ms").isNotNull())
        .withColumn("_unit", _shifted(F.col("time_ms"), F.lit(PIECE_BITS)))
        .join(units, ["app_id", "_unit"])
        .withColumn("_cell", cell(F.col("_before") + F.pmod(F.xxhash64("file", "line_no"), F.col("_n"))))
        .drop("_unit", "_n", "_before")
    )
    first, end = (F.max(F.when(F.col("_order") == o, F.col("_upto"))) for o in (0, 2))
    spans = (
        ranks.where(F.col("_order") != 1)
        .groupBy("app_id", "_w")
        .agg(first.alias("_first"), end.alias("_end"), F.count_if(F.col("_order") == 2).alias("_copies"))
        .where(F.col("_first") < F.col("_end"))
        # Equal windows are repeated as they came.
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .withColumn("_cell", F.explode(F.sequence(cell(F.col("_first")), cell(F.col("_end") - 1))))
        .select("_cell", "_w.*")
    )
    return spans, lines


def in_windows(windows, filled):
    """Pairs of a window (``app_id, from_ms, to_ms`` and more) and a line inside it.

    An equi-join of :func:`time_cells`: lines are shuffled once, however long
    windows are. ``filled`` is read twice.
    """
    # The pairs may be hundreds of times the rows joined, by whose size partitions would be merged.
    partitions = int(filled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans, lines = [df.repartition(partitions, "app_id", "_cell") for df in time_cells(windows, filled)]
    # Lines come second, as the side that is held for a cell: there are some LINES_PER_CELL of them.
    pairs = spans.hint("merge").join(lines, ["app_id", "_cell"])
    return pairs.where(F.col("time_ms").between(F.col("from_ms"), F.col("to_ms"))).drop("_cell")


def lines_in_windows(windows, filled, ids):
    """How many lines each window (``app_id, from_ms, to_ms`` and ``ids``) has: ``app_id, ids, lines``.

    Lines up to the window's end less those before its start, from one running
    count of lines by time, so a window costs two rows however many lines are in
    it. Windows without lines are left out, and those with the same ids are added up.
    """
    closed = windows.where(F.col("from_ms") <= F.col("to_ms"))
    none = [F.lit(None).cast(windows.schema[i].dataType).alias(i) for i in ids]
    at = lambda time, order, sign: closed.select(
        "app_id", *ids, time.alias("time_ms"), F.lit(order).alias("_order"), F.lit(sign).alias("_sign"), F.lit(0).cast("long").alias("_n")
    )
    times = filled.where(F.col("time_ms").isNotNull()).groupBy("app_id", "time_ms").agg(F.count(F.lit(1)).alias("_n"))
    marks = union_all([
        times.select("app_id", *none, "time_ms", F.lit(1).alias("_order"), F.lit(0).alias("_sign"), "_n"),
        at(F.col("from_ms"), 0, -1), at(F.col("to_ms"), 2, 1),
    ]).withColumn("_chunk", F.floor(F.col("time_ms") / 3_600_000))
    counted = carried(marks, ["app_id"], ["_chunk"], ["time_ms", "_order"], total={"_upto": F.col("_n")})
    found = counted.where(F.col("_sign") != 0).groupBy("app_id", *ids).agg(F.sum(F.col("_sign") * F.col("_upto")).alias("lines"))
    return found.where(F.col("lines") > 0)


def named_numbers(lines):
    """Lines that say ``batch`` and a number, repeated as ``_n`` for each start of their numbers."""
    numbers = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"batch (\d+)"), F.lit(1)))
    prefixes = F.array_distinct(
        F.flatten(F.transform(numbers, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.substring(s, 1, k))))
    )
    return lines.where(F.lower("line").contains("batch ")).withColumn("_n", F.explode(prefixes))


def batch_log_counts(batches, lines):
    """How many lines :func:`batch_log_slice` has for each batch, without the pairs of batch and line: ``lines``."""
    ids = ["query_id", "batch_id"]
    lines = driver_lines(lines)
    by_time = lines_in_windows(batches.select("app_id", *ids, "from_ms", "to_ms"), fill_time(lines), ids)
    undated = batches.where(F.col("from_ms").isNull()).select("app_id", *ids, F.col("batch_id").cast("string").alias("_n"))
    says = named_numbers(lines).groupBy("app_id", "_n").agg(F.count(F.lit(1)).alias("lines"))
    named = undated.join(says, ["app_id", "_n"]).select("app_id", *ids, "lines")
    return by_time.unionByName(named).groupBy("app_id", *ids).agg(F.sum("lines").alias("lines"))


def batch_log_slice(batches, lines):
    """Driver-log lines of every micro-batch.

    ``batches`` has ``app_id, query_id, batch_id, from_ms, to_ms``. Batches
    without any time get the lines that name them: a line saying ``batch 123``
    matches batches 1, 12 and 123, as a text search would, so it joins on the
    prefixes of its numbers. Executors' logs are left out. Lines with their times
    and windows are written once, as several steps read them.
    """
    spark = lines.sparkSession
    ids = ["app_id", "query_id", "batch_id"]
    filled = written(spark, fill_time(driver_lines(lines)), "filled-lines")
    spans = written(spark, batches.select(*ids, "from_ms", "to_ms"), "log-windows")
    by_time = in_windows(spans, filled).select(*ids, "file", "line_no", "line")
    undated = spans.where(F.col("from_ms").isNull()).select(*ids, F.col("batch_id").cast("string").alias("_n"))
    named = named_numbers(filled).join(undated, ["app_id", "_n"]).select(*ids, "file", "line_no", "line")
    return union_all([by_time, named])


def failure_log_views(failures):
    """The log searches failures lead to: ``app_id, executor_id, needle, failures``.

    A task failure searches its executor's log for its error; other executor
    failures show the whole log (an empty needle). Failures that lead to the
    same search are counted once, so a mass failure is one search.
    """
    needle = F.when(F.col("kind") == "task", F.lower(error_token("detail")))
    return (
        failures.where(F.col("executor_id").isNotNull())
        .groupBy("app_id", "executor_id", F.coalesce(needle, F.lit("")).alias("needle"))
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def _grams(text):
    """Distinct runs of ``GRAM`` characters of a text; the whole of a shorter one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, GRAM)))


def words_with_needles(words, needles, keys):
    """Which of many needles are part of which word: ``keys, word, needle``, each pair once.

    ``words`` has ``keys, word`` and ``needles`` has ``keys, needle``, both
    distinct; words are lower-case. A needle is looked up by the one of its
    character runs that fewest words have, and then compared, so the work grows
    with the words that look alike and not with words times needles. A needle
    shorter than ``GRAM`` characters is looked up by its text in words cut to
    that length.
    """
    short = F.length("needle") < GRAM
    of_words = words.withColumn("_gram", F.explode(_grams(F.col("word"))))
    of_needles = needles.where(~short).withColumn("_gram", F.explode(_grams(F.col("needle"))))
    wanted = of_needles.select(*keys, "_gram").distinct()
    often = of_words.join(wanted, [*keys, "_gram"], "left_semi").groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        # A needle with a run that no word has is in no word.
        of_needles.join(often, [*keys, "_gram"], "left")
        .groupBy(*keys, "needle")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_least"))
        .where(F.col("_least._n") > 0)
        .select(*keys, "needle", F.col("_least._gram").alias("_gram"))
    )
    long_ones = of_words.join(rarest, [*keys, "_gram"]).where(F.contains("word", "needle")).select(*keys, "word", "needle")
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, n)))))
    brief = needles.where(short)
    may = words.join(brief.select(*keys).distinct(), keys, "left_semi").where(F.length("word") > 0)
    short_ones = may.withColumn("needle", F.explode(pieces)).join(brief.select(*keys, "needle"), [*keys, "needle"])
    return long_ones.unionByName(short_ones.select(*keys, "word", "needle"))


def failure_log_lines(failures, lines):
    """Lines that failure searches of their executor find, once each.

    ``lines`` has ``executor_id``. ``needles`` are the error words in the line,
    ``failures`` how many failures search for one of them. Searches for a whole
    log are counted by :func:`failure_whole_logs`, not written out. An error word
    has no white space, ``:`` or ``(``, so it is searched in the distinct words
    between those, and lines are found by their words. A line number that
    comes twice in a file is found by the words of both its lines. The searches
    and the distinct words are written once, as several steps read them.
    """
    spark = lines.sparkSession
    keys, ids = ["app_id", "executor_id"], ["app_id", "executor_id", "file", "line_no"]
    views = written(spark, failure_log_views(failures).where(F.col("needle") != ""), "log-searches")
    searched = views.groupBy(*keys).agg(F.min(F.length("needle")).alias("_least"))
    worded = (
        spread_join(lines.select(*ids, "line"), searched, keys, ["file", "line_no"])
        .select(*ids, "_least", F.explode(F.array_distinct(F.split(F.lower("line"), r"[\s:(]+"))).alias("word"))
        .where(F.length("word") >= F.col("_least"))
        .drop("_least")
    )
    words = written(spark, worded.select(*keys, "word").distinct(), "log-words")
    hits = words_with_needles(words, views.select(*keys, "needle"), keys)
    # Needles of a word are parts of it, so their number is bounded by the word.
    hits = hits.join(views, [*keys, "needle"]).groupBy(*keys, "word").agg(F.collect_list(F.struct("needle", "failures")).alias("_found"))
    found = (
        spread_join(worded, hits, [*keys, "word"], ["file", "line_no"])
        .groupBy(*ids)
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found")))).alias("_found"))
        .withColumn("needles", F.col("_found.needle"))
        .withColumn("failures", F.aggregate("_found", F.lit(0).cast("long"), lambda a, w: a + w["failures"]))
        .drop("_found")
    )
    return lines.join(found, ids)


def failure_whole_logs(failures, lines):
    """Executors whose whole log a failure points to: ``failures`` that do, ``lines`` the log has."""
    views = failure_log_views(failures).where(F.col("needle") == "").drop("needle")
    counts = lines.groupBy("app_id", "executor_id").agg(F.count(F.lit(1)).alias("lines"))
    return views.join(counts, ["app_id", "executor_id"], "left").fillna(0, ["lines"])


def log_span(lines, keys=("app_id",)):
    """Earliest and latest time in the drivers' logs, whatever their files are called, and lines received."""
    return timed(driver_lines(lines)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.min("ts_ms").alias("log_first_ms"), F.max("ts_ms").alias("log_last_ms")
    )


def log_coverage(batches, lines):
    """Batches without progress, and whether the log starts only after they ended."""
    start = log_span(lines).select("app_id", F.col("log_first_ms").alias("log_start_ms"))
    missing = spread_join(batches.where(~F.col("has_progress")), start, ["app_id"], ["batch_id"], "left")
    return missing.withColumn(
        "before_log", F.coalesce(F.col("to_ms") < F.col("log_start_ms"), F.lit(False))
    )


def window_reason(windows, lines, ids):
    """Why a window shows no line although the log delivered some."""
    seen = lines_in_windows(windows.select("app_id", *ids, "from_ms", "to_ms"), fill_time(driver_lines(lines)), ids)
    shown = seen.select("app_id", *ids)
    empty = windows.where(F.col("from_ms").isNotNull()).join(shown, ["app_id", *ids], "left_anti")
    spans = log_span(lines).where(F.col("received") > 0)
    reason = (
        F.when(F.col("log_first_ms") > F.col("to_ms"), "log starts after the window")
        .when(F.col("log_last_ms") < F.col("from_ms"), "log ends before the window")
        .when(F.col("log_first_ms").isNotNull(), "no line is dated inside the window")
        .otherwise("no line has a readable time")
    )
    return spread_join(empty, spans, ["app_id"], ids).withColumn("reason", reason)


def log_tail(lines, n, keys=FILE):
    """The last ``n`` lines of every log."""
    return tail_by_number(lines, keys, "line_no", n)


def page_text(body):
    """Log text of an HTML page: its last ``<pre>`` block, else the page, without tags.

    Plain text passes through. Entities are resolved last, ``&amp;`` at the end.
    """
    body = F.col(body) if isinstance(body, str) else body
    start = F.length(F.regexp_extract(body, r"(?is)^(.*)<pre", 1))
    end = F.length(F.regexp_extract(body, r"(?is)^(.*)</pre>", 1))
    both = body.rlike(r"(?i)<pre") & body.rlike(r"(?i)</pre>") & (end > start)
    open_end = F.call_function("locate", F.lit(">"), body, start + 1)
    inner = F.when(both, F.substring(body, open_end + 1, F.greatest(end - open_end, F.lit(0)))).otherwise(body)
    text = F.regexp_replace(inner, r"<[^>]*>?", "")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.when(body.rlike(r"(?i)<html|<pre"), text).otherwise(body)


def extract_log_text(df, col, out="text"):
    return df.withColumn(out, page_text(col))
