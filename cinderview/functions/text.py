"""Column builders for the text, time and number rules of the reports."""

from pyspark.sql import functions as F

# The marker Spark writes before a progress object.
PROGRESS_MARKER = "Streaming query made progress:"
# Byte units, smallest first.
BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def c(col):
    return F.col(col) if isinstance(col, str) else col


def lines_of(text):
    return F.split(c(text), "\r?\n")


def trimmed(text):
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c(text), r"^\s+|\s+$", "")


def detail_line(text):
    """First non-blank line, trimmed; empty text when there is none."""
    return F.coalesce(F.regexp_extract(c(text), r"(?m)^\s*(\S(?:[^\n]*\S)?)[^\S\n]*\r?$", 1), F.lit(""))


def error_token(text):
    """First word of an error up to white space, ``:`` or ``(``; null under 4 bytes."""
    token = F.regexp_extract(detail_line(text), r"^([^\s:(]*)", 1)
    return F.when(F.octet_length(token) >= 4, token)


def severity(line):
    line = c(line)
    error = line.contains(" ERROR ") | line.contains("Exception") | line.contains("Error:") | line.contains("FATAL")
    return F.when(error, "ERROR").when(line.contains(" WARN "), "WARN").otherwise("PLAIN")


def iso_ms(text):
    """ISO time with ``Z``/``GMT``/``UTC`` or an offset to epoch millis; null if unreadable."""
    t = trimmed(text)
    pattern = (
        r"^(\d{1,4}-\d{1,2}-\d{1,2})T(\d{1,2}:\d{1,2}:\d{1,2})(?:\.(\d*))?"
        r"(?:(?:UTC)?(?:GMT)?Z?|([+-])(\d{2}):?(\d{2}))$"
    )
    part = lambda i: F.regexp_extract(t, pattern, i)
    whole = F.unix_seconds(
        F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2)), F.lit("y-M-d H:m:s"))
    )
    millis = F.rpad(F.substring(F.concat(part(3), F.lit("")), 1, 3), 3, "0").cast("long")
    shift = (part(5).try_cast("long") * 60 + part(6).try_cast("long")) * F.lit(60000)
    offset = F.when(part(4) == "-", -shift).when(part(4) == "+", shift).otherwise(F.lit(0))
    return F.when(F.regexp_like(t, F.lit(pattern)), whole * 1000 + millis - offset)


def line_ms(line):
    """Epoch millis at the start of a log line (two text layouts, or JSON ``ts``)."""
    line = c(line)
    # Read once and apart from the rest, whose generated code would be too long for the JVM to compile.
    iso = F.get(F.transform(F.array(F.get_json_object(line, "$.ts")), iso_ms), 0)
    json_ts = F.when(line.startswith("{") & line.contains('"ts"'), iso)
    short = r"^(\d{2})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2})"
    long = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})"
    # Both layouts have fixed places, so a match is cut by them.
    at = lambda place, length: F.substring(line, place, length)
    seconds = F.when(
        line.rlike(short),
        F.try_to_timestamp(
            F.concat(F.lit("20"), at(1, 2), F.lit("-"), at(4, 2), F.lit("-"), at(7, 2), F.lit(" "), at(10, 8)),
            F.lit("yyyy-MM-dd HH:mm:ss"),
        ),
    ).when(
        line.rlike(long),
        F.try_to_timestamp(F.concat(at(1, 10), F.lit(" "), at(12, 8)), F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    return F.when(line.startswith("{"), json_ts).otherwise(F.unix_seconds(seconds) * 1000)


def json_message(line):
    """``msg`` of a JSON-layout line if it is text, else null; cheap tests come first."""
    line = F.ltrim(c(line))
    message = F.try_variant_get(F.try_parse_json(line), "$.msg", "variant")
    text = F.when(F.schema_of_variant(message) == "STRING", F.try_variant_get(message, "$", "string"))
    return F.when(line.startswith("{") & line.contains('"msg"'), text)


def batch_fields(description):
    """``(query_id, run_id, batch_id, name)`` of a micro-batch description, else null."""
    lines = F.transform(lines_of(description), trimmed)

    def last_with(prefix):
        hits = F.filter(lines, lambda x: x.startswith(prefix))
        return F.substr(F.try_element_at(hits, F.lit(-1)), F.lit(len(prefix) + 1))

    first_id = F.array_position(F.transform(lines, lambda x: x.startswith("id = ")), True)
    heads = F.when(first_id > 0, F.slice(lines, 1, F.greatest(first_id - 1, F.lit(0)).cast("int"))).otherwise(lines)
    names = F.filter(heads, lambda x: (x != "") & ~x.contains(" = "))
    batch = last_with("batch = ").try_cast("long")
    query, run = last_with("id = "), last_with("runId = ")
    return F.when(
        query.isNotNull() & run.isNotNull() & batch.isNotNull(),
        F.struct(
            query.alias("query_id"),
            run.alias("run_id"),
            batch.alias("batch_id"),
            F.try_element_at(names, F.lit(-1)).alias("name"),
        ),
    )


def title_of(description):
    return F.coalesce(trimmed(F.element_at(lines_of(description), 1)), F.lit(""))


def display_name(name, description, hint=None):
    """What to call a job, stage or execution (description, then hint, then call site)."""
    name, hint = c(name), F.lit(None).cast("string") if hint is None else c(hint)
    text = F.nullif(trimmed(description), F.lit(""))
    first = trimmed(F.element_at(lines_of(text), 1))
    batches = F.filter(F.transform(lines_of(text), trimmed), lambda x: x.startswith("batch = "))
    suffix = F.coalesce(
        F.concat(F.lit(" · batch "), F.substr(F.try_element_at(batches, F.lit(1)), F.lit(9))), F.lit("")
    )
    return (
        F.when(text.isNotNull() & ~first.startswith("id = "), F.concat(first, suffix))
        .when(text.isNotNull(), F.concat(F.coalesce(hint, name), suffix))
        .when(hint.isNotNull() & name.contains("<unknown>"), hint)
        .otherwise(name)
    )


def fixed(value, digits):
    """A number with fixed decimals, rounded on its exact value (ties to even)."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", c(value).cast("double"), F.lit(pattern))


def bytes_text(value):
    v = c(value).cast("double")
    out = F.when(v <= 0, F.lit("0 B")).when(v < 1024, F.format_string("%d B", c(value).cast("long")))
    for i, unit in enumerate(BYTE_UNITS[1:], 1):
        scaled = F.concat(fixed(v / float(1024**i), 1), F.lit(f" {unit}"))
        out = out.otherwise(scaled) if i == len(BYTE_UNITS) - 1 else out.when(v < 1024.0 ** (i + 1), scaled)
    return out


def whole(a, b):
    """Integer division, truncating."""
    return F.call_function("div", c(a), b if not isinstance(b, int) else F.lit(b))


def duration_text(ms):
    ms = c(ms).cast("long")
    s = F.floor(ms / 1000).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")
    return (
        F.when(ms <= 0, F.lit("-"))
        .when(h > 0, F.format_string("%dh%02dm", h, m))
        .when(m > 0, F.format_string("%dm%02ds", m, s % 60))
        .when(s > 0, F.format_string("%d.%ds", s, F.floor((ms % 1000) / 100).cast("long")))
        .otherwise(F.format_string("%dms", ms))
    )


def number_text(value):
    """A metric number with a T/G/M/k unit; ``value`` is a column name or SQL text."""
    x = f"CAST({value} AS DOUBLE)"

    def scaled(by, digits, unit):
        return f"format_number({x} / {by}, '0.{'0' * digits}') || '{unit}'"

    return F.expr(f"""
        CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('Infinity') THEN '-'
             WHEN abs({x}) >= 1e12 THEN {scaled('1e12', 2, 'T')}
             WHEN abs({x}) >= 1e9 THEN {scaled('1e9', 2, 'G')}
             WHEN abs({x}) >= 1e6 THEN {scaled('1e6', 2, 'M')}
             WHEN abs({x}) >= 1e4 THEN {scaled('1e3', 1, 'k')}
             WHEN {x} = floor({x}) THEN format_number({x}, '0')
             WHEN abs({x}) >= 10 THEN format_number({x}, '0.0')
             ELSE format_number({x}, '0.00') END""")


def ratio_text(value):
    return F.when(c(value) == float("inf"), F.lit("∞")).otherwise(fixed(value, 1))


def clock_text(value):
    """Time of day of a REST time text: eight characters after the ``T``."""
    v = c(value)
    return (
        F.when(v.isNull(), F.lit("-"))
        .when(v.contains("T"), F.substring(F.split_part(v, F.lit("T"), F.lit(2)), 1, 8))
        .otherwise(v)
    )


def share(part, total):
    """``part / total`` held to 0..1; 0 when there is no total."""
    ratio = F.least(F.greatest(c(part) / F.nullif(c(total).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(c(total) > 0, ratio).otherwise(F.lit(0.0))


def percent(part, total):
    return F.when(c(total) > 0, F.lit(100.0) * c(part) / F.nullif(c(total).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
