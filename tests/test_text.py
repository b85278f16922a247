"""Text, time and number rules on literal values."""

import datetime as dt

from pyspark.sql import functions as F

from cinderview.functions import text as t


def lit(v):
    return F.lit(v)


def epoch(*when):
    return int(dt.datetime(*when, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_iso_times(values):
    base = epoch(2031, 3, 4, 5, 6, 7)
    texts = {
        "1969-12-31T23:59:59.000Z": -1000,
        "2031-03-04T05:06:07Z": base,
        "2031-03-04T05:06:07.25GMT": base + 250,
        "2031-03-04T05:06:07.0UTC": base,
        "\t2031-03-04T05:06:07.000-0000\n": base,
        "2031-03-04T10:36:07.000+05:30": base,
        "2031-03-03T21:06:07-0800": base,
        "2031-03-04T05:06:07.98765Z": base + 987,
        "2031-03-04T05:06Z": None,
        "04.03.2031 05:06:07": None,
        " ": None,
        "2031-02-30T05:06:07Z": None,
    }
    assert values(*[t.iso_ms(lit(x)) for x in texts]) == list(texts.values())


def test_line_times(values):
    at = epoch(2031, 3, 4, 5, 6, 7)
    lines = {
        "31/03/04 05:06:07 DEBUG y": at,
        "2031-03-04 05:06:07.5 y": at,
        "2031-03-04T05:06:07Z y": at,
        '{"msg":"y","ts":"2031-03-04T05:06:07.125Z"}': at + 125,
        "y 31/03/04 05:06:07": None,
        "\t2031-03-04 05:06:07": None,
        '{"time":"2031-03-04T05:06:07Z"}': None,
        "31/03/32 05:06:07 y": None,
    }
    assert values(*[t.line_ms(lit(x)) for x in lines]) == list(lines.values())


def test_batch_descriptions(values):
    got = values(
        *[
            t.batch_fields(lit(x))
            for x in (
                "stock-level\nid = q1\nrunId = r1\nbatch = 42",
                "id = q\nrunId = r\nbatch = 7",
                "  first\n second \n id = q\n runId = r\n batch = 7 ",
                "reduce at Prices.scala:212",
                "x\nid = q\nrunId = r\nbatch = many",
                "x\nid = q\nbatch = 3",
            )
        ]
    )
    assert [None if g is None else tuple(g) for g in got] == [
        ("q1", "r1", 42, "stock-level"),
        ("q", "r", 7, None),
        ("q", "r", 7, "second"),
        None,
        None,
        None,
    ]


def test_display_names(values):
    # An unknown call site gives way to the hint; a known one, and any description, does not.
    unknown, known, hint = "save at <unknown>:0", "foreachPartition at Ledger.py:88", "query 41: merge ledger"
    batch = "id = 5f\nrunId = 6e\nbatch = 30"
    cases = [
        ((unknown, None, None), unknown),
        ((unknown, None, hint), hint),
        ((unknown, batch, hint), hint + " · batch 30"),
        ((unknown, batch, None), unknown + " · batch 30"),
        ((unknown, "price-feed\n" + batch, None), "price-feed · batch 30"),
        ((unknown, "price-feed\n" + batch, hint), "price-feed · batch 30"),
        ((known, None, hint), known),
        ((known, " \t ", hint), known),
        ((known, "  weekly close \nsecond line", None), "weekly close"),
    ]
    string = lambda v: F.lit(v).cast("string")
    assert values(*[t.display_name(string(a), string(b), string(c)) for (a, b, c), _ in cases]) == [w for _, w in cases]


def test_severity_and_error_tokens(values):
    assert values(
        t.severity(lit("31/03/04 05:06:07 ERROR Writer: disk")),
        t.severity(lit("31/03/04 05:06:07 WARN Writer: slow")),
        t.severity(lit("31/03/04 05:06:07 INFO Writer: done")),
        t.severity(lit("java.lang.RuntimeException")),
        t.severity(lit("error: lower case")),
    ) == ["ERROR", "WARN", "PLAIN", "ERROR", "PLAIN"]
    assert values(
        t.error_token(lit("com.shop.PriceException: below zero\n\tat x")),
        t.error_token(lit("StockFailure (shelf 9 empty)")),
        t.error_token(lit("at x")),
        t.error_token(lit("\n \n  Boom(x)")),
        t.error_token(lit("")),
    ) == ["com.shop.PriceException", "StockFailure", None, "Boom", None]


def test_detail_line(values):
    assert values(
        t.detail_line(lit("\n  \n  first real  \nsecond")), t.detail_line(lit("")), t.detail_line(lit(None).cast("string")),
        t.detail_line(lit("x\r\ny")),
    ) == ["first real", "", "", "x"]


def test_number_texts(values):
    assert values(*[t.bytes_text(lit(v)) for v in (0, -5, 512, 1024, 1536, 5 << 20, 3 << 30, 1 << 60)]) == [
        "0 B", "0 B", "512 B", "1.0 KiB", "1.5 KiB", "5.0 MiB", "3.0 GiB", "1024.0 PiB"
    ]
    assert values(*[t.duration_text(lit(v)) for v in (0, 5, 1234, 61_000, 3_600_000, 3_725_000, 119_999)]) == [
        "-", "5ms", "1.2s", "1m01s", "1h00m", "1h02m", "1m59s"
    ]
    assert values(*[t.number_text(f"{float(v)!r}D") for v in (0, 42.5, 2.345, 12_345, 4e9, 2.5e6, 3e12)]) == [
        "0", "42.5", "2.35", "12.3k", "4.00G", "2.50M", "3.00T"
    ]
    # Ties are decided on the exact value, as printf does.
    assert values(t.fixed(lit(0.25), 1), t.fixed(lit(0.35), 1), t.fixed(lit(2.5), 0)) == ["0.2", "0.3", "2"]
    assert values(t.clock_text(lit("2031-03-04T05:06:07.331GMT")), t.clock_text(lit("odd"))) == ["05:06:07", "odd"]
