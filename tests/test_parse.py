import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.functions.levels import normalize_level
from logspark.operators.parse import parse_lines
from logspark.operators.patterns import DEFAULTS, Pattern, supported_formats

INGEST = dt.datetime(2025, 11, 3, 9, 8, 7, 654321)


def parse(spark, lines, **options):
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, value string").repartition(2)
    rows = parse_lines(frame, ingest_ts=F.lit(str(INGEST)), **options).orderBy("n")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()


T = dt.datetime

# line -> (level, ts or None for ingest time, service, message, other columns, fields)
GOLDENS = [
    # time, level and service in brackets; pairs behind them
    (
        "2031-03-04T05:06:07.089Z [FATAL] [tide-gauge] request_id=rq-77 user=mole pump=off height=12cm",
        ("FATAL", T(2031, 3, 4, 5, 6, 7, 89000), "tide-gauge", "request_id=rq-77 user=mole pump=off height=12cm",
         {"request_id": "rq-77", "user_id": "mole"},
         {"service": "tide-gauge", "request_id": "rq-77", "user": "mole", "pump": "off", "height": "12cm"}),
    ),
    ("2031-03-04T03:06:07Z [warning] [oven] too hot",
     ("WARN", T(2031, 3, 4, 3, 6, 7), "oven", "too hot", {}, {"service": "oven"})),
    # time and level in brackets
    ("[2031-03-04 23:59:59] [debug] valve half open",
     ("DEBUG", T(2031, 3, 4, 23, 59, 59), None, "valve half open", {}, {})),
    ("[2031-03-04 05:06:07] [TRACE] [inner] kept as text",
     ("TRACE", T(2031, 3, 4, 5, 6, 7), None, "[inner] kept as text", {}, {})),
    # level first
    ("PANIC 2031-03-04 05:06:07 ferry: all hands",
     ("PANIC", T(2031, 3, 4, 5, 6, 7), "ferry", "all hands", {}, {"service": "ferry"})),
    # a JSON head before plain text
    ('{"timestamp":"2031-03-04T05:06:07Z","level":"INF","service":"loom"} thread changed',
     ("INFO", T(2031, 3, 4, 5, 6, 7), "loom", "thread changed", {}, {"service": "loom"})),
    # a level in brackets anywhere: only the level is taken
    ("at dawn [ERROR] the cock did not crow",
     ("ERROR", None, None, "at dawn [ERROR] the cock did not crow", {}, {})),
    # a whole JSON object
    ('{"timestamp":"2031-03-04T05:06:07Z","level":"crit","message":"mast down","trace_id":"tr9","crew":"6","user_id":"u5"}',
     ("FATAL", T(2031, 3, 4, 5, 6, 7), None, "mast down",
      {"trace_id": "tr9", "user_id": "u5"}, {"crew": "6"})),
    # system logs: no level of their own, the year from the time of ingest
    ("Mar  9 01:02:03 attic clockd[5]: wound up",
     ("UNKNOWN", T(2025, 3, 9, 1, 2, 3), "clockd[5]", "wound up", {}, {"service": "clockd[5]"})),
    ("Dec 30 01:02:03 attic clockd: last year's",
     ("UNKNOWN", T(2024, 12, 30, 1, 2, 3), "clockd", "last year's", {}, {"service": "clockd"})),
    # shapes that none of the formats take
    ("quay-4 > 2031/03/04 INFO ropes fast",
     ("UNKNOWN", None, None, "quay-4 > 2031/03/04 INFO ropes fast", {}, {})),
    ("<13>1 2031-03-04T05:06:07Z shed - - gate shut",
     ("UNKNOWN", None, None, "<13>1 2031-03-04T05:06:07Z shed - - gate shut", {}, {})),
    # pairs alone, whatever their names say
    ('WHEN=2031-03-04 LEVEL=ERROR PLACE=cellar NOTE="two of nine"',
     ("UNKNOWN", None, None, 'WHEN=2031-03-04 LEVEL=ERROR PLACE=cellar NOTE="two of nine"', {},
      {"WHEN": "2031-03-04", "LEVEL": "ERROR", "PLACE": "cellar", "NOTE": "two of nine"})),
    # a clock time on the day of ingest, and a JSON object as the message
    ('[06:05:04.003] ERROR (bakery): {"trace_id":"tr3","context":"dough","message":"did not rise"}',
     ("ERROR", T(2025, 11, 3, 6, 5, 4, 3000), "bakery", "did not rise",
      {"trace_id": "tr3", "component": "dough"}, {"service": "bakery"})),
    ("[hold] [deck] Awake", ("UNKNOWN", None, None, "Awake", {}, {})),
    ('{"msg":"hi"}', ("UNKNOWN", None, None, "hi", {}, {})),
    ('{"level":"info","operation":"create","entity":"order"}',
     ("INFO", None, None, "create order", {}, {"operation": "create", "entity": "order"})),
    ('{"level":"info"}', ("INFO", None, None, "JSON log entry", {}, {})),
    ("2025-10-21T00:58:21 [INFO] [s] x", ("INFO", None, "s", "x", {}, {"service": "s"})),
    # fractions with a comma, tabs, and impossible dates
    ("[2025-10-21 00:58:21,125] [INFO] x", ("INFO", T(2025, 10, 21, 0, 58, 21, 125000), None, "x", {}, {})),
    ("[2025-02-30 00:58:21] [INFO] x", ("INFO", None, None, "x", {}, {})),
    ("[20:42:47.1731] INFO (a): b", ("INFO", None, "a", "b", {}, {"service": "a"})),
    ("Feb 29 10:06:05 h cron: tick", ("UNKNOWN", T(2024, 2, 29, 10, 6, 5), "cron", "tick", {}, {"service": "cron"})),
    ("Xyz 12 10:06:05 h cron: tick", ("UNKNOWN", None, "cron", "tick", {}, {"service": "cron"})),
    ("Oct 12 10:06:05 h cron: [err] tick", ("ERROR", T(2025, 10, 12, 10, 6, 5), "cron", "tick", {}, {"service": "cron"})),
    # a match without level or time keeps its message; a later one adds the level
    ("[a] [b] [INFO] text", ("INFO", None, None, "[INFO] text", {}, {})),
    # colours are removed first
    ("\x1b[31mdown\x1b[0m trace=abc", ("UNKNOWN", None, None, "down trace=abc", {"trace_id": "abc"}, {"trace": "abc"})),
    # the last pair wins, the first service wins
    ("user=a USER=b trace=1 trace=2 svc= service=x svc=y a=1 a=2",
     ("UNKNOWN", None, "x", "user=a USER=b trace=1 trace=2 svc= service=x svc=y a=1 a=2",
      {"user_id": "b", "trace_id": "2"},
      {"user": "a", "USER": "b", "trace": "2", "service": "x", "svc": "y", "a": "2"})),
    ('m="a \\"b\\" c" n="open', ("UNKNOWN", None, None, 'm="a \\"b\\" c" n="open', {},
     {"m": 'a \\"b\\" c', "n": "open"})),
    # strict JSON: trailing text, two objects, a broken end
    ('{"level":"info"} ]', ("UNKNOWN", None, None, '{"level":"info"} ]', {}, {})),
    ('{"level":"info"}}', ("UNKNOWN", None, None, '{"level":"info"}}', {}, {})),
    ('{"level":"info"},{"a":1}', ("UNKNOWN", None, None, '{"level":"info"},{"a":1}', {}, {})),
    # nested values and nulls are skipped, texts that look nested are not
    ('{"a":{"b":1},"c":[1],"d":null,"e":"{x}","f":true,"g":5}',
     ("INFO", None, None, "JSON log entry", {}, {"e": "{x}", "f": "true", "g": "5"})),
    # repeated members: the last one counts
    ('{"a":"1","a":"2","level":"warn","Level":"err","MSG":"m"}',
     ("ERROR", None, None, "m", {}, {"a": "2"})),
    ('{"request_id":"r1"}', ("UNKNOWN", None, None, '{"request_id":"r1"}', {"request_id": "r1"}, {})),
    ('{"time":"2025-10-21 00:58:21","svc":"s","TID":"7"}',
     ("INFO", T(2025, 10, 21, 0, 58, 21), "s", "JSON log entry", {"thread": "7"}, {})),
    ('{"time":"2025-10-21T02:58:21.5+02:00"}', ("INFO", T(2025, 10, 21, 0, 58, 21, 500000), None, "JSON log entry", {}, {})),
    ('{"time":"1761008301","x":"1"}', ("INFO", None, None, "JSON log entry", {}, {"x": "1"})),
    ("{}", ("UNKNOWN", None, None, "{}", {}, {})),
    ('[20:42:47.173] INFO (a): {"operation":"put","entity":"row","service":"zz"}',
     ("INFO", T(2025, 11, 3, 20, 42, 47, 173000), "a", "put row", {},
      {"service": "a", "operation": "put", "entity": "row"})),
    ("", ("UNKNOWN", None, None, "", {}, {})),
    # control characters inside the groups
    ("[2025-10-21 00:58:21] [INFO] a\x01b", ("INFO", T(2025, 10, 21, 0, 58, 21), None, "a\x01b", {}, {})),
    ("plain \x01 text", ("UNKNOWN", None, None, "plain \x01 text", {}, {})),
]


@pytest.fixture(scope="module")
def golden_rows(spark):
    return parse(spark, [line for line, _ in GOLDENS])


@pytest.mark.parametrize("at", range(len(GOLDENS)), ids=[line[:40] for line, _ in GOLDENS])
def test_golden(golden_rows, at):
    row = golden_rows[at]
    level, ts, service, message, others, fields = GOLDENS[at][1]
    assert row["level"] == level
    assert row["ts"] == (ts or INGEST)
    assert row["timed"] == (ts is not None)
    assert row["service"] == service
    assert row["message"] == message
    assert row["fields"] == fields
    for name in ("component", "trace_id", "request_id", "user_id", "thread"):
        assert row[name] == others.get(name), name


def test_levels(spark):
    # each name in full and short, in mixed case, with white space, and words that are none
    pairs = {
        "Trace": "TRACE", "tRC": "TRACE", "Debg": "DEBUG", " DBG": "DEBUG", "Information": "INFO",
        "inf\t": "INFO", "wRN": "WARN", "Warning": "WARN", "Erro": "ERROR", "eRR": "ERROR",
        "ftl": "FATAL", "Critical": "FATAL", " crit\t": "FATAL", "pnc": "PANIC", "Panic ": "PANIC",
        "notice": "UNKNOWN", "errors": "UNKNOWN", "": "UNKNOWN",
    }
    frame = spark.createDataFrame(list(pairs), "string").select(
        "value", F.expr(normalize_level("value")).alias("level")
    )
    assert {row["value"]: row["level"] for row in frame.collect()} == pairs


def test_custom_pattern_is_tried_last(spark):
    custom = Pattern(
        name="Pipes",
        regex=r"([^|]+)\|(\w+)\|(\w+)\|(.*)",
        time_layout="dd/MM/yyyy HH:mm",
        time_group=1,
        level_group=2,
        message_group=4,
        fields={"thread": 3, "zone": 2},
    )
    patterns = (*DEFAULTS, custom)
    row = parse(spark, ["21/10/2025 00:58|err|w1| broken "], patterns=patterns)[0]
    assert (row["level"], row["thread"], row["message"]) == ("ERROR", "w1", "broken")
    assert row["ts"] == dt.datetime(2025, 10, 21, 0, 58)
    assert row["fields"] == {"thread": "w1", "zone": "err"}
    assert [r["name"] for r in supported_formats(spark, patterns).collect()][-1] == "Pipes"


def test_long_words_and_quotes_stay_linear(spark):
    word = "x" * 300_000
    quoted = 'k="' + 'a\\"' * 100_000 + '" z=1'
    rows = parse(spark, [word, quoted, "[" + word, "{" * 50_000])
    assert rows[0]["message"] == word
    assert rows[1]["fields"]["z"] == "1"
    assert len(rows[1]["fields"]["k"]) == 300_000 - 1


def test_plan_has_no_python_and_no_shuffle(spark):
    frame = spark.createDataFrame([("a",)], "value string")
    plan = parse_lines(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_filters_do_not_repeat_the_parser(spark):
    frame = spark.createDataFrame([("a",)], "value string")
    parsed = parse_lines(frame)
    plain = parsed._jdf.queryExecution().executedPlan().toString()
    chosen = parsed.where("level = 'ERROR' AND trace_id IS NOT NULL AND timed AND fields['a'] = '1'")
    filtered = chosen._jdf.queryExecution().executedPlan().toString()
    for name in ("from_json", "regexp_extract_all", "RLIKE"):
        assert filtered.count(name) == plain.count(name)


def test_pruned_columns_cost_nothing(spark):
    frame = spark.createDataFrame([("a",)], "value string")
    plan = parse_lines(frame).select("level", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "map_from_arrays" not in plan


def test_other_zones_are_refused(spark):
    frame = spark.createDataFrame([("a",)], "value string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            parse_lines(frame)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
