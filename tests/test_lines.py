from logspark.sources.lines import clean_lines

from tests.plans import physical

# bytes of a line -> what is left of it, None: dropped
ENDS = {
    b"a\r": "a",
    b"a\r\r": "a\r",
    b"a\rb": "a\rb",
    b"a": "a",
    "é\r".encode(): "é",
    b"\r\r": "\r",
    b"\r": None,
    b"": None,
    # bytes that are no text
    b"a\xff": "a\ufffd",
    b"a\xc3\r": "a\ufffd",
    b"\xe2\x82": "\ufffd",
}


def test_one_closing_return_goes_and_empty_lines_do(spark):
    rows = spark.createDataFrame([(key,) for key in [*ENDS, None]], "key binary")
    lines = clean_lines(rows.selectExpr("key", "cast(key AS string) AS value"))
    assert lines.columns == ["key", "value"]
    found = {bytes(row["key"]): row["value"] for row in lines.collect()}
    assert found == {key: left for key, left in ENDS.items() if left is not None}


def test_a_line_goes_through_the_pattern_once_at_most(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n")
    lines = clean_lines(spark.read.option("lineSep", "\n").text(str(tmp_path)))
    assert sorted(row["value"] for row in lines.collect()) == ["one", "two"]
    found = [line for line in physical(lines).split("\n") if "FileScan" not in line]
    assert sum(line.count("regexp_replace") for line in found) == 1
    assert any("EndsWith" in line and "regexp_replace" in line for line in found)
