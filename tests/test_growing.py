import io
import os
import random
import threading

import pytest
from logspark.sources import growing
from logspark.streaming.ingest import container_rows


def taken(data, cuts, most=1 << 30, last=True):
    """The lines read of a file whose bytes arrive in parts, each part in pieces."""
    found, known = [], {}
    for cut in [*cuts, len(data)]:
        closed = last and cut == len(data)
        end = {"f": {"bytes": cut, "head": data[: min(cut, 64)].hex(), "modified": 1, "closed": closed}}
        for piece in growing.pieces_between(known, end, most):
            for lines in growing.lines_of(io.BytesIO(data[:cut]), piece):
                found += lines
        known = end
    return found


@pytest.mark.parametrize("most", [1, 3, 50, 1 << 30])
def test_each_line_once_wherever_bytes_are_cut(monkeypatch, most):
    monkeypatch.setattr(growing, "_READ_BYTES", 7)
    monkeypatch.setattr(growing, "_LOOK_BYTES", 5)
    rng = random.Random(most)
    for _ in range(60):
        lines = ["".join(rng.choice("abé\r") for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(rng.randint(1, 12))]
        data = "\n".join(lines).encode() + b"\n" * rng.randint(0, 1)
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randint(0, 5)))
        expected = data.decode().split("\n")
        assert taken(data, cuts, most) == (expected if expected[-1] else expected[:-1])
        assert taken(data, cuts, most, last=False) == expected[:-1]


def entry(data, closed=False):
    return {"bytes": len(data), "head": data[:64].hex(), "modified": 1, "closed": closed}


def spans(start, end):
    return sorted((piece.path, piece.start, piece.stop, piece.last) for piece in growing.pieces_between(start, end))


def test_replaced_renamed_and_closed_files():
    old, new = b"first of many bytes" * 9, b"another beginning" * 9
    before = {"d/log": entry(old), "d/other": entry(b"short")}
    assert spans(before, before) == []
    assert spans(before, before | {"d/log": entry(old + b"more")}) == [("d/log", len(old), len(old) + 4, False)]
    # Shorter, or with another beginning: from the start.
    assert spans(before, before | {"d/log": entry(old[:20])}) == [("d/log", 0, 20, False)]
    assert spans(before, before | {"d/log": entry(new * 3)}) == [("d/log", 0, 3 * len(new), False)]
    # Rotated: the old file goes on under its new name, unless it lies elsewhere.
    rotated = {"d/log": entry(new), "d/log.1": entry(old + b"tail"), "d/other": entry(b"short")}
    assert spans(before, rotated) == [("d/log", 0, len(new), False), ("d/log.1", len(old), len(old) + 4, False)]
    elsewhere = {"e/log.1": entry(old)}
    assert spans(before, elsewhere) == [("e/log.1", 0, len(old), False)]
    # A copy of a file that is still there is a file of its own.
    assert spans(before, before | {"d/copy": entry(old)}) == [("d/copy", 0, len(old), False)]
    # A file that stays as it is for long gives up its half line once.
    closed = {"d/log": entry(old, True), "d/other": entry(b"short", True)}
    assert spans(before, closed) == [("d/log", len(old), len(old), True), ("d/other", 5, 5, True)]
    assert spans(closed, closed) == []
    assert spans({}, {"d/empty": entry(b"", True)}) == [("d/empty", 0, 0, True)]


def test_bytes_of_a_batch_are_bounded(tmp_path):
    (tmp_path / "a").write_bytes(b"0123456789\n" * 10)
    (tmp_path / "b").write_bytes(b"x\n")
    reader = growing.GrowingReader({"path": str(tmp_path), "maxBytesPerTrigger": "40", "settleSeconds": "0"})
    known, lines, batches = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != known:
        pieces = reader.partitions(known, end)
        assert sum(piece.stop - piece.start for piece in pieces) <= 40
        for piece in pieces:
            lines += [line for batch in reader.read(piece) for line in batch.column("value").to_pylist()]
        known, batches = end, batches + 1
    assert sorted(lines) == ["0123456789"] * 10 + ["x"] and batches == 3


def run(rows, path, checkpoint):
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def test_a_stream_follows_its_files_over_restarts(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    os.makedirs(f"{source}/deep")

    def add(name, text):
        with open(f"{source}/{name}", "a") as file:
            file.write(text)

    def landed():
        run(growing.follow_lines(spark, source, "*.log", settle_seconds=3600), sink, checkpoint)
        return sorted(row["value"] for row in spark.read.parquet(sink).collect())

    add("a.log", "one\ntwo\nthr")
    add("deep/b.log", "\r\nfour\r\n\n")
    add("c.txt", "not followed\n")
    assert landed() == ["four", "one", "two"]
    assert landed() == ["four", "one", "two"]
    add("a.log", "ee\n")
    add("deep/b.log", "five")
    assert landed() == ["four", "one", "three", "two"]
    # Rotated between two runs, with lines written before and after.
    add("deep/b.log", "\nsix\n" + "seven" * 20 + "\n")
    assert landed()[0] == "five"
    add("deep/b.log", "eight\n")
    os.rename(f"{source}/deep/b.log", f"{source}/deep/b.1.log")
    add("deep/b.log", "nine\n")
    assert landed() == sorted("one two three four five six eight nine".split() + ["seven" * 20])


def test_container_files_that_grow(spark, tmp_path):
    folder = tmp_path / "in" / "web"
    folder.mkdir(parents=True)
    containers = spark.createDataFrame(
        [("web", True, "", "front")], "container string, enabled boolean, project string, component string"
    )
    for text in ("[2025-01-01 00:00:00] [ERROR] x\n  \n[2025-01-01", " 00:00:01] [ERROR] y\n"):
        with open(folder / "stderr.log", "a") as file:
            file.write(text)
        rows = container_rows(growing.follow_container_lines(spark, str(tmp_path / "in")), containers)
        run(rows.select("message", "source"), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(row["message"] for row in found) == ["x", "y"] and {row["source"] for row in found} == {"web[stderr]"}


def test_lines_written_while_the_stream_runs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def write():
        for at in range(300):
            with open(source / f"{at % 3}.log", "a") as file:
                file.write(f"{at} begins, ")
                file.flush()
                file.write(f"{at} ends\n")

    writer = threading.Thread(target=write)
    query = (
        growing.follow_lines(spark, str(source))
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(processingTime="200 milliseconds").start()
    )
    writer.start()
    writer.join()
    query.processAllAvailable()
    query.stop()
    found = [row["value"] for row in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == sorted(f"{at} begins, {at} ends" for at in range(300))
