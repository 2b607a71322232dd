"""Queries that make files of their own: how much of them lies on disk, or in memory, at a time."""

import hashlib
import os
from types import SimpleNamespace

import pyarrow as pa
import pytest

from workload import spark_queries


def stored(folder):
    return sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names)


@pytest.fixture
def long_lines(spark, tmp_path, monkeypatch):
    """Runs lines_long over rows; returns what it found, and the bytes on disk whenever lines were read."""

    def run(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
        seen, folder, read = [], f"{tmp_path}/scratch", spark_queries.read_lines

        def watched(session, path):
            seen.append(stored(folder))
            return read(session, path)

        monkeypatch.setattr(spark_queries, "new_folder", lambda session: folder)
        monkeypatch.setattr(spark_queries, "read_lines", watched)
        monkeypatch.setattr(spark_queries, "LINES_AT_ONCE", 8 << 20, raising=False)
        found = spark_queries.lines_long(spark, str(tmp_path))
        assert found.dtypes == [("size", "int"), ("digest", "string")]
        return sorted(map(tuple, found.collect())), seen, stored(folder)

    return run


def test_long_lines_lie_on_disk_a_share_at_a_time(long_lines):
    rows = [(at, f"some text\r\nof é {at}") for at in range(0, 400, 10)] + [(10, "twice"), (10, "twice"), (3, "short")]
    rows += [(None, "no key"), (20, None), (30, "")]
    expected = []
    for key, text in rows:
        if key is not None and text:
            line = f"{key}: {text}".replace("\n", " ").replace("\r", " ")
            line *= 1_200_000 // len(line) + 1 if key % 10 == 0 else 1
            expected.append((len(line), hashlib.md5(line.encode()).hexdigest()))
    found, seen, left = long_lines(rows)
    assert found == sorted(expected)
    assert max(seen) < sum(size for size, _ in expected) / 2 and left < 1 << 20


def test_long_lines_of_no_documents(long_lines):
    assert long_lines([])[0] == []


@pytest.mark.parametrize("share", [0.35, 0.8, 1])
def test_a_growing_file_is_written_as_its_lines_come(tmp_path, monkeypatch, share):
    parts = [[], ["", "é" * 50_000], [""], ["b" * 100_000, "c"], [], ["d"]]
    on_disk = []

    class Lines:
        def mapInArrow(self, write, schema):
            self.write = write
            return self

        def count(self):
            return len(list(self.write(self.batches())))

        def batches(self):
            for part in parts:
                yield pa.RecordBatch.from_pydict({"value": pa.array(part, pa.string())})
                on_disk.append(stored(tmp_path))

    monkeypatch.setattr(spark_queries, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    for _ in range(2):
        spark_queries._grow(Lines(), str(tmp_path), share)
        data = "\n".join(value for part in parts for value in part).encode()
        assert (tmp_path / "3.log").read_bytes() == data[: int(len(data) * share)]
    assert on_disk[1] > 50_000 and on_disk[3] > 150_000
