import random

import numpy as np
import pyarrow as pa

from logspark.llm.common import Memory, place, small_batches, text_blocks
from logspark.llm.components import components
from logspark.llm.hashing import Spans, Words, lower_ascii, shingle_sets, window_hashes
from tests.llm.samples import least_reachable, lower, odd_texts, prose, shingles, words


def block_of(texts):
    (first, raw, offsets), *rest = text_blocks(pa.array(texts, pa.string()))
    assert first == 0 and not rest
    return raw, offsets


def test_words_are_those_of_the_pattern():
    texts = [text or "" for text in odd_texts() if len(text or "") < 10_000] + ["ends", "begins", " x "]
    raw, offsets = block_of(texts)
    found = Words(raw, offsets)
    data = bytes(raw)
    got = [data[a:b].decode() for a, b in zip(found.starts, found.ends)]
    assert got == [word for text in texts for word in words(text)]
    assert found.counts.tolist() == [len(words(text)) for text in texts]
    assert bytes(lower_ascii(raw)).decode() == "".join(lower(text) for text in texts)


def test_equal_spans_have_equal_hashes_only():
    rng = random.Random(1)
    texts = [prose(rng, 400), "aaaa" * 50, "ab" * 100]
    raw, offsets = block_of(texts)
    spans = Spans(raw)
    data, seen = bytes(raw), {}
    starts = np.array([rng.randrange(len(raw) - 40) for _ in range(20_000)])
    ends = starts + np.array([rng.randrange(1, 40) for _ in range(20_000)])
    for a, b, value in zip(starts, ends, spans.hashes(starts, ends).tolist()):
        assert seen.setdefault(value, data[a:b]) == data[a:b]
    again = {}
    for value, text in seen.items():
        assert again.setdefault(text, value) == value


def test_shingle_sets_have_the_sizes_of_the_sets():
    texts = [text or "" for text in odd_texts()][:11]
    values, first = shingle_sets(*block_of(texts), 5)
    assert np.diff(first).tolist() == [len(shingles(text)) for text in texts]
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(first, first[1:])]
    for one, left in zip(sets, texts):
        for two, right in zip(sets, texts):
            assert len(one & two) == len(shingles(left) & shingles(right))


def test_windows_tell_order_and_length_apart():
    values = np.arange(1, 9, dtype=np.uint64)
    assert len(set(window_hashes(values, 3).tolist()) | set(window_hashes(values[::-1].copy(), 3).tolist())) == 12
    assert len(window_hashes(values[:2], 3)) == 0


def test_blocks_cover_sliced_arrays():
    texts = ["a" * 1_500_000, "", "b" * 1_500_000, "c", "d" * 5_000_000, ""]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    seen = []
    for first, raw, offsets in text_blocks(column):
        assert first == len(seen)
        seen += [bytes(raw[a:b]).decode() for a, b in zip(offsets, offsets[1:])]
    assert seen == texts
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    assert sum(part.num_rows for part in small_batches(batch)) == len(texts)
    assert list(text_blocks(pa.array([], pa.string()))) == []


def test_memory_forgets_in_generations():
    calls = []
    memory = Memory(lambda key: calls.append(key) or key.upper(), 3, 4)
    for key in ("a", "b", "a", "toolong", "toolong", "c"):
        assert memory[key] == key.upper()
        memory.age()
    assert calls == ["a", "b", "toolong", "toolong", "c"] and len(memory) == 0
    assert memory["a"] == "A" and calls[-1] == "c"


def test_places():
    assert place(np.array([-5, 0, 3, 9]), [0, 5]).tolist() == [0, 1, 1, 2]
    assert place(np.array([1]), []).tolist() == [0]


def test_components(spark):
    rng = random.Random(3)
    chain = [(at, at + 1) for at in range(60)]
    star = [(100, at) for at in range(101, 160)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    links = chain + star + loose
    rng.shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {node for link in links if link[0] != link[1] for node in link}
    expected = least_reachable(nodes, [link for link in links if link[0] != link[1]])
    assert {row["node"]: row["component"] for row in found} == expected and len(found) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
