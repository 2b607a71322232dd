import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logspark.llm import packing, rans
from logspark.llm.tokens import encoder
from tests.llm.samples import no_documents, odd_documents, odd_texts, plain_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_equals_the_library(tokenizer):
    with open(PATH, "rb") as file:
        encode = encoder(file.read()).encode
    texts = [text or "" for text in odd_texts()] + [
        "don't I'LL 's 't'S x' 'x", "<|endoftext|>x <|startoftext|>", "ΑΣ ΑΣ. ΑΣΑ Σ", "á ́b é.",
        "x y z\n\n\r\n q\x85", "a\x1c b\x0b\x0cc", "Ǆ İstanbul ﬁ ÀÉ×÷ß", "a_b __ c's.. (d) [e]", "42 3.14 x2",
    ]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_ways_to_part_words_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        with pytest.raises(ValueError):
            encoder(file.read())


def test_rans_round_trip_and_checkpoints():
    rng = np.random.default_rng(7)
    for size, lanes in ((1, 512), (5, 4), (10_000, 64), (70_000, 512)):
        ids = (rng.zipf(1.3, size) % 40_000).astype(np.uint32)
        cuts = np.sort(rng.integers(0, size + 1, 5))
        parts = [part for part in np.split(ids, cuts) if len(part)]
        run = rans.encode_run(list(range(len(parts))), parts, lanes, 20_000, 4_096)
        table = rans.Table(np.frombuffer(run["ids"], "<u4"), np.frombuffer(run["frequencies"], "<u4"), run["bits"])
        assert int(table.frequencies.sum()) == 1 << run["bits"]
        back = [rans.decode_block(table, block) for block in run["blocks"]]
        assert np.array_equal(np.concatenate(back), ids)
        assert sum(sum(block["doc_tokens"]) for block in run["blocks"]) == size
        # a part decodes from its own checkpoint alone
        block = max(run["blocks"], key=lambda b: len(b["marks"]))
        whole = rans.decode_block(table, block)
        for mark in block["marks"]:
            rows = 1 if mark["row"] * block["lanes"] + block["lanes"] <= len(whole) else 0
            states = np.frombuffer(mark["states"], "<u8").astype(np.uint64)
            got = table.decode(np.frombuffer(block["words"], "<u4"), mark["word"], states, rows)
            at = mark["row"] * block["lanes"]
            assert np.array_equal(got, whole[at : at + len(got)])


def test_rans_needs_about_the_entropy():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.5, 100_000) % 1000).astype(np.uint32)
    run = rans.encode_run([0], [ids], 512, 1 << 17, 1 << 16)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = -(share * np.log2(share)).sum() * len(ids)
    states = 64 * 512 * 2
    assert sum(len(block["words"]) * 8 for block in run["blocks"]) < bits * 1.01 + states


def test_rans_notices_changed_bytes():
    run = rans.encode_run([0], [np.arange(5_000, dtype=np.uint32) % 97], 64, 4_000, 1_024)
    table = rans.Table(np.frombuffer(run["ids"], "<u4"), np.frombuffer(run["frequencies"], "<u4"), run["bits"])
    block = run["blocks"][0]
    block["words"] = block["words"][:-1] + bytes([block["words"][-1] ^ 1])
    with pytest.raises(ValueError):
        rans.decode_block(table, block)


def test_scaled_frequencies():
    counts = np.array([0, 1, 1_000_000, 3, 0, 1])
    found = rans.scaled(counts, 10)
    assert found.sum() == 1024 and ((found > 0) == (counts > 0)).all()
    assert rans.scaled(np.ones(1024, np.int64), 10).tolist() == [1] * 1024
    assert rans.scaled(np.zeros(3, np.int64), 10).sum() == 0
    with pytest.raises(ValueError):
        rans.scaled(np.ones(1025, np.int64), 10)


def test_rans_files_of_odd_documents(spark, tokenizer, tmp_path):
    docs = odd_documents(spark)
    rans.encode_documents(docs, PATH, str(tmp_path / "ids"))
    found = rans.read_ids(spark, str(tmp_path / "ids")).collect()
    rows = plain_rows(docs)
    assert len(found) == len(rows)
    known = {doc_id: ids_of(tokenizer, text).tobytes() for doc_id, text in rows}
    start = 0
    for row in sorted(found, key=lambda row: row["start"]):
        assert row["start"] == start and bytes(row["ids"]) == known[row["doc_id"]]
        start += row["n_tokens"]
    order = [row["doc_id"] for row in sorted(found, key=lambda row: row["start"])]
    assert order == sorted(order, key=lambda doc_id: -1 if doc_id is None else doc_id)


def test_rans_files_of_nothing(spark, tmp_path):
    rans.encode_documents(no_documents(spark), PATH, str(tmp_path / "ids"))
    assert rans.read_ids(spark, str(tmp_path / "ids")).count() == 0


def test_op2(spark, sf_dir, tokenizer):
    docs = dict(plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = {row["doc_id"]: row for row in rans.op2_rans(spark, sf_dir).collect()}
    assert set(found) == set(docs)
    start = 0
    for doc_id in sorted(docs):
        ids = ids_of(tokenizer, docs[doc_id])
        row = found[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# --- packing ------------------------------------------------------------


def check_pieces(pieces, texts, tokenizer, window):
    """Each id lies in one piece; sequences are gapless, and full or of a power of two."""
    by_doc, by_sequence = {}, {}
    for row in pieces:
        by_doc.setdefault(row["doc_id"], []).append(row)
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    assert set(by_doc) == set(texts)
    for doc_id, rows in by_doc.items():
        ids, at = ids_of(tokenizer, texts[doc_id]), 0
        for row in sorted(rows, key=lambda row: row["start"]):
            assert row["start"] == at and row["doc_tokens"] == len(ids)
            assert bytes(row["ids"]) == ids[at : at + row["length"]].tobytes()
            at += row["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for row in sorted(rows, key=lambda row: row["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at == window or at < window and at & (at - 1) == 0
    return by_sequence


def test_packs_of_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(plain_rows(docs))
    for window in (2048, 256):
        check_pieces(packing.pack(docs, PATH, window).collect(), texts, tokenizer, window)


def test_packs_of_odd_documents(spark, tokenizer):
    rows = [row for row in enumerate(odd_texts())] + [(None, "no id")]
    docs = odd_documents(spark, [text for _, text in rows]).unionByName(
        odd_documents(spark, ["no id"]).selectExpr("cast(null as long) AS doc_id", "* EXCEPT (doc_id)")
    )
    texts = {**dict(rows[:-1]), **{None: "no id"}}
    texts[len(rows) - 1] = "no id"
    check_pieces(packing.pack(docs, PATH).collect(), texts, tokenizer, 2048)
    repeated = odd_documents(spark).where("doc_id = 6")
    pieces = packing.pack(repeated, PATH).collect()
    assert sum(row["length"] for row in pieces) == repeated.count() * pieces[0]["doc_tokens"]
    assert packing.pack(no_documents(spark), PATH).count() == 0


def test_index_scores_are_bm25():
    rng = np.random.default_rng(3)
    documents = [rng.integers(0, 30, rng.integers(1, 40)).astype("<u2") for _ in range(25)]
    frequency = np.array([sum(token in ids for ids in documents) for token in range(30)])
    idf = np.maximum(np.log((25 - frequency + 0.5) / (frequency + 0.5)), 0)
    mean = np.mean([len(ids) for ids in documents])
    index = packing.Index(documents, idf, mean)
    for seed in range(25):
        expected = []
        for ids in documents:
            total = 0.0
            for token in set(documents[seed].tolist()):
                times = (ids == token).sum()
                total += idf[token] * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * len(ids) / mean))
            expected.append(total)
        assert np.allclose(index.scores(index.query_of(seed)), expected)


def test_neighbours_of_a_seed_share_its_window():
    rng = np.random.default_rng(5)
    topics = [np.arange(100 * t, 100 * t + 100) for t in range(6)]
    documents = [rng.choice(topics[at % 6], 60).astype("<u2") for at in range(120)]
    frequency = np.zeros(600)
    for ids in documents:
        frequency[np.unique(ids)] += 1
    idf = np.maximum(np.log((120 - frequency + 0.5) / (frequency + 0.5)), 0)
    packer = packing.Packer(600, 0)
    packer.take(list(range(120)), documents, packing.Index(documents, idf, 60.0))
    packer.close()
    windows = {}
    for doc_id, start, piece, _, number, _ in packer.done:
        windows.setdefault(number, []).append(doc_id % 6)
    pure = [max(map(group.count, group)) / len(group) for group in windows.values()]
    assert np.mean(pure) > 0.9
    assert sorted({x[0] for x in packer.done}) == list(range(120))


def test_op1(spark, sf_dir, tokenizer):
    docs = dict(plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    for row in packing.op1_bm25_packing(spark, sf_dir).collect():
        ids = ids_of(tokenizer, docs[row["doc_id"]])[row["start"] : row["start"] + row["length"]]
        assert row["ids_crc32"] == zlib.crc32(ids.tobytes())
