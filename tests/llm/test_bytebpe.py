import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from logspark.llm.bytebpe import ByteEncoder, decode_bytes, encode_bytes, op3_byte_bpe
from tests.llm.samples import no_documents, odd_documents, odd_texts, plain_rows

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def both(name):
    with open(public_tokenizers.path(name), "rb") as file:
        mine = ByteEncoder(file.read(), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.ranks, special_tokens={}
    )
    return mine, theirs


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    return both(request.param)


def test_ids_are_those_of_the_library(pair):
    mine, theirs = pair
    rng = random.Random(1)
    letters = "abcdehlnorst  \n\t'é日😀0123.,-́_"
    texts = [text or "" for text in odd_texts()]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(4_000)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(20_000)), " " * 500 + "x", "\n" * 99, "  a  \n  b \n c"]
    texts += ["don't'll'", "hello" * 2_000, "<|endoftext|>", "a  b", "x   y"]
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_a_long_piece_takes_linear_time(pair):
    mine, theirs = pair
    for text in ("ab" * 100_000, "a" * 200_000):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)




def test_odd_documents(spark):
    path = public_tokenizers.path(FILES[0])
    docs = odd_documents(spark)
    found = decode_bytes(encode_bytes(docs, path), path).collect()
    rows = plain_rows(docs)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in found) == sorted(
        (str(doc_id), text.encode()) for doc_id, text in rows
    )
    assert encode_bytes(no_documents(spark), path).count() == 0


def test_op3(spark, sf_dir):
    _, theirs = both(FILES[0])
    docs = dict(plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = op3_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(docs)
    for row in found:
        text = docs[row["doc_id"]]
        ids = np.array(theirs.encode_ordinary(text), "<u4")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
