import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from logspark.llm import sentences as sn
from logspark.llm.common import text_blocks
from tests.llm.samples import no_documents, odd_documents, odd_texts, plain_rows, prose

TOKEN = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def plain_pieces(text):
    """Pieces as lists of words with their white space, by plain loops."""
    tokens = TOKEN.findall(text)
    sentences, line = [], []
    for token in tokens:
        line.append(token)
        if token.rstrip(" \t\n\x0b\f\r")[-1] in ".!?" or "\n" in token:
            sentences.append(line)
            line = []
    out = []
    for line in [*sentences, line]:
        ranks = [sn.digest(token.rstrip(" \t\n\x0b\f\r").encode())[:8] for token in line]
        cuts = {0, len(line)}
        for at in range(len(line) - sn.PIECE + 1):
            cuts.add(min(range(at, at + sn.PIECE), key=lambda i: (ranks[i], -i)))
        cuts = sorted(cuts)
        out += [line[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def plain_spans(pieces):
    """(first piece, piece after the last, words) of every span."""
    for begin in range(len(pieces)):
        for end in range(begin + sn.SPAN, len(pieces) + 1):
            words = [token.rstrip(" \t\n\x0b\f\r") for piece in pieces[begin:end] for token in piece]
            if len(words) >= sn.WORDS:
                yield begin, end, tuple(words)
                break


def plain_cuts(rows):
    """Kept text, pieces and removed pieces of every document, by a plain count."""
    times, first, known = Counter(), {}, {}
    for doc_id, text in sorted(set(rows), key=lambda row: -1 if row[0] is None else row[0]):
        pieces = plain_pieces(text)
        spans = list(plain_spans(pieces))
        known[doc_id, text] = pieces, spans
        for begin, _, words in spans:
            times[words] += rows.count((doc_id, text))
            first.setdefault(words, (doc_id, text, begin))
    out = []
    for doc_id, text in rows:
        pieces, spans = known[doc_id, text]
        gone = set()
        for begin, end, words in spans:
            if times[words] > 1 and first[words] != (doc_id, text, begin):
                gone |= set(range(begin, end))
        head = text[: len(text) - len("".join(t for p in pieces for t in p))]
        kept = head + "".join(token for at, piece in enumerate(pieces) if at not in gone for token in piece)
        out.append((str(doc_id), len(pieces), len(gone), kept))
    return sorted(out)


def got(frame):
    return sorted((str(r["doc_id"]), r["n_sentences"], r["n_removed"], r["text"] or "") for r in frame.collect())


def pieces_of(text):
    for _, raw, offsets in text_blocks(pa.array([text])):
        words, edges = text.split(None), sn.Pieces(raw, offsets).starts.tolist()
        return [words[a:b] for a, b in zip(edges, edges[1:])]


def test_pieces():
    assert pieces_of("One 3.5 two.  Three!\nFour\nfive? six") == [["One", "3.5", "two."], ["Three!"], ["Four"], ["five?"], ["six"]]
    for text in odd_texts():
        plain = [[token.strip(" \t\n\x0b\f\r") for token in piece] for piece in plain_pieces(text or "")]
        assert pieces_of(text or "") == plain
        assert all(0 < len(piece) <= max(sn.PIECE, 1) for piece in plain if not piece[-1].endswith((".", "!", "?")))


@pytest.mark.parametrize("text", ["." * 200_000, "a. " * 100_000, "a " * 100_000, " " * 200_000, "\n" * 200_000])
def test_long_runs_take_linear_time(text):
    ((_, raw, offsets),) = text_blocks(pa.array([text]))
    found = sn.Pieces(raw, offsets)
    assert found.starts[-1] == len(text.split())
    assert len(found.spans[0]) <= len(found.starts)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = sn.cut_documents(docs)
    assert got(found.select("record.doc_id", "n_sentences", "n_removed", "record.text")) == plain_cuts(plain_rows(docs))
    assert found.where("record.text IS NULL").count() == docs.where("text IS NULL").count()
    assert sn.without_repeats(docs).columns == docs.columns
    assert sn.without_repeats(no_documents(spark)).count() == 0


def own_words(rng, count, marks=0.0):
    return " ".join(f"w{rng.randrange(10**9)}" + ("." if rng.random() < marks else "") for _ in range(count))


def test_every_passage_of_51_words_is_found(spark):
    """In one to many sentences, at sentence borders or inside a sentence, at the start and the end."""
    rng = random.Random(7)
    rows, passages = [], []
    for at in range(120):
        passage = own_words(rng, 51, marks=(0, 0.02, 0.06, 0.15, 0.4)[at % 5])
        passages.append(passage)
        for _ in range(2):
            before = own_words(rng, rng.choice([0, 1, 5, 11, 12, 30]), 0.05)
            after = own_words(rng, rng.choice([0, 1, 5, 11, 12, 30]), 0.05)
            rows.append((len(rows), f"{before}{rng.choice(['', '.']) if before else ''} {passage} {after}".strip(" ")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {row["doc_id"]: row["text"] for row in sn.without_repeats(docs).collect()}
    for at, passage in enumerate(passages):
        assert kept[2 * at] == rows[2 * at][1]
        own = len(rows[2 * at + 1][1].split()) - 51
        rest = kept[2 * at + 1].split()
        # A span goes, at least 24 words; what surrounds the passage stays.
        assert own <= len(rest) <= own + 51 - sn.WORDS
        assert not set(rows[2 * at + 1][1].split()) - set(passage.split()) - set(rest)


def test_short_repeats_and_clean_documents_stay(spark):
    rng = random.Random(8)
    common = own_words(rng, sn.WORDS - 1, 0.2)
    texts = [f"{own_words(rng, 60, 0.1)}. {common} {own_words(rng, 60, 0.1)}" for _ in range(20)]
    docs = odd_documents(spark, texts)
    assert sorted(row["text"] for row in sn.without_repeats(docs).collect()) == sorted(texts)


def test_op8(spark, sf_dir):
    rows = plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert got(sn.op8_sentence_spans(spark, sf_dir)) == plain_cuts(rows)


def test_rows_of_one_or_no_doc_id_are_documents_of_their_own(spark):
    rng = random.Random(9)
    passage = own_words(rng, 50, 0.2) + "."
    own = [own_words(rng, 30, 0.2) + "." for _ in range(10)]
    for doc_id in (None, 7):
        # The passage at one place of two rows, at a later one of a third; others are unique at those places.
        texts = [f"{passage} {own[0]}", f"{passage} {own[1]}", f"{own[2]} {passage}", f"{own[3]} {own[4]}", own[5]]
        docs = spark.createDataFrame([(doc_id, text) for text in texts] + [(8, passage)], "doc_id long, text string")
        kept = [row["text"] for row in sn.without_repeats(docs).collect()]
        assert sum(text.count(passage) for text in kept) == 1
        assert sorted(text for text in kept if passage not in text and text in (texts[3], own[5])) == sorted([texts[3], own[5]])
        for text in own[:6]:
            assert sum(other.count(text) for other in kept) == 1


def test_copies_of_one_row_lose_the_same(spark):
    rng = random.Random(10)
    passage = prose(rng, 80)
    rows = [(1, passage), (None, f"{passage} It ends."), (None, f"{passage} It ends."), (3, f"So. {passage}"), (3, f"So. {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sn.cut_documents(docs).select("record.doc_id", "n_sentences", "n_removed", "record.text")
    assert got(found) == plain_cuts(rows)
    kept = {row["doc_id"]: row["text"] for row in found.collect()}
    assert kept[None] == rows[1][1] and len(kept[1]) < len(passage) / 2
