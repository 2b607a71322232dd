import random
import zlib

import pytest
from pyspark.sql import functions as F

from logspark.llm import langid
from tests.llm.samples import no_documents, odd_documents

SYLLABLES = {"aa": "ka lo mi ne ru".split(), "bb": "sch ver ung ich bei".split(), "cc": "que eau oir ment lle".split()}


def words(rng, name, count):
    return " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randint(1, 4))) for _ in range(count))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(at, words(rng, name, rng.randint(1, 200)), name, "s") for at, name in enumerate(["aa", "bb", "cc"] * 60)]
    return langid.fit(labelled(spark, rows), F.lit(True))


def test_languages_are_told_apart(model):
    rng = random.Random(2)
    answer = langid.Classifier(model)
    for name in SYLLABLES:
        for count in (12, 50, 5000):
            found, score, rejected = answer(words(rng, name, count).upper() + " 12!")
            assert found == name and 0 < score <= 1 and not rejected
    asked = [(name, words(rng, name, 3)) for name in SYLLABLES for _ in range(40)]
    assert sum(answer(text)[0] == name for name, text in asked) >= 0.8 * len(asked)


def test_odd_texts(spark, model):
    answer = langid.Classifier(model)
    for text in (None, "", "  ", "123 !?", "½ ² ___", "\n"):
        assert answer(text) == (langid.UNKNOWN, 0.0, True)
    name, score, rejected = answer("日本語")
    assert name in SYLLABLES and 0 <= score <= 1
    found = langid.classify(odd_documents(spark), model)
    assert found.count() == odd_documents(spark).count()
    assert found.where("score < 0 OR score > 1 OR lang_pred IS NULL").count() == 0
    assert set(found.select("record.*").columns) == set(odd_documents(spark).columns) - {"text"}
    assert langid.classify(no_documents(spark), model).count() == 0


def test_nothing_learned(spark):
    rows = [(1, "some text", None, "s"), (2, None, "aa", "s"), (3, "12", "aa", "s")]
    model = langid.fit(labelled(spark, rows), F.lit(True))
    assert model == []
    assert {row["lang_pred"] for row in langid.classify(labelled(spark, rows), model).collect()} == {langid.UNKNOWN}


def test_one_language_and_few_bytes(spark):
    model = langid.fit(labelled(spark, [(1, "ab", "aa", "s")]), F.lit(True))
    assert langid.Classifier(model)("any text at all") == ("aa", 1.0, False)


def test_copies_and_the_row_order_do_not_count(spark):
    rng = random.Random(3)
    rows = [(at, words(rng, name, 30), name, "s") for at, name in enumerate(["aa", "bb"] * 300)]
    copies = [(1000 + at, rows[0][1], "aa", "s") for at in range(2000)]
    turned = [(-row[0], *row[1:3], "other") for row in reversed(rows)]
    fitted = [langid.fit(labelled(spark, each).repartition(5), F.lit(True)) for each in (rows, rows + copies, turned)]
    assert fitted[0] == fitted[1] == fitted[2]
    assert all(100 < known.dictionary.count(b"\n") < 300 for known in fitted[0])


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rng = random.Random(4)
    rows = [(at, words(rng, "aa", 3000), name, "s") for at, name in enumerate(["aa", "bb", "bb", "cc", "cc"])]
    model = langid.fit(labelled(spark, rows), F.lit(True))
    assert [known.name for known in model] == ["bb", "cc"]
    assert all(len(known.dictionary) <= langid.CHARS * 2 + 1 for known in model)


def test_op11(spark, sf_dir):
    docs = {row["doc_id"]: row for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = langid.op11_compression_langid(spark, sf_dir).collect()
    assert sorted(row["doc_id"] for row in found) == sorted(docs)
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1) for row in found)
    known = {row["lang"] for row in docs.values()}
    assert all(row["lang_pred"] in known and 0 <= row["score"] <= 1 for row in found)
    judged = [row for row in found if row["held_out"]]
    right = sum(row["lang_pred"] == docs[row["doc_id"]]["lang"] for row in judged)
    assert right >= 0.95 * len(judged)
    # A plain version, from the same model, of a sample of answers.
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~langid.held_out(F.col("doc_id")))
    answer = langid.Classifier(model)
    for row in found[:30]:
        assert (row["lang_pred"], row["score"], row["rejected"]) == answer(docs[row["doc_id"]]["text"])
