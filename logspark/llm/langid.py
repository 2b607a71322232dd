"""Language identification by compression.

For each language a sample of its texts is the raw-content dictionary of a zstandard
compressor. A text is encoded with every dictionary, in frames of at most FRAME bytes so
that the dictionary counts and not the text's own beginning; the language of the smallest
total is chosen. Before, texts are lower-cased and all but letters becomes single spaces.

Where the smallest two are within NARROW or FEW bytes of each other, as in short texts, whose
frames are all overhead, the text is encoded anew behind each of CONTEXTS pieces of a language's
sample, and the bytes it adds to them are summed. What is still within REJECT then is
named but marked ``rejected``. Equal sums go to the language with more training texts, then
to the lesser name.

The fit reads labelled rows only: equal texts of a language count once, DOCUMENTS texts of
each language on average, those of least hash, give their first CHARS characters to the
sample. The LANGUAGES most frequent languages are learned. So a model has a bounded size
at any size of the input; everything is predicted whole.

A null text, one without letters, and every text if nothing was learned, is ``und`` with
score 0, rejected. Repeated rows are answered each. Null languages are not learned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.common import read_documents

LANGUAGES, DOCUMENTS, CHARS = 64, 200, 4000
DICTIONARY, LEVEL, FRAME = 1 << 16, 6, 4096
CONTEXTS, CONTEXT = 8, 512
NARROW, FEW, REJECT = 0.03, 8, 0.01
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """Runs of letters in lower case, with single spaces; empty for a text without letters."""
    found = " ".join(_LETTERS.findall(text.lower()))
    return found if any(map(str.isalpha, found)) else ""


@dataclass
class Language:
    name: str
    texts: int
    dictionary: bytes
    contexts: list[bytes]


def language(name: str, count: int, texts: list[str]) -> Language:
    """The dictionary and, from other bytes if there are enough, the contexts of a language."""
    sample = "\n".join(filter(None, map(letters, texts))).encode()
    apart = CONTEXTS * CONTEXT
    if len(sample) >= 2 * apart:
        return Language(name, count, sample[apart:][:DICTIONARY], _contexts(sample))
    return Language(name, count, sample, _contexts(sample * (apart // max(1, len(sample)) + 1)))


def _contexts(sample: bytes) -> list[bytes]:
    return [sample[at : at + CONTEXT] + b" " for at in range(0, CONTEXTS * CONTEXT, CONTEXT)]


def fit(docs: DataFrame, labelled: Column) -> list[Language]:
    """The languages of the rows with a label and a text for which ``labelled`` holds."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    has_letters = F.rlike(text, F.lit(r"\p{L}"))
    rows = docs.where(labelled & lang.isNotNull() & has_letters)
    rows = rows.select(lang.alias("lang"), F.xxhash64(text).alias("hash"), text.alias("text"))
    # Equal texts first become one row, so that copies are neither counted nor gathered.
    counts = rows.groupBy("lang", "hash").count().groupBy("lang").agg(F.count("*").alias("n"))
    known = {row["lang"]: row["n"] for row in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not known:
        return []
    # A hash is even over 2**63 positive values.
    share = F.create_map(*[F.lit(x) for name, n in known.items() for x in (name, min(1.0, DOCUMENTS / n))])
    place = F.col("hash").bitwiseAND(F.lit((1 << 63) - 1)).cast("double") / float(1 << 63)
    picked = rows.where(place <= share[F.col("lang")])
    picked = picked.groupBy("lang", "hash").agg(F.min(F.substring("text", 1, CHARS)).alias("text"))
    texts: dict[str, list] = {name: [] for name in known}
    for row in sorted(picked.collect(), key=lambda row: row["hash"]):
        texts[row["lang"]].append(row["text"])
    return [language(name, n, texts[name]) for name, n in known.items() if texts[name]]


class Classifier:
    """The compressors of a model, for one worker."""

    def __init__(self, model: list[Language]):
        import zstandard

        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0)
        self.model = sorted(model, key=lambda known: (-known.texts, known.name))
        self.compress, self.base = [], []
        for known in self.model:
            content = zstandard.ZstdCompressionDict(known.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            compressor = zstandard.ZstdCompressor(dict_data=content, compression_params=settings)
            self.compress.append(compressor.compress)
            self.base.append([len(compressor.compress(piece)) for piece in known.contexts])

    def sizes(self, frames: list[bytes]) -> list[int]:
        return [sum(len(compress(frame)) for frame in frames) for compress in self.compress]

    def added(self, frames: list[bytes]) -> list[int]:
        """How many bytes the frames add to the contexts of each language."""
        return [
            sum(len(compress(piece + frame)) - size for piece, size in zip(known.contexts, base) for frame in frames)
            for compress, known, base in zip(self.compress, self.model, self.base)
        ]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the margin over the second best as a share of its size, and whether that is too narrow."""
        raw = letters(text or "").encode()
        if not raw or not self.model:
            return UNKNOWN, 0.0, True
        frames = [raw[at : at + FRAME] for at in range(0, len(raw), FRAME)]
        sizes = self.sizes(frames)
        found = self._chosen(sizes)
        if found[1] <= max(NARROW, FEW / max(min(sizes), 1)):
            found = self._chosen(self.added(frames))
        best, margin = found
        return self.model[best].name, margin, margin < REJECT

    def _chosen(self, sizes: list[int]) -> tuple[int, float]:
        order = sorted(range(len(sizes)), key=lambda at: (sizes[at], at))
        if len(order) == 1:
            return order[0], 1.0
        first, second = (max(sizes[at], 0) for at in order[:2])
        return order[0], (second - first) / max(second, 1)


def classify(docs: DataFrame, model: list[Language]) -> DataFrame:
    """The rows of ``docs``, as a struct ``record``, with lang_pred, score (0 to 1) and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    holder: list[Classifier] = []

    def run(batches):
        if not holder:
            holder.append(Classifier(sent.value))
        answer = holder[0]
        for batch in batches:
            found = [answer(text.as_py()) for text in batch.column("text")]
            names, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("record"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["record", "lang_pred", "score", "rejected"],
            )

    kept = F.struct(*[F.col(f"`{name}`") for name in docs.columns if name != "text"])
    laid = docs.select(kept.alias("record"), F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [
            laid.schema["record"],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return laid.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without doc_id is not."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op11_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs, ~held_out(F.col("doc_id")))
    found = classify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return found.select("record.doc_id", "record.held_out", "lang_pred", "score", "rejected")
