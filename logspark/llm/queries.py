"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logspark.llm.bytebpe import op3_byte_bpe
from logspark.llm.fingerprint import op6_bottom_k
from logspark.llm.langid import op11_compression_langid
from logspark.llm.ngram_join import op5_count_rtree
from logspark.llm.packing import op1_bm25_packing
from logspark.llm.quality import op7_quality
from logspark.llm.rans import op2_rans
from logspark.llm.runs import op12_difference_cover_runs
from logspark.llm.sentences import PIECE, SPAN, WORDS, op8_sentence_spans
from logspark.llm.sharding import op10_two_pass_shuffle
from logspark.llm.suffixes import op9_prefix_doubling
from logspark.llm.urls import op4_markov_urls
from logspark.llm.whitening import op13_incremental_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bm25_packing,
        op2_rans,
        op3_byte_bpe,
        op4_markov_urls,
        op5_count_rtree,
        op6_bottom_k,
        op7_quality,
        op8_sentence_spans,
        op9_prefix_doubling,
        op10_two_pass_shuffle,
        op11_compression_langid,
        op12_difference_cover_runs,
        op13_incremental_whitening,
    )
    return {query.__name__: query for query in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_JOIN = f"""WITH RECURSIVE texts AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
 FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
 SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
 FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
 WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a),
least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id"""

_SPANS = f"""WITH parts AS (
 SELECT row_number() OVER () AS d, doc_id, text, regexp_extract(coalesce(text, ''), '^[\\x20\\x09-\\x0D]*') AS head,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS parts FROM documents),
spelled AS (SELECT d, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM parts),
ranked AS (SELECT d, i, md5(regexp_extract(part, '^[^\\x20\\x09-\\x0D]+'))[:16] AS rank,
 regexp_matches(part, '[.!?][\\x20\\x09-\\x0D]*$') OR contains(part, chr(10)) AS closes FROM spelled),
lagged AS (SELECT *, coalesce(lag(closes) OVER (PARTITION BY d ORDER BY i), true) AS opens FROM ranked),
lined AS (SELECT *, sum(opens::INT) OVER (PARTITION BY d ORDER BY i) AS line FROM lagged),
least_of AS (SELECT d, count(*) OVER w AS n, min({{'rank': rank, 'i': -i}}) OVER w AS least FROM lined
 WINDOW w AS (PARTITION BY d, line ORDER BY i ROWS BETWEEN CURRENT ROW AND {PIECE - 1} FOLLOWING)),
begins AS (SELECT d, i FROM lined WHERE opens UNION SELECT d, -least.i FROM least_of WHERE n = {PIECE}),
cuts AS (SELECT d, list(i ORDER BY i) AS b FROM begins GROUP BY d),
texts AS (SELECT d, doc_id, text, head, parts, list_append(coalesce(b, []), len(parts) + 1) AS b FROM parts LEFT JOIN cuts USING (d)),
ends AS (SELECT d, doc_id, p, b[p] AS i, parts,
 greatest(p + {SPAN}, list_position(list_transform(b, lambda x: x >= b[p] + {WORDS}), true)) AS e, b
 FROM texts, unnest(range(1, len(b))) AS t(p)),
runs AS (SELECT d, doc_id, p, e, list_transform(parts[i:b[e] - 1], lambda x: regexp_extract(x, '^[^\\x20\\x09-\\x0D]+')) AS run
 FROM ends WHERE e <= len(b) AND b[len(b)] >= i + {WORDS}),
again AS (SELECT d, p, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS rn FROM runs) WHERE rn > 1),
gone AS (SELECT d, list(DISTINCT x) AS places FROM again, unnest(range(p, e)) AS t(x) GROUP BY d)
SELECT doc_id, len(b) - 1 AS n_sentences, coalesce(len(places), 0) AS n_removed, CASE WHEN text IS NOT NULL THEN head || array_to_string(
 list_transform(list_filter(range(1, len(b)), lambda p: NOT list_contains(coalesce(places, []), p)),
  lambda p: array_to_string(parts[b[p]:b[p + 1] - 1], '')), '') END AS text
FROM texts LEFT JOIN gone USING (d)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it and stays small: the byte strings of op9 do not fit in memory, and the
    others need a tokenizer, a generator or sketch hashes, or train a model. Tests compare
    those with brute force."""
    return {"op5_count_rtree": _JOIN, "op8_sentence_spans": _SPANS}
