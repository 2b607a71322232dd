import itertools
import random

import numpy as np
import pytest

from logspark.llm import ngram_join
from logspark.llm.hashing import mix
from tests.llm.samples import (
    least_reachable,
    linked,
    no_documents,
    odd_documents,
    plain_rows,
    prose,
    shingles,
)


def check(found, rows):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingles(text))
    ids = [doc_id for doc_id in sets if doc_id is not None]
    links = [
        (a, b)
        for a, b in itertools.combinations(ids, 2)
        if any(linked(x, y) for x in sets[a] for y in sets[b])
    ]
    expected = least_reachable(ids, links)
    assert len(found) == len(rows)
    for row in found:
        assert row["component_id"] == expected.get(row["doc_id"])
        assert row["n_shingles"] in {len(x) for x in sets[row["doc_id"]]}
    return links


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert check(ngram_join.similar_groups(docs).collect(), plain_rows(docs))
    assert ngram_join.similar_groups(no_documents(spark)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {6, 7, 8, 9, 10} & {row["doc_id"] for row in kept.collect()} == {6}


def test_op5(spark, sf_dir):
    rows = plain_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check(ngram_join.op5_count_rtree(spark, sf_dir).collect(), rows)


def edited(rng, text, share):
    found = text.split(" ")
    for at in rng.sample(range(len(found)), max(1, int(share * len(found)))):
        found[at] = prose(rng, 1) + "x"
    return " ".join(found)


def test_chains_of_edits_and_common_passages(spark):
    """Links near the threshold, chains, sets of all sizes, and a passage that many share."""
    rng = random.Random(11)
    passage, texts = prose(rng, 60), []
    for size in (4, 6, 9, 15, 40, 90, 130, 260, 700):
        text = prose(rng, size)
        texts.append(text)
        for share in (0.01, 0.02, 0.03, 0.04, 0.05):
            texts.append(edited(rng, text, share))
            texts.append(edited(rng, texts[-1], share))
    texts += [prose(rng, 80) + " " + passage + " " + prose(rng, 80) for _ in range(30)]
    rng.shuffle(texts)
    docs = odd_documents(spark, texts)
    links = check(ngram_join.similar_groups(docs).collect(), plain_rows(docs))
    assert len(links) > 20


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_meet(percent):
    """Whatever their sizes, sets at the threshold have a key in common."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 99, 100, 124, 125, 126, 150, 151, 224, 225, 400, 1000, 3000]:
        for _ in range(12):
            one = mix(rng.integers(0, 1 << 62, size).astype(np.uint64))
            # the most strangers that a link of some size allows
            size_two = int(rng.integers(-(-size * percent // 100), size * 100 // percent + 1))
            shared = -(-percent * (size + size_two) // (100 + percent))
            if shared > min(size, size_two):
                continue
            strangers = mix(rng.integers(0, 1 << 62, size_two - shared).astype(np.uint64))
            two = np.concatenate([rng.permutation(one)[:shared], strangers])
            values = np.concatenate([np.sort(one), np.sort(two)])
            keys, texts = ngram_join.meeting_keys(values, np.array([0, size, size + size_two]), percent)
            assert set(keys[texts == 0].tolist()) & set(keys[texts == 1].tolist()), (size, size_two, shared)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    bases = rng.poisson(3, (20, 32))
    points = np.maximum(0, bases[rng.integers(0, 20, 900)] + rng.integers(-1, 2, (900, 32))).astype(np.int32)
    tree = ngram_join.RTree(points)
    sizes = points.sum(axis=1)
    hits = 0
    for query in points[::9]:
        shared = np.minimum(points, query).sum(axis=1)
        expected = np.flatnonzero(100 * shared >= 80 * (sizes + query.sum() - shared))
        found, bound = tree.search(query, 80)
        assert (bound >= 0.8).all()
        assert sorted(found.tolist()) == expected.tolist()
        hits += len(found)
    assert hits > 100
    assert len(ngram_join.RTree(points[:1]).search(points[0], 80)[0]) == 1


def test_bound_holds():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = mix(np.arange(60, dtype=np.uint64) + np.uint64(rng.integers(1 << 40)))
        one, two = (np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(2))
        first = np.array([0, len(one), len(one) + len(two)])
        counts = ngram_join.vectors(np.concatenate([one, two]), first)
        assert np.minimum(counts[0], counts[1]).sum() >= len(np.intersect1d(one, two))
        assert counts.sum(axis=1).tolist() == [len(one), len(two)]


def test_tree_pairs_over_bands_and_trees(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_POINTS", 16)
    rng = np.random.default_rng(8)
    base = rng.poisson(4, 64)
    points = [np.maximum(0, base * f + rng.integers(-1, 2, 64)).astype(np.int32) for f in (1, 1, 1, 2) for _ in range(40)]
    rows = [(0, at, at % 3, int(p.sum()), p.tobytes()) for at, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "leader long, doc_id long, component long, size long, counts binary")
    found = {(r["a"], r["b"]) for r in ngram_join.tree_pairs(frame, 80).collect()}
    expected = set()
    for (a, one), (b, two) in itertools.combinations(enumerate(points), 2):
        shared = np.minimum(one, two).sum()
        if a % 3 != b % 3 and 100 * shared >= 80 * (one.sum() + two.sum() - shared):
            expected.add((a, b))
    assert found == expected and expected
