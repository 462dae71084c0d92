import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clickspark.llm import simhash
from clickspark.llm.components import connected_components
from clickspark.llm.queries import op6_simhash
from tests.conftest import SF_SMALL

M = (1 << 64) - 1


def plain_fingerprint(text, k=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    """fp -> smallest fp reachable, all pairs compared."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    array = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ np.uint64(f)) <= distance):
            a, b = sorted((root(f), root(fps[i + 1 + j])))
            parent[b] = a
    return {f: root(f) for f in fps}


def near(rng, centre, bits):
    for b in rng.sample(range(64), bits):
        centre ^= 1 << b
    return centre


TEXTS = [None, "", " \t\n", "one", "One\x0bTWO three", "a b c d", "A B C D e F g", "é É ß\xa0x\x85y z w", "x" * 100_000, "w " * 50_000]


def test_fingerprint_equals_definition():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices(["The", "the", "of", "ÄB", "q\x1cq"], k=rng.randrange(40))) for _ in range(300)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(0, 5))
def test_local_links_join_what_all_pairs_join(seed, n, clusters):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(clusters + 1)]
    fps = list({near(rng, rng.choice(centres), rng.randrange(9)) for _ in range(n)} | {0, M})
    groups = [0, 1]
    rows = [(g, f) for g in groups for f in fps if g == 0 or f % 3]
    u, v = simhash.local_links(np.array([g for g, _ in rows]), np.array([f for _, f in rows], dtype=np.uint64), 4)
    expected = plain_components(fps)
    got = plain_components(fps, -1)
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = sorted((got[a], got[b]))
        got = {f: (x if r == y else r) for f, r in got.items()}
    assert got == expected and len(u) < len(fps)


def test_gray_rank_is_the_place_in_the_gray_sequence():
    ranks = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, i) for i in range(2001, 2300)]
    parent = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    expected = {n: p for n, p in parent.items() if any(n in e and e[0] != e[1] for e in edges)}
    rows = connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()
    assert {r.node: r.component for r in rows} == expected and len(rows) == len(expected)
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("blocks", [None, 5, 6, 8])
def test_crowded_values_are_cut_without_losing_links(spark, blocks):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = list({near(rng, centre, rng.randrange(7)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.link_fingerprints(table, 4, most=16, blocks=blocks).collect()
    got = plain_components(fps, -1)
    for r in links:
        x, y = sorted((got[r.u & M], got[r.v & M]))
        got = {f: (x if q == y else q) for f, q in got.items()}
    assert got == plain_components(fps)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.block_count(10 ** e, 4, 16384) for e in (0, 3, 8, 9, 10)] == [5, 5, 5, 6, 6]
    rng = random.Random(9)
    for blocks in range(5, 11):
        masks = [m & M for m in simhash.block_masks(blocks, 4)]
        for _ in range(300):
            f = rng.getrandbits(64)
            g = near(rng, f, 4)
            assert any(f & m == g & m for m in masks)


def test_rows_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_LARGE", 2)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[:j] + ["other"] + words[j + 1:])) for i, j in enumerate(range(0, 400, 10))] + [(50, "one"), (51, "two"), (None, " ".join(words))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = simhash.simhash_components(table).collect()
    assert Counter((r.doc_id, f"{r.fp & M:016x}", r.component_id) for r in rows) == expected_rows(docs)
    assert max(Counter(r.root for r in rows).values()) > 2


def expected_rows(docs):
    fp = {r: plain_fingerprint(r[1]) for r in set(docs)}
    root = plain_components(fp.values())
    first = {}
    for (i, _), f in fp.items():
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    return Counter((i, f"{fp[i, t]:016x}", first.get(root[fp[i, t]])) for i, t in docs)


def test_whole_table_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op6_simhash(spark, SF_SMALL).collect()) == expected_rows(docs)


def test_nulls_repeats_empty_and_dropping(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c d"), (None, "quite other words here now"), (3, "one"), (5, "A B C D")]
    table = spark.createDataFrame([(*d, {"k": 1}, "x") for d in docs], "doc_id long, text string, fp map<string,int>, component_id string")
    rows = simhash.simhash_components(table).collect()
    assert Counter((r.doc_id, f"{r.fp & M:016x}", r.component_id) for r in rows) == expected_rows(docs)
    kept = simhash.drop_near_duplicates(table)
    assert kept.schema == table.schema
    ids = Counter((r.doc_id, r.text) for r in kept.collect())
    assert ids[0, None] == 1 and (1, "") not in ids and ids[3, "one"] == 1 and ids[None, "quite other words here now"] == 1
    assert (None, "a b c d") not in ids and max(ids.values()) == 1
    assert simhash.simhash_components(table.limit(0)).collect() == []
    assert simhash.drop_near_duplicates(table.limit(0)).collect() == []
