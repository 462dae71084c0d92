import heapq
import zlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from clickspark.llm.queries import op8_shards
from clickspark.llm.sharding import least_loaded, shard_documents
from tests.conftest import SF_SMALL


@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 7))
def test_heap_is_longest_processing_time(sizes, shards):
    units = list(enumerate(sizes))
    loads = [0] * shards
    expected = []
    for unit, size in sorted(units, key=lambda x: (-x[1], x[0])):
        shard = min(range(shards), key=lambda i: (loads[i], i))
        loads[shard] += size
        expected.append((unit, shard))
    assert least_loaded(units, shards) == expected


def check(rows, texts, shards):
    by_text, slots, loads = defaultdict(set), defaultdict(list), [0] * shards
    for r in rows:
        by_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    return loads


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    loads = check(op8_shards(spark, SF_SMALL).collect(), docs, 40)
    groups = defaultdict(int)
    for r in docs:
        groups[r.text] += len(r.text.encode()) + 16
    heap = [0] * 40
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    # few groups: each is a unit of its own or bundled with tiny neighbours
    assert max(loads) <= max(heap) * 1.02


def test_near_equal_and_reproducible(spark):
    docs = spark.range(20000).selectExpr("id doc_id", "repeat('ab ', cast(5 + pmod(hash(id), 400) as int)) || id text")
    first = shard_documents(docs, 8)
    rows = first.collect()
    loads = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert max(loads) - min(loads) < 0.0005 * sum(loads) / 8
    assert sorted(rows) == sorted(shard_documents(docs.repartition(5), 8).collect())


def test_nulls_repeats_and_empty(spark):
    texts = [(1, None), (2, ""), (None, "a"), (None, "a"), (3, "a"), (3, "a"), (4, "b" * 100_000)]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, size string, shard int")
    check(shard_documents(docs, 3).collect(), texts, 3)
    assert shard_documents(docs.limit(0), 3).collect() == []
