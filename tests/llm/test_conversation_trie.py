import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from clickspark.llm import conversation_trie
from clickspark.llm.conversation_trie import forked_paths, trie_nodes, turn_paths
from clickspark.llm.queries import op12_prefix_trie
from clickspark.llm.radix_tree import RadixTree, shared_length
from tests.conftest import SF_SMALL


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + v[h:]
    return out


def nodes_of(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        own = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(members[path]) - 1) * own + sum(saved[k] for k in kids[path])
    sha = lambda c: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def in_order(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert in_order(op12_prefix_trie(spark, SF_SMALL)) == nodes_of(rebuilt(rows))


def crowd(seed):
    """Conversations over few different turns: copies, prefixes of others, empty and long ones."""
    pick = random.Random(seed)
    texts = ["", "a", "b", "né", "漢字" * 40]
    convs = {}
    for c in range(300):
        kind = pick.random()
        if kind < 0.35:
            convs[c] = [("user", "copy")] * 4
        elif kind < 0.4:
            convs[c] = []
        elif kind < 0.45:
            convs[c] = [("user", str(i % 3)) for i in range(pick.randrange(60))]
        else:
            convs[c] = [(pick.choice(["user", "", "bot"]), pick.choice(texts)) for _ in range(pick.randrange(7))]
    return convs


@pytest.mark.parametrize("rows,parts", [(1, 3), (2, 5), (7, 4), (50, 2), (100_000, 8), (100_000, 1)])
def test_segments_of_any_size(spark, rows, parts, monkeypatch):
    """Nodes, leaves and lists that many segments share, against a plain trie."""
    monkeypatch.setattr(conversation_trie, "SEGMENT_ROWS", rows)
    monkeypatch.setattr(conversation_trie, "_PIECE", 3)
    convs = crowd(rows + parts)
    turns = [(c, i, *t) for c, v in convs.items() for i, t in enumerate(v)]
    some = turn_paths(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    none = spark.createDataFrame([(c, b"") for c, v in convs.items() if not v], "conv_id long, path binary")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert in_order(trie_nodes(some.unionByName(none))) == nodes_of(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nulls_ties_repeats_absent_bases_and_clashing_names(spark):
    rows = [(c, t, r, x) for c in range(-7, 23) if c not in (10, 15) for t, r, x in
            ((None, "user", "n"), (3, None, "x"), (1, "bot", None), (2, "user", f"own {c % 4}"), (2, "user", f"own {c % 4}"), (9, None, None))]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (40, None, None, None)]
    df = spark.createDataFrame([(*r, b"p", 1) for r in rows], "conv_id long, turn long, role string, text string, path binary, id int").repartition(4)
    sign = lambda c: c % 5 if c >= 0 else -(-c % 5)  # noqa: E731  the remainder has the sign of c, as in SQL
    own = {c: [t[2:] for t in sorted((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c)] for c in {r[0] for r in rows} - {None}}
    expected = {c: own.get(c - sign(c), [])[:(h := zlib.crc32(str(c).encode()) % 9)] + v[h:] for c, v in own.items()}
    assert in_order(trie_nodes(forked_paths(turn_paths(df)))) == nodes_of(expected)
    assert any(not v for v in expected.values())
    assert trie_nodes(forked_paths(turn_paths(df.limit(0)))).collect() == []


def test_layouts_grow_and_paths_split():
    pick = random.Random(1)
    keys = [bytes([0, a, b]) for a in range(256) for b in range(a % 60)] + [b"", b"\0", b"\0\1"]
    keys += [bytes(pick.choices(range(3), k=pick.randrange(30))) for _ in range(500)]
    pick.shuffle(keys)
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    found, layouts, stack = {}, set(), [(tree.root, b"")]
    while stack:
        node, above = stack.pop()
        path = above + node.prefix
        layouts.add(node.layout)
        kids = list(node.children())
        assert [b for b, _ in kids] == sorted({b for b, _ in kids}) and len(kids) <= node.layout
        assert node.ends or len(kids) > 1 or node is tree.root  # paths are compressed
        assert all(node.child(b) is kid for b, kid in kids)
        if node.ends:
            found[path] = sorted(node.ends)
        stack += [(kid, path + bytes([b])) for b, kid in kids]
    expected = defaultdict(list)
    for i, key in enumerate(keys):
        expected[key].append(i)
    assert found == expected and layouts == {4, 16, 48, 256}


def test_shared_length():
    assert [shared_length(a, b) for a, b in ((b"", b"a"), (b"abc", b"abd"), (b"abc", b"abc"), (b"ab", b"abc"), (b"x", b"y"))] == [0, 2, 3, 2, 0]
