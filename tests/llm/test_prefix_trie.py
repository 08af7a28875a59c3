import hashlib
import zlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from attesta.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key long"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = lambda x: sum(len(q) == len(x) + 1 and q[: len(x)] == x for q in nodes)
        ends = sorted(c for c in members if len(paths[c]) == len(p))
        out.append(
            (
                min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children(p),
                sum(not children(q) for q in below), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def talks():
    """Conversations with common beginnings, copies, a long one, ties, nulls and repeated rows."""
    rows = []
    for c in [*range(0, 24), 100, 101, 107, 205, 300, 7000]:
        for t in range(c % 9):
            rows.append((c, t, "user" if t % 2 else "bot", f"turn {t if c % 4 else c % 3} é", "x", 1))
    rows += [(400 + i, t, "user", f"same {t}", "x", 1) for i in range(30) for t in range(3)]
    rows += [(500, t, "user", f"long {t % 7}", "x", 1) for t in range(60)]
    rows += [(500 + i, t, "user", f"long {t % 7}", "x", 1) for i in (3, 4, 9) for t in range(40 + i)]
    rows += [(601, 0, None, "a", None, None), (601, 0, "", None, None, None), (601, None, "user", "", None, None), (601, 0, None, "a", None, None)]
    rows += [(None, 0, "user", "nobody", None, None), (602, 3, "x", "", "x", 1)]
    return rows


def test_matches_brute_force(spark):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert rows_of(prefix_trie.conversation_trie(df)) == want
    # one sequence or a few in each double array: most nodes are then shared between shards
    paths = prefix_trie.rebuilt(df)
    for limit in (0, 300):
        assert rows_of(prefix_trie.trie_nodes(paths, shard_bytes=limit)) == want


def test_empty_and_single(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, 0, "user", "hi", None, None)]
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)


def test_many_copies_are_few_rows(spark):
    paths = spark.range(5000).selectExpr("id AS conv_id", "unhex('00') AS seq")
    assert prefix_trie.sequences(paths).count() == 5


@given(st.lists(st.lists(st.integers(0, 12), max_size=5).map(tuple), max_size=40, unique=True))
def test_double_array(found):
    rows = [list(r) for r in sorted(found)]
    trie, order = prefix_trie.pack(rows)
    prefixes = {tuple(r[:d]) for r in rows for d in range(len(r) + 1)} | {()}
    assert len(order) == len(prefixes) and order[0] == 0
    seen = set()
    for p in prefixes:
        slot = 0
        for code in p:
            slot = trie.child(slot, code)
            assert slot >= 0
        seen.add(slot)
        assert [c for c in range(14) if trie.child(slot, c) >= 0] == sorted({q[len(p)] for q in prefixes if len(q) == len(p) + 1 and q[: len(p)] == p})
    assert seen == set(order)
    place = {s: i for i, s in enumerate(order)}
    assert all(place[trie.check[s]] < place[s] for s in order[1:])
