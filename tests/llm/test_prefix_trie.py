"""The conversation trie against plain Python, on small tables and on the registered query."""

import hashlib
import random
import zlib
from collections import defaultdict

from tessera.llm.prefix_trie import trie
from tessera.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, i int, name string, h int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    # prefixes as paths of child links, so that deep ones stay cheap
    child, up, last, members, ending = {}, [None], [b""], [[]], defaultdict(list)
    for c in sorted(new):
        v = 0
        members[0].append(c)
        for turn in new[c]:
            if (v, turn) not in child:
                child[v, turn] = len(up)
                up.append(v)
                last.append(turn[1].encode())
                members.append([])
            v = child[v, turn]
            members[v].append(c)
        ending[v].append(c)
    if not new:
        return []
    depth, kids = [0] * len(up), [0] * len(up)
    for v in range(1, len(up)):
        depth[v], kids[up[v]] = depth[up[v]] + 1, kids[up[v]] + 1
    leaves, saved = [int(not k) for k in kids], [(len(m) - 1) * len(x) for m, x in zip(members, last, strict=True)]
    for v in range(len(up) - 1, 0, -1):
        leaves[up[v]] += leaves[v]
        saved[up[v]] += saved[v]
    return sorted(((members[v][0], depth[v], None if v == 0 else members[up[v]][0], len(members[v]), kids[v], leaves[v],
                    saved[v], hashlib.sha256(",".join(map(str, ending[v])).encode()).hexdigest())
                   for v in range(len(up))), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_trie_against_plain_python(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, ""]))
            for c in range(0, 90) if c not in (10, 20) for t in range(r.choice([1, 3, 9, 17]))]
    rows += [(7, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "a", "tie"),
             (None, 0, "user", "lost"), (95, 0, None, None), (96, 0, "r" * 70, "t" * 70), (96, 0, "r" * 70, "t" * 80)]
    rows += [(50, t, "user", f"deep {t % 3}") for t in range(20, 600)]  # one conversation with most turns
    rows += [(55, t, "user", f"deep {t % 3}") for t in range(20, 300)] + [(60, 0, "user", "x" * 1_200_000)]
    df = spark.createDataFrame([(*x, 1, "n", 2) for x in rows], SCHEMA).repartition(5)
    assert rows_of(trie(df)) == brute(rows)


def test_empty_and_single(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    lost = [(None, 0, "user", "x")]
    assert trie(spark.createDataFrame([(*x, 1, "n", 2) for x in lost], SCHEMA)).count() == 0
    # crc32("3") % 9 = 4: its one turn goes, its base is absent, so only the root is left
    one = [(3, 0, "user", "x")]
    assert zlib.crc32(b"3") % 9 > 0
    assert rows_of(trie(spark.createDataFrame([(*x, 1, "n", 2) for x in one], SCHEMA))) == brute(one)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op12_conversation_trie(spark, d)) == brute(rows)
