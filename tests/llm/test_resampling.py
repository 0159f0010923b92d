"""Importance resampling against plain Python, on small tables and on the registered query."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tessera.llm.queries import op11_importance_resampling
from tessera.llm.resampling import Resampling, cutoff, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, bench):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in bench for f in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_draw_against_plain_python(spark, docs_of):
    r = random.Random(4)
    vocab = ["Ärger", "x1", "İb", "Zoo", "k_l", "日本", "a", "Q"]
    docs = [(i, r.choice([" ", "-", "\n\x00 "]).join(r.choices(vocab, k=r.randint(0, 60)))) for i in range(700)]
    docs += [(700, None), (701, ""), (702, "--"), (None, docs[5][1]), (None, None), (8, docs[8][1]), (8, docs[8][1])]
    docs += [(9000, "Word " * 300_000), (9001, "w" * 1_500_000 + " tail")]
    bench = ["zoo x1 zoo", None, "", "日本 a a a"]
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    small = Resampling(group_rows=16, block=50)
    assert rows_of(resample(docs_of(docs, extra=True).repartition(5), target, small)) == brute(docs, bench)
    assert rows_of(resample(docs_of(docs[:30]), target.limit(0))) == brute(docs[:30], [])
    assert resample(docs_of([]), target).count() == 0


def test_cutoff_is_exact(spark):
    r = random.Random(6)
    rows = [(r.choice([5, 5, 5, r.randint(-99, 99)]), r.randint(0, 9), r.randint(0, 2), i) for i in range(2000)]
    keys = spark.createDataFrame(rows, "score long, id long, n_features long, row long").repartition(7)
    order = sorted(rows, key=lambda k: (-k[0], *k[1:]))
    for want in (1, 700, 2000):
        assert cutoff(keys, want, 50) == order[want - 1]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert rows_of(op11_importance_resampling(spark, d)) == brute(docs, bench)
