"""Packing: exact token round trip, gapless sequences, near the lower bound; the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np

from tessera.llm import packing as pk


def test_cut():
    assert pk.cut(5, 4) == [(0, 1), (1, 4)] and pk.cut(8, 4) == [(0, 4), (4, 4)] and pk.cut(3, 4) == [(0, 3)]
    assert pk.cut(4, 4) == [(0, 4)] and pk.cut(1, 4) == [(0, 1)]


def test_knapsack_against_brute_force():
    r, rng = random.Random(1), np.random.default_rng(1)
    for _ in range(50):
        lengths = np.array(sorted(r.sample(range(1, 12), 4)))
        price = np.array([r.random() for _ in lengths])
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - x] + p for x, p in zip(lengths, price) if x <= c)])
        table, dense = pk.knapsack(lengths, price, 20)
        assert np.allclose(table, best[::-1])
        left = np.zeros(20)
        left[lengths - 1] = 99
        for loss in (1e-12, 0.2):
            got = pk.draw(table, dense, left, loss, rng)
            assert sum(x * a for x, a in got.items()) <= 20
            assert sum(dense[x - 1] * a for x, a in got.items()) >= (1 - loss) * best[20] - 1e-9


def fewest(pieces, cap):
    """The optimum by search over the sequences that each piece can go to."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in {room: k for k, room in enumerate(rooms) if room >= pieces[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, cap - pieces[i]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best


def test_against_the_optimum():
    r = random.Random(7)
    over = 0
    for _ in range(40):
        cap = r.randint(8, 20)
        pieces = [r.randint(1, cap) for _ in range(r.randint(1, 11))]
        used = sum(k for _, k in pk.configurations({x: pieces.count(x) for x in pieces}, cap))
        over += used - fewest(pieces, cap)
        assert used <= fewest(pieces, cap) + 1
    assert over <= 4


def test_encoder_against_the_tokenizer():
    r = random.Random(9)
    path = str(pk.tokenizer_path())
    bits = [" ", "  ", "\n", "\t", "a", "b'", "é", "\u00a0", "\u180e", "\u200b", "\u2003", "1", "!", "日", "\x1c", "\x85",
            "<|endoftext|>", "'s", " x", "😀"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(3000)] + ["", "word " * 400_000, "x" * 60_000]
    want = [np.array(e.ids, "<u4").tobytes() for e in pk._tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    assert pk.Encoder(path).encode(texts) == want
    assert pk.Encoder(path, keep=50, short=2, block=7).encode(texts[:3000]) == want[:3000]


def test_plan_holds_every_piece_once():
    r = random.Random(2)
    for cap, n, scale in ((50, 300, 1), (50, 40, 1000), (200, 2000, 3), (10, 0, 1)):
        hist = defaultdict(int)
        for _ in range(n):
            hist[r.choice([r.randint(1, cap), r.randint(1, cap // 3)])] += r.randint(1, scale)
        configs = pk.configurations(dict(hist), cap)
        held = defaultdict(int)
        for c, k in configs:
            assert sum(x * a for x, a in c.items()) <= cap and k > 0
            for x, a in c.items():
                held[x] += a * k
        assert held == hist
        used = sum(k for _, k in configs)
        bound = max(-(-sum(x * c for x, c in hist.items()) // cap), sum(c for x, c in hist.items() if 2 * x > cap))
        assert used <= 1.03 * bound + 2, (used, bound)


def test_documents(docs_of):
    r = random.Random(3)
    texts = [None, "", "a", "<|endoftext|> x"] + [" ".join(r.choices(["the", "ä", "zzq", "7"], k=r.randint(0, 900))) for _ in range(120)]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[6]), (500, "word " * 9000)]
    tok = pk._tokenizer(str(pk.tokenizer_path()))
    got = pk.pack(docs_of(rows, extra=True), capacity=256).collect()
    ids = {t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts + ["word " * 9000]}
    want = sorted((str(d), n, s, size, zlib.crc32(ids[t][s:s + size].tobytes()))
                  for d, t in rows for n, (s, size) in enumerate(pk.cut(len(ids[t]), 256)))
    assert sorted((str(g.doc_id), g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    seqs = defaultdict(list)
    for g in got:
        seqs[g.sequence_id].append((g.offset, g.length))
    for places in seqs.values():
        at = 0
        for o, size in sorted(places):
            assert o == at
            at += size
        assert at <= 256
    assert len(seqs) <= 1.05 * -(-sum(g.length for g in got) // 256) + 1
    assert pk.pack(docs_of([])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = cp.staged(stage(spark, docs, d), name)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    last = cp.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_program_near_its_dual_bound():
    r = random.Random(5)
    for _ in range(50):
        lengths = np.array(sorted(r.sample(range(1, 12), 4)))
        price, most = np.array([r.random() for _ in lengths]), np.array([r.randint(1, 4) for _ in lengths])
        best = [0.0] * 21
        for x, y, m in zip(lengths, price, most):
            best = [max(best[c - k * x] + k * y for k in range(m + 1) if k * x <= c) for c in range(21)]
        got = pk.bounded_configuration(lengths, price, most, 20)
        assert sum(x * a for x, a in got.items()) <= 20 and all(a <= most[list(lengths).index(x)] for x, a in got.items())
        assert abs(sum(price[list(lengths).index(x)] * a for x, a in got.items()) - best[20]) < 1e-9
    hist = defaultdict(int, {1: 3})
    for _ in range(300):
        hist[int(r.lognormvariate(6.2, 1)) % 2048 + 1] += 1
    hist = {x: 20 * n for x, n in hist.items()}
    cover, bound = pk.fractional(hist, 2048, pk.Program(tail=0))
    held = defaultdict(float)
    for c, w in cover:
        assert sum(x * a for x, a in c.items()) <= 2048
        for x, a in c.items():
            held[x] += a * w
    assert all(n - 1e-6 <= held[x] <= n + 1e-6 for x, n in hist.items())
    assert bound <= sum(w for _, w in cover) <= 1.01 * bound
    configs = pk.configurations(hist, 2048)
    assert sum(k for _, k in configs) <= 1.005 * bound + 1
    # the plan is the program's: most sequences are filled configurations of its own
    plain = {tuple(sorted(c.items())) for c, _ in pk._best_fit(dict(hist), 2048)}
    own = sum(k for c, k in configs if tuple(sorted(c.items())) not in plain)
    assert own > 0.5 * sum(k for _, k in configs)
