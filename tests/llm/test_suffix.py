"""Merged transforms against sorted suffixes; removed bytes against all windows."""

import hashlib
import random

import numpy as np

from tessera.llm import suffix_dedup as sd


def test_merge_sorts_suffixes():
    r = random.Random(1)
    shards = [sorted(bytes(r.choices(b"abc", k=r.randint(1, 9))) for _ in range(r.randint(1, 5))) for _ in range(3)]
    parts = [sd.transform(s) for s in shards]
    z, common = sd.merge([b for b, _ in parts], 4)
    suffixes = []
    for s, (_, order) in zip(shards, parts):
        flat = b"\0".join([*s, b""])
        suffixes.append(iter([(flat[i:].split(b"\0")[0] + b"\0")[:4] for i in order]))
    got = [next(suffixes[k]) for k in z]
    heads = [g.split(b"\0")[0] + (b"\0" if b"\0" in g else b"") for g in got]
    assert heads == sorted(heads)
    for i in range(1, len(got)):
        if b"\0" not in got[i] and b"\0" not in got[i - 1]:
            same = next((k for k in range(4) if got[i][k] != got[i - 1][k]), 4)
            assert common[i] == same


def brute(rows, n):
    least = {}
    data = [((d if d is not None else sd.LOWEST), (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - n + 1):
            least[b[i:i + n]] = min(least.get(b[i:i + n], d), d)
    out = []
    for (d, b), (orig, _) in zip(data, rows):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if least[b[i:i + n]] < d:
                gone[i:i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(orig), len(b), sum(gone), bytes(gone).replace(b"\1\0", b"\1 \0").count(b"\0\1") + (gone[:1] == b"\1"),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_against_all_windows(docs_of):
    r = random.Random(3)
    words = lambda k: " ".join(r.choice(["tion", "éa", "the", "of", "ing", "and", f"{r.randint(0, 99)}"]) for _ in range(k))
    shared = [words(r.randint(12, 60)) for _ in range(8)]
    rows = []
    for i in range(150):
        t = words(r.randint(0, 80))
        if i % 2:
            x = r.choice(shared)
            t += x[: r.randint(20, len(x))] + words(5)
        rows.append((r.randint(0, 10 ** 9), t))
    rows += [(7, "x" * 3000), (9, "x" * 70), (11, "y" * 49 + "x" * 60), (3, None), (4, ""), (rows[5][0], rows[5][1]),
             (rows[5][0], shared[0]), (None, shared[1]), (2 ** 40, rows[8][1]), (2 ** 41, rows[8][1]), (2 ** 42, "a\0" * 60), (2 ** 43, "a\0" * 55)]
    for bucket_bytes, hot_strings in ((4 << 20, 1 << 14), (500, 1 << 14), (500, 2)):
        p = sd.Repeats(bucket_bytes=bucket_bytes, hot_strings=hot_strings)
        got = sd.repeats(docs_of(rows, extra=True).repartition(4), p).collect()
        assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == brute(rows, 50)
    assert np.sum([g.n_removed for g in got]) > 2000
    assert sd.repeats(docs_of([])).count() == 0


def test_hot_phrase_is_dealt_anew(docs_of):
    """A third of the documents hold one 28-byte phrase between different neighbours."""
    r = random.Random(8)
    noise = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    tries = noise(20_000)
    at = np.arange(len(tries) - 28)
    low = int(sd.span_hash(sd.prefix(np.frombuffer(tries.encode(), np.uint8)), at, at + 28).argmin())
    hot = tries[low:low + 28]  # the minimizer of every window that holds it
    rows = [(i, noise(90) + (hot if i % 3 == 0 else noise(28)) + noise(r.randint(40, 90))) for i in range(600)]
    rows += [(1000 + i, rows[3 * i][1][60:150]) for i in range(40)] + [(2000, "z" * 1_500_000 + rows[0][1]), (2001, rows[2][1])]
    p = sd.Repeats(bucket_bytes=20_000, hot_strings=60)
    got = sd.repeats(docs_of(rows).repartition(5), p).collect()
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == brute(rows, 50)

    block = sd.Block([d for d, _ in rows[:600]], [len(t) for _, t in rows[:600]],
                     sd._pack("".join(t for _, t in rows[:600]).encode()), p)
    h, at = block.minimizers(16)
    two, many = block.spread(h, p.length)
    assert (many > p.hot_strings).sum() == 1 and two[many > p.hot_strings].all()
    shared, most = np.sort(h[two]), []
    for much in (h[:0], h[many > p.hot_strings]):
        _, (bucket, _, n, _) = block.strings(shared, much, 16, p)
        most.append(np.bincount(bucket, weights=n, minlength=16))
    assert most[0].max() > 10 * np.median(most[0]) and most[1].max() < 2 * np.median(most[1])


def test_unparted_intervals_are_those_of_the_merge():
    r = random.Random(4)
    for rounds in (1, 3, 8):
        shards = [sorted({bytes(r.choices(b"ab\0", k=r.randint(1, 20))) for _ in range(12)}) for _ in range(4)]
        bwts, orders = zip(*map(sd.transform, shards))
        z, common = sd.merge(list(bwts), rounds)
        base, seen, want = np.cumsum([0] + [len(b) for b in bwts]), [0] * 4, []
        ends = [np.cumsum([len(x) + 1 for x in s]) - 1 for s in shards]
        for i, k in enumerate(z):
            if common[i] < rounds:
                want.append(set())
            at = orders[k][seen[k]]
            if ends[k][np.searchsorted(ends[k], at)] - at >= rounds:  # a whole window
                want[-1].add(int(base[k]) + seen[k])
            seen[k] += 1
        rows, heads = sd.unparted(bwts, rounds)
        got = [set(x.tolist()) for x in np.split(rows, heads[1:])]
        assert sorted(map(sorted, got)) == sorted(sorted(w) for w in want if len(w) > 1)


def test_blocks_travel_in_bundles(docs_of, monkeypatch):
    """The exchanges have a row for a bundle of blocks and a bucket, not for every block and bucket."""
    r = random.Random(5)
    noise = lambda k: "".join(r.choices("abcdefgh ", k=k))
    rows = [(i, noise(600_000)) for i in range(12)]
    rows += [(100 + i, noise(30) + "#" + rows[i][1][1000:1000 + 40 * i] + "#" + noise(500_000)) for i in range(12)]
    staged, kept = sd.staged, {}
    monkeypatch.setattr(sd, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    p = sd.Repeats(bucket_bytes=1 << 20)
    got = sd.repeats(docs_of(rows).repartition(1), p).select("doc_id", "n_removed").collect()
    assert {g.doc_id: g.n_removed for g in got if g.n_removed > 0} == {
        100 + i: 40 * i for i in range(2, 12)}
    assert kept["blocks"].count() == 3  # 24 documents, a block each
    assert kept["least"].selectExpr("sum(size(lows))").first()[0] <= 3 * 13
