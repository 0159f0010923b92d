"""Line alignment and benchmark containment against plain Python."""

import random
import re

from tessera.llm import decontaminate as dc
from tessera.llm import line_dedup as ld

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_patience():
    assert ld.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert ld.patience([1, 2, 9, 3, 4], [7, 2, 3, 8, 4]) == [(1, 1), (3, 2), (4, 4)]
    assert ld.patience([], [1]) == [] and ld.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 9) for _ in range(r.randint(0, 12))] for _ in "ab")
        got = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got))
        assert all(p[1] < q[1] for p, q in zip(got, got[1:]))


def brute_lines(rows, p=ld.Align()):
    """Same rules over all pairs of documents."""
    docs = {}
    for d, t in rows:
        if WORD.search(t or ""):
            docs[(-(1 << 63) if d is None else d, t)] = t.split("\n")
    from functools import cmp_to_key
    words = lambda x: len(WORD.findall(x))
    holders = {}
    for k, ls in docs.items():
        for x in {x for x in ls if words(x) >= p.seed_words}:
            holders.setdefault(x, []).append(k)
    assert cmp_to_key
    out = {}
    for k, ls in docs.items():
        partners = {}
        for x in {x for x in ls if words(x) >= p.seed_words}:
            first = min(h[0] for h in holders[x])
            first = next(h for h in holders[x] if h[0] == first)
            if first != k:
                partners.setdefault(first, []).append(words(x))
        gone = set()
        for f, shared in partners.items():
            if sum(shared) >= p.block_words:
                for s, e in ld.common_runs(docs[f], ls, [words(x) for x in ls], p.block_words):
                    gone |= set(range(s, e))
        out[k] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def corpus():
    r = random.Random(8)
    line = lambda: " ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(1, 9)))
    shared = [[line() for _ in range(5)] for _ in range(6)]
    rows = []
    for i in range(120):
        ls = [line() for _ in range(r.randint(1, 8))]
        if i % 2:
            at = r.randint(0, len(ls))
            ls[at:at] = r.choice(shared)[: r.randint(1, 5)]
        ls.insert(r.randint(0, len(ls)), "Licensed under some terms here")
        rows.append((i, "\n".join(ls)))
    rows += [(200 + i, "\n".join(["copy of one text", "with many lines here", "and a tail"])) for i in range(80)]
    rows += [(300, None), (301, ""), (302, "\n \n"), (303, rows[5][1] + "\n"), (None, rows[7][1]), (5, rows[5][1])]
    return rows


def test_lines_against_all_pairs(docs_of):
    rows = corpus()
    docs = docs_of(rows, extra=True)
    want = brute_lines(rows)
    got = ld.rewrite(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        key = (-(1 << 63) if g.doc_id is None else g.doc_id, g.text)
        assert g["__kept"] == want.get(key, g.text), g.doc_id
    assert sum(g["__removed"] for g in got) > 100
    out = ld.dedup(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    assert {i for i in range(201, 280)}.isdisjoint(left) and {200, 300, 301, 302} <= set(left)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left.values())
    assert ld.rewrite(docs_of([])).count() == 0


def sh(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_items_against_all_pairs(spark, docs_of):
    r = random.Random(6)
    words = lambda n: [f"v{r.randint(0, 900)}" for _ in range(n)]
    items = [(i, " ".join(words(r.choice([5, 6, 15, 40, 90, 300])))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "only three words"), (3, items[3][1]), (None, items[4][1])]
    rows = []
    for i in range(150):
        w = words(r.choice([3, 30, 400, 3000]))
        if i % 3 == 0:
            it = r.choice(items[:25])[1].split()
            for _ in range(r.randint(0, len(it) // 18)):
                it[r.randrange(len(it))] = "edited"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() for x in it]
        rows.append((i, r.choice([" ", "\n "]).join(w)))
    rows += [(200, None), (201, ""), (202, "Only three\twords"), (7, rows[7][1]), (0, rows[0][1]), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(g.doc_id, g.item_id, g.n_item, g.n_shared) for g in dc.contaminated(docs_of(rows, extra=True), bench).collect()}
    want = set()
    for d, t in rows:
        for i, x in items:
            a, b = sh(x), sh(t)
            if a and 100 * len(a & b) >= 80 * len(a):
                want.add((d, i, len(a), len(a & b)))
    assert got == want and len(want) > 30
    docs = docs_of(rows, extra=True)
    out = dc.clean(docs, bench)
    assert out.columns == docs.columns
    assert {x.doc_id for x in out.collect()} == {d for d, _ in rows} - {w[0] for w in want}
    assert dc.contaminated(docs_of([]), bench).count() == 0
    assert dc.clean(docs, bench.filter("false")).count() == len(rows)


def test_a_long_frequent_line_goes_from_every_later_document(docs_of):
    lines = ["one line of six words here", "another line of some seven words here"]
    rows = [(-2, f"holder of {lines[0]}\n{lines[0]}\nend"), (-1, f"holder\n{lines[1]}\nend of it")]
    rows += [(i, f"own {i}\n{lines[0]}\nmore {i}\n{lines[1]}\ntail {i}") for i in range(60)]
    got = {r.doc_id: r for r in ld.rewrite(docs_of(rows)).collect()}
    assert all(r["__removed"] == (2 if d >= 0 else 0) for d, r in got.items())
    assert got[7]["__kept"] == "own 7\nmore 7\ntail 7"


def test_a_passage_repeated_within_one_document(docs_of):
    r = random.Random(3)
    for _ in range(300):  # the run found is common, and none is missed
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in "ab")
        words, least = [(x * 7) % 4 for x in b], r.randint(1, 6)
        runs = [(i, j, n) for i in range(len(a)) for j in range(len(b)) for n in range(1, 15)
                if a[i:i + n] == b[j:j + n] and len(b) - j >= n <= len(a) - i and sum(words[j:j + n]) >= least]
        got = ld.common_run(a, b, words, least)
        assert (got is None) == (not runs) and (got is None or got in runs)
    p = "first line of it\nand a second line"
    rows = [(1, f"head\n{p}\nbetween\n{p}\ntail"), (2, f"top\n{p}\nbottom"), (3, f"up\n{p}\nmid\nnew words\nbelow")]
    rows += [(11, "x1\nq passage of five words\ny1"), (12, "x2\nq passage of five words\ny2\nq passage of five words\nz2")]
    got = {g.doc_id: g["__kept"] for g in ld.rewrite(docs_of(rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "top\nbottom" and got[3] == "up\nmid\nnew words\nbelow"
    assert got[12] == "x2\ny2\nq passage of five words\nz2"  # an alignment is one to one


def test_tiny_items_are_always_candidates(spark, docs_of):
    items = [(i, " ".join(f"t{i}_{j}" for j in range(5))) for i in range(40)]
    rows = [(i, " ".join([*(f"a{i}_{j}" for j in range(9)), t, *(f"b{i}_{j}" for j in range(9))])) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(docs_of(rows), bench, dc.Containment(bin_bits=4)).collect()
    assert sorted((g.doc_id, g.item_id) for g in got) == [(i, i) for i in range(40)]
