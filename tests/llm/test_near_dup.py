"""Components against all-pairs Jaccard on whole sets."""

import random
import re

from tessera.llm.near_dup import MinHash, dedup, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([1, 2, 3, 5, 12, 40, 150]))
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((n, r.choice([" ", "\n"]).join(w).title() if r.random() < .2 else " ".join(w)))
            n += 1
    chain = [f"c{i}" for i in range(120)]  # links in a row: ends are not similar
    for s in range(0, 60, 5):
        rows.append((n, " ".join(chain[s:s + 60])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[4][1]), (4, rows[4][1]), (None, rows[9][1]), (None, "alone here now")]
    r.shuffle(rows)
    return rows


def key(x):
    return x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0


def test_against_all_pairs(docs_of):
    for seed, k in ((1, 2), (2, 5)):
        rows = corpus(seed)
        got = near_duplicates(docs_of(rows, extra=True), MinHash(shingle=k)).collect()
        assert sorted([(g.doc_id, g.n_shingles, g.component_id) for g in got], key=key) == sorted(brute(rows, k), key=key)
        assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_dedup_keeps_columns_and_one_of_each(docs_of):
    rows = corpus(3)
    docs = docs_of(rows, extra=True)
    out = dedup(docs)
    assert out.columns == docs.columns
    want = sorted(d for d, _, c in brute(rows, 5) if d is not None and d == c)
    assert sorted(x.doc_id for x in out.collect() if x.doc_id is not None) == sorted(
        [*want, *[d for d, t in rows if d is not None and not shingles(t, 5) and d not in want]])
    assert near_duplicates(docs_of([])).count() == 0
    assert near_duplicates(docs_of([(1, None), (2, "")])).count() == 2


def test_a_bucket_of_unlike_texts(docs_of):
    """Few rows per band force large buckets of texts that do not link to the centre."""
    r = random.Random(9)
    common = [f"x{i}" for i in range(30)]
    rows = []
    for g in range(12):
        own = [f"g{g}_{i}" for i in range(30)]
        for c in range(3):
            w = common + own
            w[r.randrange(60)] = f"e{c}"
            rows.append((g * 3 + c, " ".join(w)))
    got = near_duplicates(docs_of(rows), MinHash(shingle=2, bins=16, rows=1)).collect()
    assert sorted((g.doc_id, g.n_shingles, g.component_id) for g in got) == sorted(brute(rows, 2))


def test_another_text_of_a_repeated_id_stays(docs_of):
    near = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(near)), (2, " ".join([*near[:-1], "end"])), (2, "a clean text of some other words here")]
    assert sorted(r.text for r in dedup(docs_of(rows)).collect()) == sorted([rows[0][1], rows[2][1]])
