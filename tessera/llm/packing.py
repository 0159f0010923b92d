"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most ``capacity``.  Only the histogram of piece lengths
(at most ``capacity`` counts, whatever the corpus) reaches the driver.  The program "cover
every length's count with as few configurations (multisets of lengths that fit) as
possible" has prices of lengths as its dual, and any prices bound the number of sequences
from below.  It is solved by multiplicative weights: a length's price falls with the share
of its count already covered, a knapsack dynamic program over the capacity finds the
configurations of greatest price, and small steps cover a part of the scarcest length of
one such configuration after another.  Rounding takes whole multiples of the well-filled
configurations, then those of largest fraction that still fit the counts, and packs what is
left best-fit decreasing.

The plan says which ranks of a length go to which sequences; pieces get ranks per length in
bounded cells and look their place up by binary search in the plan, which is as bounded as
the histogram.

Edge cases: a null or empty text is the single end token; repeated rows and null doc_id are
packed one by one; a text of any length is cut into whole pieces, the first may be shorter;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.numtext import buffers, slices
from tessera.llm.tables import rank_within, staged

CAPACITY = 2048

# fixed values: the word pattern of the byte-level tokenizer, over characters whose class
# (letter, digit, white space, other) is beyond doubt
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\u00a1\u00a7\u00ab\u00b7\u00bb\u00bf\u2010-\u2027"
PLAIN = re.compile(f"[\t\n\r\x20-\x7e{_LETTERS}{_SIGNS}]*")
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")
#: a space before one of these, or at the end, may belong to what comes before it
LOOSE = frozenset(["", *(chr(c) for c in range(0x3001) if chr(c).isspace()), "\u180e", "\u200b", "\ufeff"])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n if n <= capacity else n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


class Encoder:
    """Token ids of texts as bytes, from the ids of their words.

    Texts of plain characters are cut into words by the tokenizer's own pattern, other texts
    at each space that a non-space follows, where a new word always starts, and then part by
    part; a part with other characters counts as one word.  New words go through the tokenizer, one call
    for about ``block`` characters of texts.  Ids of words are kept up to ``keep`` of them
    and forgotten together beyond that, which costs time only."""

    def __init__(self, path: str, keep: int = 500_000, short: int = 40, block: int = 1 << 20) -> None:
        self.tok, self.keep, self.short, self.block = _tokenizer(path), keep, short, block
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 8192):
            some = words[at:at + 8192]
            for x, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[x] = array("I", e.ids).tobytes()

    def _blocks(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """Lists of (text number, stretch of it) of about ``block`` characters."""
        held, size = [], 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = text.find(" ", at + self.block - size)
                while end >= 0 and text[end + 1:end + 2] in LOOSE:
                    end = text.find(" ", end + 1)
                end = len(text) if end < 0 else end
                held.append((i, text[at:end]))
                size, at = size + end - at, end
                if size >= self.block:
                    yield held
                    held, size = [], 0
        yield held

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out: list[list[bytes]] = [[] for _ in texts]
        for held in self._blocks(texts):
            words = [_words(x) for _, x in held]
            new = list(set(chain.from_iterable(words)).difference(self.known))
            self._learn(new)
            for (i, _), w in zip(held, words, strict=True):
                out[i].append(b"".join(map(self.known.__getitem__, w)))
            if len(self.known) > self.keep:
                self.known.clear()
            for x in new:
                if len(x) > self.short:
                    self.known.pop(x, None)
        return [b"".join(x) for x in out]


def _words(text: str) -> list[str]:
    if PLAIN.fullmatch(text):
        return WORD.findall(text)
    parts = text.split(" ")
    parts[1:] = [" " + x for x in parts[1:]]
    out, start = [], 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or parts[i][1:2] not in LOOSE:
            x = parts[start] if i == start + 1 else "".join(parts[start:i])
            out += WORD.findall(x) if PLAIN.fullmatch(x) else [x]
            start = i
    return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(str(path or tokenizer_path()))
        for b in batches:
            _, off = buffers(b.column("text"))
            for i, j in slices(off):
                row, out = [], []
                for r, x in enumerate(encoder.encode([x or "" for x in b.column("text").slice(i, j - i).to_pylist()])):
                    ids = x + last
                    for n, (s, size) in enumerate(cut(len(ids) // 4, capacity)):
                        row.append(r)
                        out.append((n, s, size, zlib.crc32(ids[4 * s:4 * (s + size)])))
                cols = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i).take(pa.array(row, pa.int64())),
                     *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best price of each room c at ``capacity - c``, and the price
    of length x at x - 1.  Both lie so that a room's choices are one slice."""
    dense = np.full(capacity, -np.inf)
    dense[lengths - 1] = price
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[capacity - c] = max((best[capacity - c + 1:] + dense[:c]).max(), best[capacity - c + 1])
    return best, dense


def draw(best: np.ndarray, dense: np.ndarray, left: np.ndarray, loss: float, rng: np.random.Generator) -> Counter:
    """A random configuration of at least 1 - ``loss`` of the best price, as far as what is
    ``left`` of the lengths (x at x - 1) allows."""
    capacity = len(dense)
    room, spare, out, open_ = capacity, loss * best[0], Counter(), left > 0
    while room > 0:
        lost = best[capacity - room] - (best[capacity - room + 1:] + dense[:room])
        choice = np.flatnonzero((lost <= spare) & open_[:room])
        if not len(choice):
            break
        j = int(choice[rng.integers(len(choice))])
        spare -= max(lost[j], 0.0)
        out[j + 1] += 1
        room -= j + 1
        if out[j + 1] + 1 > left[j]:
            open_[j] = False
    return out


def bounded_configuration(lengths: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int) -> Counter:
    """The same with at most ``most`` copies of a length, in parts of 1, 2, 4 ... copies."""
    best, parts, used = np.zeros(capacity + 1), [], []
    for x, y, m in zip(lengths.tolist(), price.tolist(), np.minimum(most, capacity // lengths).tolist(), strict=True):
        n = 1
        while m:
            n, m = min(n, m), m - min(n, m)
            with_ = best[:-n * x] + n * y
            better = with_ > best[n * x:]
            best[n * x:][better] = with_[better]
            parts.append((x, n))
            used.append(better)
            n *= 2
    out, c = Counter(), capacity
    for (x, n), better in zip(reversed(parts), reversed(used), strict=True):
        if c >= n * x and better[c - n * x]:
            out[x] += n
            c -= n * x
    return out


@dataclass(frozen=True)
class Program:
    """``step`` is the share of the scarcest length that one step covers (one sequence at
    least), ``draws`` the steps from one knapsack, ``loss`` the price that a step may lack
    of the best, ``tail`` the share of the tokens that is left to best-fit with what
    rounding leaves, ``fill`` the fill from which a configuration is rounded."""
    step: float = 0.25
    draws: int = 128
    loss: float = 2e-3
    rate: float = 1.0
    tail: float = 0.01
    fill: float = 0.998
    seed: int = 1


def fractional(hist: dict[int, int], capacity: int, p: Program = Program()) -> tuple[list[tuple[Counter, float]], float]:
    """A cover of the histogram, but for its tail, by configurations with weights, and the
    dual bound: by the best of the prices met, no cover has fewer configurations."""
    rng = np.random.default_rng(p.seed)
    size = np.arange(1, capacity + 1)
    need = np.zeros(capacity)
    need[np.array(list(hist), np.int64) - 1] = list(hist.values())
    left, out, bound = need.copy(), [], 0.0

    def add(config: Counter) -> None:
        at, mult = np.array(list(config)) - 1, np.array(list(config.values()), float)
        most = (left[at] / mult).min()
        amount = min(most, max(p.step * most, 1.0))
        after = left[at] - amount * mult
        left[at] = np.where(after < 1e-9 * need[at], 0.0, after)
        out.append((config, float(amount)))

    while left @ size > p.tail * (need @ size):
        open_ = np.flatnonzero(left)
        price = size[open_] / capacity * np.exp(-p.rate * (1 - left[open_] / need[open_]))
        best, dense = knapsack(size[open_], price, capacity)
        bound = max(bound, float(need[open_] @ price) / best[0])
        drawn = len(out)
        for _ in range(p.draws):
            config = draw(best, dense, left, p.loss, rng)
            if sum(a * dense[x - 1] for x, a in config.items()) < (1 - p.loss) * best[0] or any(
                    a > max(left[x - 1], 1) for x, a in config.items()):
                break
            add(config)
        if len(out) == drawn:  # too little is left of some lengths: the best that there is
            open_ = np.flatnonzero(left)
            add(bounded_configuration(size[open_], dense[open_], np.maximum(1, np.ceil(left[open_] - 1e-6)).astype(int), capacity))
    return out, bound


def _best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing by counts: sequences of equal content are one entry, so the work
    grows with the number of lengths and not with that of the pieces."""
    free: list[int] = []  # the rooms there are, ascending
    bins: dict[int, list[tuple[Counter, int]]] = {capacity: []}

    def put(room: int, config: Counter, times: int) -> None:
        if times:
            if room not in bins or (not bins[room] and room < capacity):
                bins[room] = []
                insort(free, room)
            bins[room].append((config, times))

    for x in sorted(hist, reverse=True):
        n = hist[x]
        while n:
            k = bisect_left(free, x)
            room = free[k] if k < len(free) else capacity
            # best fit fills a sequence with all pieces of a length that it takes before the next
            config, times = bins[room].pop() if k < len(free) else (Counter(), n)
            if k < len(free) and not bins[room]:
                free.pop(k)
            a = room // x
            whole = min(times, n // a)
            put(room - a * x, config + Counter({x: a}), whole)
            n -= whole * a
            if whole < times:  # fewer pieces are left than one more sequence would take
                if n:
                    put(room - n * x, config + Counter({x: n}), 1)
                if config:
                    put(room, config, times - whole - bool(n))
                n = 0
    return [b for r in bins.values() for b in r]


def configurations(hist: dict[int, int], capacity: int, p: Program = Program()) -> list[tuple[Counter, int]]:
    """Whole configurations with multiplicities that hold every piece exactly once: the
    rounded program, and what it leaves by best-fit decreasing."""
    left = {x: n for x, n in hist.items() if n}
    out = []
    if left.get(capacity):
        out.append((Counter({capacity: 1}), left.pop(capacity)))
    cover, _ = fractional(left, capacity, p)

    def take(config: Counter, times: int) -> None:
        times = min([times, *(left[x] // a for x, a in config.items())])
        if times > 0:
            out.append((config, times))
            for x, a in config.items():
                left[x] -= a * times

    full = [(c, w) for c, w in cover if sum(x * a for x, a in c.items()) >= p.fill * capacity]
    for config, w in full:
        take(config, int(w + 1e-9))
    for config, _ in sorted(full, key=lambda c: -(c[1] % 1)):
        take(config, 1)
    return out + _best_fit({x: n for x, n in left.items() if n}, capacity)


def plan(hist: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, first offset), sorted
    by length and rank: ranks from the first on fill the sequences one after another."""
    rows, rank, seq = [], Counter(), 0
    for config, times in configurations(hist, capacity):
        at = 0
        for x, a in config.items():
            rows.append((x, rank[x], seq, a, at))
            rank[x] += a * times
            at += a * x
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces with sequence_id and offset."""
    parts = staged(pieces(docs, capacity, path), "pieces")
    hist = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(hist, capacity)
    kind = parts.schema["doc_id"].dataType.simpleString()
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = rank_within(parts.withColumn("h", h), ["length"], ["h", "doc_id", "piece", "start", "ids_crc32"],
                         "rank", F.pmod(h, F.lit(1024)).cast("int"))
    key, cols = (table[:, 0] << 44) + table[:, 1], list(parts.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            n = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in cols), pa.array(row[:, 2] + n // np.maximum(row[:, 3], 1)),
                 pa.array(row[:, 4] + n % np.maximum(row[:, 3], 1) * length)],
                names=[*cols, "sequence_id", "offset"])

    return ranked.select(*parts.columns, "rank").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
