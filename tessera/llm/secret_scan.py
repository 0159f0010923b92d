"""Secret scan (DataFrame functions only): fixed patterns plus windowed entropy.

Base kinds are pattern matches (assign, access, hex).  The method adds ``entropy`` spans:
candidate strings are classified by their characters, a window slides over each, and the
sum of c*log2(c) over its character counts is updated from the two counts that change per
step, so the Shannon entropy of every window costs one update.  The span runs from the
first to the last window that reaches the threshold of the class.  An allow-list
(identifiers, sequences, placeholders) suppresses entropy spans only.

Positions are code points.  Matches and the texts between them give lengths; two-level
prefix sums give offsets, so a text with many matches stays linear.

Edge cases: a null text is empty and has no spans; rows are independent (null or repeated
doc_id do not matter); a very long text is scanned whole, in its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))" r"""["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
#: a maximal run is one match, so the least length can stand in the pattern
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}", r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]


@dataclass(frozen=True)
class EntropyClass:
    """A character class: whole candidates that match ``shape`` (all of it) are scanned
    with windows of ``window`` characters; ``bits`` is the least entropy of a hit."""
    name: str
    shape: str
    window: int
    bits: float


CLASSES = (EntropyClass("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 20, 3.0),
           EntropyClass("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 20, 3.9))
ALLOW = (r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"(?i)abcdefgh|12345678|qwerty|(.)\1{7}",
         r"(?i)example|sample|dummy|placeholder|changeme|your[-_]")
CHUNK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lens: Column) -> Column:
    """Inclusive prefix sums of an int array, in chunks (an append copies its array)."""
    def run(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<long>"), lambda acc, x: F.array_append(
            acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))

    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lens) / CHUNK).cast("int") - 1),
                         lambda c: run(F.slice(lens, c * CHUNK + 1, CHUNK)))
    return F.when(F.size(lens) == 0, F.array().cast("array<long>")).otherwise(
        let(chunks, lambda cs: let(run(F.transform(cs, lambda c: F.element_at(c, -1))), lambda ends: F.flatten(
            F.transform(cs, lambda c, i: F.transform(c, lambda x: x + F.when(
                i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1))))))))


SPAN = "array<struct<start:long,kind:int,end:long>>"


def spans_of(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches of ``pattern``; ``keep(match, index)`` narrows or drops them:
    it gives null or a struct (from, to) relative to the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(hit: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return let(F.transform(hit, lambda m: F.length(m).cast("long")), lambda hl: let(
            prefix_sums(F.zip_with(F.slice(F.transform(gaps, lambda g: F.length(g).cast("long")), F.lit(1), F.size(hl)),
                                   hl, lambda a, b: a + b)),
            lambda ends: F.transform(F.filter(
                F.transform(hit, lambda m, i: F.struct(
                    (F.get(ends, i) - F.get(hl, i)).alias("at"), keep(m, i).alias("k"))),
                lambda s: s["k"].isNotNull()),
                lambda s: F.struct((s["at"] + s["k"]["a"]).alias("start"), F.lit(kind).alias("kind"),
                                   (s["at"] + s["k"]["b"]).alias("end")))))

    return let(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(F.array().cast(SPAN)))


def _whole(ok: Column, m: Column) -> Column:
    return F.when(ok, F.struct(F.lit(0).cast("long").alias("a"), F.length(m).cast("long").alias("b")))


def window_hits(s: Column, window: int, bits: float) -> Column:
    """(a, b) from the first to the last window of ``s`` with at least ``bits`` of
    entropy, or null.  State: the sum of c*log2(c) of the window's counts."""
    def clog(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    least = F.lit(float(bits))
    log_w = F.log2(F.lit(float(window)))

    def count(chars: Column, x: Column) -> Column:
        return F.size(F.filter(chars, lambda y: y == x))

    def scan(chars: Column) -> Column:
        first = F.slice(chars, 1, window)
        # the sum over distinct characters equals the sum of log2(count) over positions
        start = F.aggregate(first, F.lit(0.0), lambda acc, x: acc + F.log2(count(first, x).cast("double")))
        zero = F.struct(start.alias("s"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))

        def hit(state: Column, i: Column, total: Column) -> Column:
            good = log_w - total / float(window) >= least - 1e-9
            return F.struct(total.alias("s"),
                            F.coalesce(state["a"], F.when(good, i.cast("long"))).alias("a"),
                            F.when(good, (i + window).cast("long")).otherwise(state["b"]).alias("b"))

        def step(state: Column, i: Column) -> Column:
            old, new = F.get(chars, i - 1), F.get(chars, i + (window - 1))
            mid = F.slice(chars, i + 1, window - 1)
            return let(F.struct(count(mid, old).alias("o"), count(mid, new).alias("n")), lambda c: hit(
                state, i, state["s"] - clog(c["o"] + 1) + clog(c["o"]) + clog(c["n"] + 1) - clog(c["n"])))

        steps = F.sequence(F.lit(1), F.greatest(F.size(chars) - window, F.lit(1)))
        return let(hit(zero, F.lit(0), start), lambda s0: F.when(F.size(chars) > window, F.aggregate(
            steps, s0, step)).otherwise(s0))

    return let(scan(F.split(s, "")), lambda r: F.when(r["a"].isNotNull(), F.struct(r["a"], r["b"])))


def scan(docs: DataFrame, classes: tuple = CLASSES, allow: tuple = ALLOW) -> DataFrame:
    """(doc_id, spans): spans are structs (start, kind, end) by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))

    def entropy(m: Column, i: Column) -> Column:
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | m.rlike(p)
        out = F.lit(None)
        for c in reversed(classes):
            out = F.when(m.rlike(c.shape), window_hits(m, c.window, c.bits)).otherwise(out)
        return F.when(~allowed, out)

    whole = {
        "assign": let(values, lambda v: spans_of(text, ASSIGN, 0, lambda m, i: _whole(F.length(F.get(v, i)) >= 8, m))),
        "access": spans_of(text, ACCESS, 1, lambda m, i: _whole(F.lit(True), m)),
        "hex": spans_of(text, HEX, 2, lambda m, i: _whole(F.lit(True), m)),
        "entropy": spans_of(text, CANDIDATE, 3, entropy)}
    found = docs.select("doc_id", *[e.alias(f"s_{k}") for k, e in whole.items()])
    return found.select("doc_id", F.array_sort(F.concat(*[F.col(f"s_{k}") for k in whole])).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
