"""Gap sessionization and session-list operators.

Design for skewed keys: a key (user) may hold a large share of all rows, so the
per-key window of the textbook approach (``lag`` + running ``sum`` over
``partitionBy(key)``) would put that key's rows into one task.  ``sessionize`` splits
each key into time buckets of width ``bucket <= gap``.  Inside such a bucket two
events are less than ``gap`` apart, so a new session can only start at the first event
of a bucket.  The session boundaries therefore follow from a small summary table with
one row per (key, bucket) — count, first and last time — and the big table is shuffled
once, by (key, bucket), for a bounded row_number window.  ``sessionize_window`` keeps the
textbook form (the reference semantics) for checks and small data.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

_UNB = Window.unboundedPreceding


def _order_cols(time_col: str, tiebreak: Iterable[str]) -> list[Column]:
    return [F.col(time_col)] + [F.col(c) for c in tiebreak]


def sessionize_window(df: DataFrame, key: str, time_col: str, gap: float) -> DataFrame:
    """W1-W4 exactly as written in the reference: previous time (lag), gap with first
    row 0, flag for a gap strictly greater than ``gap``, and the running sum of the
    flags under the default RANGE frame (ties share the value) as ``group_id``."""
    w = Window.partitionBy(key).orderBy(time_col)
    prev = F.lag(time_col).over(w)
    return (df.withColumn("prev_time", prev)
            .withColumn("time_diff", F.coalesce(F.col(time_col) - F.col("prev_time"), F.lit(0)))
            .withColumn("new_record", F.when(F.col("time_diff") > F.lit(gap), 1).otherwise(0))
            .withColumn("group_id", F.sum("new_record").over(w)))


def session_flags(df: DataFrame, key: str, time_col: str, gap: float,
                  bucket: float | None = None, tiebreak: Iterable[str] = ()) -> DataFrame:
    """W1-W4 with the reference's columns — prev_time, time_diff (first row 0),
    new_record (gap strictly greater), group_id (running count of new records) — in
    the two-level form: ``lag`` inside each (key, bucket), the previous bucket's last
    time as carry, and ``group_id`` from the bucket summary.  No window spans a key."""
    bucket = gap if bucket is None else bucket
    tiebreak = list(tiebreak)
    summ = bucket_summary(df, key, time_col, gap, bucket, tiebreak).select(
        key, "_b", "session_no", "prev_bucket_max")
    x = (df.withColumn("_b", F.floor(F.col(time_col) / F.lit(bucket)).cast("long"))
         .join(summ, [key, "_b"]))
    wb = Window.partitionBy(key, "_b").orderBy(*_order_cols(time_col, tiebreak))
    prev = F.coalesce(F.lag(time_col).over(wb), F.col("prev_bucket_max"))
    return (x.withColumn("prev_time", prev)
            .withColumn("time_diff", F.coalesce(F.col(time_col) - F.col("prev_time"), F.lit(0)))
            .withColumn("new_record", F.when(F.col("time_diff") > F.lit(gap), 1).otherwise(0))
            .withColumn("group_id", F.col("session_no").cast("long"))
            .drop("_b", "session_no", "prev_bucket_max"))


def bucket_summary(df: DataFrame, key: str, time_col: str, gap: float, bucket: float,
                   tiebreak: Iterable[str] = (), first_cols: Iterable[str] = ()) -> DataFrame:
    """One row per (key, bucket) with the session bookkeeping of that bucket.

    Columns: key, _b, _n, _tmin, _tmax, rows_before (events of the key before the
    bucket), session_no (0-based, constant inside the bucket), start_pos (position of
    the first event of the bucket's session inside the key), starts (bucket opens a
    session), and ``first_<c>`` = value of ``c`` on the bucket's first event.
    """
    if bucket > gap:
        raise ValueError("bucket width must not exceed the gap")
    tiebreak = list(tiebreak)
    first_cols = list(first_cols)
    order_key = F.struct(*_order_cols(time_col, tiebreak))
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(time_col).alias("_tmin"),
            F.max(time_col).alias("_tmax")]
    aggs += [F.min_by(F.col(c), order_key).alias(f"first_{c}") for c in first_cols]
    s = (df.withColumn("_b", F.floor(F.col(time_col) / F.lit(bucket)).cast("long"))
         .groupBy(key, "_b").agg(*aggs))
    wk = Window.partitionBy(key).orderBy("_b")
    prev_max = F.lag("_tmax").over(wk)
    s = (s.withColumn("_prev_max", prev_max)
         .withColumn("starts", F.col("_prev_max").isNull()
                     | ((F.col("_tmin") - F.col("_prev_max")) > F.lit(gap)))
         .withColumn("rows_before", F.coalesce(
             F.sum("_n").over(wk.rowsBetween(_UNB, -1)), F.lit(0)).cast("long")))
    run = wk.rowsBetween(_UNB, 0)
    return (s.withColumn("session_no", (F.sum(F.col("starts").cast("int")).over(run) - 1)
                         .cast("int"))
            .withColumn("start_pos", F.max(F.when(F.col("starts"), F.col("rows_before")))
                        .over(run))
            .withColumnRenamed("_prev_max", "prev_bucket_max"))


def _session_attrs(summ: DataFrame, key: str, session_cols: list[str]) -> DataFrame:
    """Add ``list_size`` and ``first_<c>`` of each session to the bucket summary.

    Windows over (key, session_no): the summary is already hash-partitioned by key,
    which satisfies that clustering, so this adds a sort, not a shuffle.
    """
    ws = Window.partitionBy(key, "session_no")
    wo = ws.orderBy("_b").rowsBetween(_UNB, Window.unboundedFollowing)
    out = summ.withColumn("list_size", F.sum("_n").over(ws).cast("int"))
    for c in session_cols:
        out = out.withColumn(f"first_{c}", F.first(f"first_{c}").over(wo))
    return out


def sessionize(df: DataFrame, key: str, time_col: str, gap: float,
               bucket: float | None = None, tiebreak: Iterable[str] = (),
               session_cols: Iterable[str] = ()) -> DataFrame:
    """W5 as a long table: every event with ``session_no`` (0-based per key),
    ``pos`` (0-based inside the session), ``list_size`` and ``first_<c>`` (value of
    ``c`` on the session's first event, e.g. the session class of D9).

    ``bucket`` (same unit as ``time_col``, at most ``gap``) bounds the rows that share
    one window partition; default ``gap``.  The event table is shuffled once, by
    (key, bucket); the bookkeeping runs on the per-bucket summary.
    """
    bucket = gap if bucket is None else bucket
    tiebreak = list(tiebreak)
    session_cols = list(session_cols)
    summ = bucket_summary(df, key, time_col, gap, bucket, tiebreak, session_cols)
    summ = _session_attrs(summ, key, session_cols).select(
        key, "_b", "session_no", "rows_before", "start_pos", "list_size",
        *[f"first_{c}" for c in session_cols])
    x = df.withColumn("_b", F.floor(F.col(time_col) / F.lit(bucket)).cast("long"))
    x = x.join(summ, [key, "_b"])
    wb = Window.partitionBy(key, "_b").orderBy(*_order_cols(time_col, tiebreak))
    x = x.withColumn("pos", (F.col("rows_before") + F.row_number().over(wb) - 1
                             - F.col("start_pos")).cast("int"))
    return x.drop("_b", "rows_before", "start_pos")


def sessionize_split(df: DataFrame, key: str, time_col: str, gap: float,
                     bucket: float | None = None, tiebreak: Iterable[str] = (),
                     session_cols: Iterable[str] = (), split_rows: int = 100_000,
                     slices: int = 256, broadcast_rows: int = 100_000) -> DataFrame:
    """``sessionize`` for logs in which one (key, bucket) alone is too large for a task.

    Buckets with more than ``split_rows`` events are cut by count: their times go into a
    quantile sketch, merged from all tasks, whose ``slices`` - 1 cuts (at most, and no more
    than the largest bucket needs) bound its slices.  Counts of the slices give each one's
    first position, and the numbering window runs inside (key, bucket, slice), which is also
    the key of the one shuffle of the events.  Events of the same time stay in one slice.
    Same rows as ``sessionize``.

    The cut table has one row per large bucket; it is written once and broadcast when it has
    at most ``broadcast_rows`` rows, else joined by a shuffle."""
    bucket = gap if bucket is None else bucket
    tiebreak = list(tiebreak)
    session_cols = list(session_cols)
    kb = [key, "_b"]
    summ = materialize(_session_attrs(
        bucket_summary(df, key, time_col, gap, bucket, tiebreak, session_cols), key, session_cols)
        .select(*kb, "_n", "session_no", "rows_before", "start_pos", "list_size",
                *[f"first_{c}" for c in session_cols]))
    x = df.withColumn("_b", F.floor(F.col(time_col) / F.lit(bucket)).cast("long"))
    large = summ.filter(F.col("_n") > F.lit(split_rows)).select(*kb)
    n_large, top = summ.filter(F.col("_n") > F.lit(split_rows)).agg(
        F.count(F.lit(1)), F.max("_n")).first()
    if n_large == 0:
        cut = x.withColumn("_sl", F.lit(0))
        summ = summ.withColumn("_sl", F.lit(0)).withColumn("_off", F.lit(0).cast("long"))
    else:
        def hint(t):
            return F.broadcast(t) if n_large <= broadcast_rows else t

        parts = min(slices, -(-top // split_rows))
        grid = [i / parts for i in range(1, parts)]
        cuts = materialize(x.join(hint(large), kb).groupBy(*kb).agg(
            F.array_distinct(F.percentile_approx(F.col(time_col).cast("long"), grid, 10_000)).alias("_cuts")))
        # cuts below the event's time: its slice, 0 where a bucket has no cuts
        slice_no = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")),
                                   lambda c: c < F.col("_t")))
        x = x.withColumn("_t", F.col(time_col).cast("long"))
        cut = x.join(hint(cuts), kb, "left").withColumn("_sl", slice_no).drop("_cuts", "_t")
        in_slices = (x.join(hint(cuts), kb).withColumn("_sl", slice_no)
                     .groupBy(*kb, "_sl").agg(F.count(F.lit(1)).alias("_c")))
        before = Window.partitionBy(*kb).orderBy("_sl").rowsBetween(_UNB, -1)
        offs = in_slices.select(*kb, "_sl", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
        summ = (summ.join(offs, kb, "left").withColumn("_sl", F.coalesce("_sl", F.lit(0)))
                .withColumn("_off", F.coalesce("_off", F.lit(0))))
    y = cut.join(summ.drop("_n"), [*kb, "_sl"])
    wb = Window.partitionBy(*kb, "_sl").orderBy(*_order_cols(time_col, tiebreak))
    y = y.withColumn("pos", (F.col("rows_before") + F.col("_off") + F.row_number().over(wb) - 1
                             - F.col("start_pos")).cast("int"))
    return y.drop("_b", "_sl", "_off", "rows_before", "start_pos")


def session_table(df: DataFrame, key: str, time_col: str, gap: float,
                  bucket: float | None = None, tiebreak: Iterable[str] = (),
                  session_cols: Iterable[str] = ()) -> DataFrame:
    """One row per session (key, session_no, list_size, start/end time, first values),
    computed from the bucket summary alone: the event table is read once and only its
    per-bucket partial aggregates are shuffled."""
    bucket = gap if bucket is None else bucket
    session_cols = list(session_cols)
    summ = bucket_summary(df, key, time_col, gap, bucket, tiebreak, session_cols)
    return (summ.groupBy(key, "session_no")
            .agg(F.sum("_n").cast("int").alias("list_size"),
                 F.min("_tmin").alias("start_time"), F.max("_tmax").alias("end_time"),
                 *[F.min_by(f"first_{c}", "_b").alias(f"first_{c}") for c in session_cols]))


def collect_sessions(long: DataFrame, key: str, time_col: str, cols: list[str],
                     tiebreak: Iterable[str] = (), chunk: int = 10_000) -> DataFrame:
    """A1/A2: the reference's session row — one list per column, in time order — plus
    ``list_size`` (events of the whole session).  Lists are sorted by (time, tiebreak)
    (D7: the reference leaves the order to chance).

    A row never holds more than ``chunk`` events: a longer session continues in further
    rows (``chunk_no`` 0, 1, ...), so no task has to build one unbounded list and no
    event is dropped.  The library's own operators work on the long table instead."""
    tiebreak = list(tiebreak)
    fields = [time_col] + tiebreak + [c for c in cols if c not in (time_col, *tiebreak)]
    st = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in fields])))
    out = (long.withColumn("chunk_no", F.floor(F.col("pos") / F.lit(chunk)).cast("int"))
           .groupBy(key, "session_no", "chunk_no", "list_size").agg(st.alias("_s")))
    return out.select(key, "session_no", "chunk_no",
                      *[F.col("_s")[c].alias(f"{c}_list") for c in cols], "list_size")


def keep_long(sessions: DataFrame, min_size: int, size_col: str = "list_size") -> DataFrame:
    """Sessions with strictly more than ``min_size`` events."""
    return sessions.filter(F.col(size_col) > F.lit(min_size))


def ordinal(df: DataFrame, part: list[str], order: list[str], bucket: Column,
            out: str = "ordinal") -> DataFrame:
    """0-based row number inside each ``part`` group in ``order``, without a window over
    a whole group: ``bucket`` must be non-decreasing in ``order`` (e.g. a range of the
    first order key).  Per-(group, bucket) counts give each bucket's offset (a window
    over the small count table); a row_number inside each bucket adds the rest."""
    x = df.withColumn("_ob", bucket)
    counts = x.groupBy(*part, "_ob").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy(*part).orderBy("_ob")
    offs = counts.select(*part, "_ob", F.coalesce(F.sum("_c").over(wc.rowsBetween(_UNB, -1)),
                                                  F.lit(0)).alias("_off"))
    wb = Window.partitionBy(*part, "_ob").orderBy(*order)
    return (x.join(offs, [*part, "_ob"])
            .withColumn(out, (F.col("_off") + F.row_number().over(wb) - 1).cast("long"))
            .drop("_ob", "_off"))


def class_ordinal(sessions: DataFrame, class_col: str, key: str,
                  session_col: str = "session_no", key_range: int = 1 << 16) -> DataFrame:
    """0-based ordinal of each session inside its class, ordered by
    (key, session_no).  Two levels (``ordinal``) over key ranges of ``key_range`` ids, so
    a large class is spread over many window tasks."""
    out = ordinal(sessions, [class_col], [key, session_col],
                  F.floor(F.col(key) / F.lit(key_range)), "class_session_no")
    return out.withColumn("class_session_no", F.col("class_session_no").cast("int"))


def consecutive_pairs(long: DataFrame, part: list[str], pos_col: str, item_col: str,
                      src: str = "src", dst: str = "dst") -> DataFrame:
    """(item, next item) inside each session; ``part`` names the session.

    An equi-join of each event with the event at the next position of the same session:
    the join keys (session, position) are unique, so even a session holding a large
    share of all events is spread evenly (a ``lead`` window would put it in one task)."""
    nxt = long.select(*part, (F.col(pos_col) - 1).alias(pos_col), F.col(item_col).alias(dst))
    return long.join(nxt, [*part, pos_col]).withColumnRenamed(item_col, src)


def cut_tail(long: DataFrame, k: int, pos_col: str = "pos",
             size_col: str = "list_size") -> DataFrame:
    """O3: flag the last ``k`` events of each session as label (``is_label``)."""
    return long.withColumn("is_label", F.col(pos_col) >= F.col(size_col) - F.lit(k))


def history_list(items: Column, k: int) -> Column:
    """Last ``k`` distinct items (first-seen order), left-padded with -1."""
    d = F.array_distinct(items)
    n = F.size(d)
    tail = F.when(n >= F.lit(k), F.slice(d, F.greatest(n - F.lit(k) + 1, F.lit(1)), k)).otherwise(d)
    pad = F.array_repeat(F.lit(-1).cast("int"), F.greatest(F.lit(k) - n, F.lit(0)))
    return F.concat(pad, tail.cast("array<int>"))
