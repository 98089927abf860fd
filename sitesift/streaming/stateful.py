"""R2 by event time, and C3 + C1 while pages arrive: state per key across
micro-batches.

:func:`first_by_time` keeps, for every key, the row of the smallest event time
whatever order the files come in. A key's best row so far is its state; once
the watermark has passed its time no earlier row can come, and it is emitted.
Rows behind the watermark are dropped and counted by Spark
(``ingest.rows_dropped_by_watermark``).

:func:`halt_crawl` is the crawl loop (halt after ``max_empty`` empty pages in a
row, at most ``limit`` records a site, in page order) over pages in any order.
A site's state is the page it waits for, the run of empty pages, the records it
may still take, and the pages that came too early, with no more records than
could still be taken. A page that has not come when the watermark has passed
the next one's time and ``patience`` counts as empty.

State is kept by hash bucket of keys or sites, so Python is called per bucket,
not per key; what is kept of a site is bounded by how far its pages are out of
order. A batch's rows are read in pieces and only the smallest of a key is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..constants import MAX_EMPTY


#: Keys share a state by hash: a call of Python per bucket, not per key.
BUCKETS = 512


def _ms(t) -> int:
    return pd.Timestamp(t).value // 1_000_000


def _bucket(keys: list[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def _keep(state: GroupState, entries: dict, due: Iterable[int | None], now: int) -> None:
    """The bucket's entries as its state, with a timer at the first that is due."""
    if not entries:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps([[k, *v] for k, v in entries.items()]),))
    first = min((d for d in due if d is not None), default=None)
    if first is not None:
        state.setTimeoutTimestamp(max(first, now + 1))


def first_by_time(events: DataFrame, keys: list[str], ts_col: str, tiebreak: str, delay: str,
                  keep_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """R2: the first row of every key by ``ts_col`` (ties: smallest
    ``tiebreak``), emitted when no earlier one can come any more; ``keys``,
    ``ts_col`` and ``tiebreak`` are the columns of the result. Later rows of a
    key are dropped while its state lives: for good, or with ``keep_ms`` until
    the watermark is that far past its first row."""
    rows = events.select(*keys, F.col(ts_col).cast("timestamp").alias(ts_col), tiebreak).withWatermark(ts_col, delay)
    out = rows.schema
    as_text = [F.col(k).cast("string") for k in keys]            # exact for whole numbers, text, days and flags
    rows = rows.select(_bucket(keys, buckets), F.to_json(F.array(*as_text)).alias("key"), ts_col, tiebreak).filter(F.col(ts_col).isNotNull())

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: v for k, *v in json.loads(state.get[0])} if state.exists else {}
        now, sent = state.getCurrentWatermarkMs(), []
        fresh: dict = {}
        if not state.hasTimedOut:
            for rows in batches:
                first = rows.sort_values([ts_col, tiebreak]).drop_duplicates("key")
                for key, when, which in zip(first["key"], first[ts_col].astype("datetime64[us]").astype("int64").tolist(), first[tiebreak].tolist()):
                    if key not in fresh or [when, which] < fresh[key]:
                        fresh[key] = [when, which]
        for key, (when, which, done, due) in list(known.items()):
            if key in fresh or due is None or due >= now:
                continue
            if done:                                    # kept for long enough
                del known[key]
            else:
                sent.append((key, when, which))
                known[key] = [when, which, True, None if keep_ms is None else max(when // 1000 + keep_ms, now + 1)]
        for key, best in fresh.items():
            when, which, done = known[key][:3] if key in known else (*best, False)
            if done and keep_ms is not None and now > when // 1000 + keep_ms:
                when, which, done = *best, False        # past its time, though no timer has gone off yet
            if not done and best < [when, which]:
                when, which = best
            until = when // 1000 if not done else None if keep_ms is None else when // 1000 + keep_ms
            known[key] = [when, which, done, None if until is None else max(until, now + 1)]
        _keep(state, known, (v[3] for v in known.values()), now)
        if sent:
            yield pd.DataFrame({"key": [x[0] for x in sent], ts_col: pd.to_datetime([x[1] for x in sent], unit="us"),
                                tiebreak: [x[2] for x in sent]})

    shape = StructType().add("key", "string").add(out[ts_col]).add(out[tiebreak])
    found = rows.groupBy("bucket").applyInPandasWithState(step, shape, "entries string", "append", GroupStateTimeout.EventTimeTimeout)
    texts = F.from_json("key", "array<string>")
    return found.select(*[texts[i].cast(out[k].dataType).alias(k) for i, k in enumerate(keys)], ts_col, tiebreak)


def halt_crawl(pages: DataFrame, limit: int, delay: str, patience_ms: int = 0, first_page: int = 1,
               max_empty: int = MAX_EMPTY, buckets: int = BUCKETS) -> DataFrame:
    """C3 + C1: (site, page, record) of the pages that a crawl visits, from a
    stream of (site, page, ``records`` array<bigint>, ``fetched_at``). A page
    that comes twice counts once, the first copy; pages before ``first_page``
    and after the halt are ignored."""
    rows = pages.select("site", "page", "records", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    kind = rows.schema["site"]
    rows = rows.withWatermark("fetched_at", delay).select(
        _bucket(["site"], buckets), F.col("site").cast("string").alias("site"), "page", "records", "fetched_at")

    def visit(site: str | None, entry: list, late: bool, now: int, taken: list) -> list:
        at, empty, left, waiting, _ = entry
        if late:                                        # what lies before the first waiting page never came
            first = min(waiting)
            empty, at = empty + first - at, first
        while empty < max_empty and left > 0 and at in waiting:
            ids = waiting.pop(at)[1][:left]
            taken += [(site, at, r) for r in ids]
            empty, left, at = 0 if ids else empty + 1, left - len(ids), at + 1
        if empty >= max_empty or left <= 0:
            return [at, empty, 0, {}, None]
        return [at, empty, left, waiting, max(waiting[min(waiting)][0] + patience_ms, now + 1) if waiting else None]

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: [at, empty, left, {int(p): w for p, w in early.items()}, due]
                 for k, at, empty, left, early, due in json.loads(state.get[0])} if state.exists else {}
        now, taken, fresh = state.getCurrentWatermarkMs(), [], set()
        if not state.hasTimedOut:
            for rows in batches:
                times = rows["fetched_at"].astype("datetime64[ms]").astype("int64").tolist()
                for site, page, records, when in zip(rows["site"], rows["page"].tolist(), rows["records"], times):
                    entry = known.setdefault(site, [first_page, 0, limit, {}, None])
                    fresh.add(site)
                    if entry[2] > 0 and page >= entry[0] and page not in entry[3]:
                        entry[3][int(page)] = [when, [] if records is None else sorted(int(r) for r in records)[:entry[2]]]
        for site, entry in known.items():
            late = site not in fresh and entry[4] is not None and entry[4] < now
            if entry[2] > 0 and (late or site in fresh):
                known[site] = visit(site, entry, late, now, taken)
        _keep(state, known, (v[4] for v in known.values()), now)
        if taken:
            yield pd.DataFrame(taken, columns=["site", "page", "record"])

    found = rows.groupBy("bucket").applyInPandasWithState(
        step, "site string, page int, record long", "entries string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("site").cast(kind.dataType).alias("site"), "page", "record")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run ``stream`` over what its source has now, into Parquet files under
    ``folder``; the result read back, and its checkpoint beside it."""
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
