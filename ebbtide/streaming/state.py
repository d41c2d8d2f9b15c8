"""Keyed state: what a stream remembers about an entity, an owner's day or a source, and when it forgets it.

Each handler holds a few numbers or a short series per key in Spark's state store, so a
batch reads its new rows and the state of their keys only, never earlier output. Where keys are many and
small (entities, sources) a handler is called for a bucket of them and works on all at once, in arrays. Rows that
are not newer than the watermark (newest row of earlier batches minus the delay) are late:
every handler leaves them out by the same rule, `streams.split_late` names them, and event-time timers
drop the state of keys that no row in time can touch any more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ebbtide.config import PanelConfig
from ebbtide.operators.labels import INSUFFICIENT, LABEL_COLUMNS, NO_GROWTH

HOUR = 3_600_000_000        # microseconds
BUCKETS = 2_048             # of entities or sources; part of what a stream's checkpoint holds, so it stays as it is
PANEL_BUCKETS = 512         # of entities with the same first character; stays as it is too
DAY_MS = 86_400_000
LABEL_SCHEMA = ("entity string, t_death double, event_observed boolean, peak_velocity double, peak_at_hours double, "
                "n_observations long, n_intervals long, last_observed_hours double, final_value double, "
                "monotonicity_repairs long, exclude_reason string, final boolean")


def hours_text(hours: float) -> str:
    return f"{int(hours * 3600)} seconds"


def _keyed(rows: DataFrame, keys: list[str], ts: str, delay_hours: float, handler, out: str | T.StructType, state: str) -> DataFrame:
    """Run `handler` per key in update mode with event-time timers; `_at` is the row's time in microseconds."""
    timed = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, hours_text(delay_hours))
    return timed.groupBy(*keys).applyInPandasWithState(handler, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def _bucket(key: str, buckets: int | None = None):
    return F.pmod(F.xxhash64(key), F.lit(buckets or BUCKETS)).cast("int").alias("_bucket")


def _codes(held: list, names: np.ndarray) -> tuple[np.ndarray, list]:
    """(codes of `names`, all names): names in the state come first, each once, and None is a name."""
    codes, known = pd.factorize(np.concatenate((np.array(held, object), names)), use_na_sentinel=False)
    return codes[len(held):], [None if pd.isna(x) else x for x in known]


def in_time(pdf: pd.DataFrame, watermark_ms: int) -> pd.DataFrame:
    return pdf[pdf["_at"] > watermark_ms * 1000]


# ---------------------------------------------------------------- labels
def labels_of(ages: np.ndarray, values: np.ndarray, lengths: np.ndarray, cfg: PanelConfig) -> pd.DataFrame:
    """The decay labels of many short series laid end to end, each sorted by age with one value per age; series of a length at once."""
    m, starts = len(lengths), np.cumsum(lengths) - lengths
    real = {c: np.full(m, np.nan) for c in ("t_death", "peak_velocity", "peak_at_hours", "last_observed_hours", "final_value")}
    observed, repairs, reason = np.zeros(m, bool), np.zeros(m, np.int64), np.full(m, None, object)
    for size in np.unique(lengths):
        who = np.flatnonzero(lengths == size)
        at = starts[who][:, None] + np.arange(size)
        a, v = ages[at], values[at]
        top = np.maximum.accumulate(v, axis=1)
        before, speed = top[:, :-1], (top[:, 1:] - top[:, :-1]) / np.diff(a, axis=1)
        n, k = size - 1, cfg.sustain
        real["last_observed_hours"][who], real["final_value"][who] = a[:, -1], top[:, -1]
        repairs[who] = (v[:, 1:] < before).sum(axis=1)
        if n < cfg.min_intervals:
            reason[who] = INSUFFICIENT
            continue
        pool = speed[:, 1:] if cfg.skip_first and n > 1 else speed
        peak = pool.max(axis=1)
        real["peak_velocity"][who] = peak
        real["peak_at_hours"][who] = a[np.arange(len(who)), size - pool.shape[1] + np.argmax(pool == peak[:, None], axis=1)]
        grew = ~(peak <= 0)
        reason[who[~grew]] = NO_GROWTH
        death, died = a[:, -1], np.zeros(len(who), bool)
        if n >= k:
            slow = np.lib.stride_tricks.sliding_window_view(speed, k, axis=1).max(axis=2) < cfg.frac * peak[:, None]
            died = grew & slow.any(axis=1)
            death = np.where(died, a[np.arange(len(who)), 1 + slow.argmax(axis=1)], death)
        real["t_death"][who], observed[who] = np.where(grew, death, np.nan), died
    return pd.DataFrame({**real, "event_observed": observed, "n_observations": lengths, "n_intervals": lengths - 1,
                         "monotonicity_repairs": repairs, "exclude_reason": reason})


def merged_series(code: np.ndarray, ages: np.ndarray, values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """(code, ages, values, order) sorted by code and age, with one reading per age (to 1e-9 h), the one latest in order."""
    key = np.round(ages, 9)
    rank = np.lexsort((order, key, code))
    last = np.ones(len(rank), bool)
    last[:-1] = (key[rank][1:] != key[rank][:-1]) | (code[rank][1:] != code[rank][:-1])
    keep = rank[last]
    return code[keep], ages[keep], values[keep], order[keep]


def keyed_labels(readings: DataFrame, cfg: PanelConfig, seq: str | None, delay_hours: float, ts: str = "reading_ts") -> DataFrame:
    """A label per touched entity and batch, from the entity's series in the state.

    A later peak raises the threshold and a late reading slots in by age, so the short series
    (one reading per scheduled mark) is what the state holds, for a bucket of entities end to end. Readings older than
    the tracking window don't count. Once the watermark has passed the end of an entity's window its label is emitted as
    final and its series goes; the timer is that of the bucket's next window to end.
    """
    track = int(cfg.max_track * HOUR)

    def run(key, pdfs, state):
        wm = state.getCurrentWatermarkMs()
        held, published, lengths, *series = state.get if state.exists else ([], [], [], [], [], [])
        new = []
        for pdf in () if state.hasTimedOut else pdfs:
            pdf = in_time(pdf, wm)
            new.append(pdf[pdf["age_hours"].notna() & pdf["value"].notna() & (pdf["age_hours"] <= cfg.max_track)])
        col = lambda c, kind=float: np.concatenate([np.empty(0, kind), *[x[c].to_numpy(kind) for x in new]])
        fresh, names = _codes(held, col("entity", object))
        if not names:
            return
        code = np.concatenate((np.repeat(np.arange(len(held)), np.array(lengths, np.int64)), fresh))
        code, *series = merged_series(code, *[np.concatenate((np.array(x, float), col(c))) for x, c in zip(series, ("age_hours", "value", "_order"))])
        first = {c: np.full(len(names), np.inf) for c in ("_published", "_at")}
        for c, x in first.items():
            np.fmin.at(x, fresh, col(c))
        start = np.where(np.isinf(first["_published"]), first["_at"], first["_published"])
        start[:len(held)] = np.minimum(start[:len(held)], np.array(published, float))
        start = start.astype(np.int64)
        end = (start + track) // 1000
        final, lengths = end < wm, np.bincount(code, minlength=len(names))
        if final.all():
            state.remove()
        else:
            rows = ~final[code]
            state.update(([x for x, gone in zip(names, final) if not gone], start[~final].tolist(), lengths[~final].tolist(), *[x[rows].tolist() for x in series]))
            state.setTimeoutTimestamp(max(int(end[~final].min()), wm + 1))
        told = final.copy()
        told[fresh] = True
        if told.any():
            rows = told[code]
            out = labels_of(series[0][rows], series[1][rows], lengths[told], cfg)
            out["entity"], out["final"] = [x for x, t in zip(names, told) if t], final[told]
            yield out[[*LABEL_COLUMNS, "final"]]

    order = F.col(seq) if seq else F.col("value")
    rows = readings.select(_bucket("entity"), "entity", F.col(ts).cast("timestamp").alias(ts), F.col("age_hours").cast("double").alias("age_hours"),
                           F.col("value").cast("double").alias("value"), order.cast("double").alias("_order"),
                           F.unix_micros(F.col("published_at").cast("timestamp")).cast("double").alias("_published"))
    return _keyed(rows, ["_bucket"], ts, delay_hours, run, LABEL_SCHEMA, "names array<string>, published array<long>, lengths array<long>, "
                  "ages array<double>, vals array<double>, ord array<double>")


# ---------------------------------------------------------------- panel state
def keyed_panel_state(readings: DataFrame, cfg: PanelConfig, delay_hours: float, ts: str = "reading_ts") -> DataFrame:
    """Reading count, scheduled count and last reading per entity; forgotten once the tracking window is over.

    The state is four numbers per entity, for a bucket of entities end to end. A bucket's key is the entities' first
    character and a hash, so the state can be looked up by name. An entity that is not read goes once the
    watermark has passed its window; the timer is that of the bucket's next window to end.
    """
    track = int(cfg.max_track * HOUR)
    never = np.iinfo(np.int64).min

    def run(key, pdfs, state):
        wm = state.getCurrentWatermarkMs()
        held, *numbers = state.get if state.exists else ([], [], [], [], [])
        new = []
        for pdf in () if state.hasTimedOut else pdfs:
            pdf = in_time(pdf, wm)
            new.append(pdf[pdf["_counts"] > 0])
        col = lambda c, kind: np.concatenate([np.empty(0, kind), *[x[c].to_numpy(kind) for x in new]])
        fresh, names = _codes(held, col("entity", object))
        if not names:
            return
        end, n, scheduled, last = (np.concatenate((np.array(x, np.int64), np.full(len(names) - len(held), empty))) for x, empty in zip(numbers, (never, 0, 0, never)))
        n += np.bincount(fresh, minlength=len(names))
        scheduled += np.bincount(fresh[col("_counts", np.int64) == 2], minlength=len(names))
        np.maximum.at(last, fresh, col("_at", np.int64))
        start = np.full(len(names), np.nan)
        np.fmin.at(start, fresh, col("_published", float))
        told = np.zeros(len(names), bool)
        told[fresh] = True
        unknown = np.isnan(start)
        ends = (np.where(unknown, last, np.where(unknown, 0, start).astype(np.int64)) + track) // 1000
        end = np.where(told, np.maximum(end, ends), end)
        kept = end >= wm
        if kept.any():
            state.update(([x for x, k in zip(names, kept) if k], *[x[kept].tolist() for x in (end, n, scheduled, last)]))
            state.setTimeoutTimestamp(max(int(end[kept].min()), wm + 1))
        else:
            state.remove()
        if told.any():
            yield pd.DataFrame({"entity": [x for x, t in zip(names, told) if t], "reading_count": n[told], "scheduled_count": scheduled[told],
                                "last_reading_at": last[told].astype("datetime64[us]")})

    # 0: past the window, 1: counts, 2: scheduled too; a missing age counts.
    age = F.nanvl(F.col("age_hours").cast("double"), F.lit(None).cast("double"))
    counts = F.when(age > cfg.max_track, 0).when(age >= cfg.first_mark_opens, 2).otherwise(1)
    rows = readings.select(F.substring("entity", 1, 1).alias("_initial"), _bucket("entity", PANEL_BUCKETS), "entity", F.col(ts).cast("timestamp").alias(ts),
                           counts.alias("_counts"), F.unix_micros(F.col("published_at").cast("timestamp")).cast("double").alias("_published"))
    return _keyed(rows, ["_initial", "_bucket"], ts, delay_hours, run, "entity string, reading_count long, scheduled_count long, last_reading_at timestamp",
                  "names array<string>, ends array<long>, n array<long>, scheduled array<long>, last array<long>")


# ---------------------------------------------------------------- admission cap
def keyed_cap(entities: DataFrame, limit: int, delay_hours: float, ts: str = "published_at") -> DataFrame:
    """At most `limit` entities per owner and UTC day; the state is the names admitted that day.

    Within a batch the earliest published come first. A name that is admitted, or repeated, takes no further
    place. The day's state goes when the watermark has passed the day: whoever is published in it
    and shows up later is late and not admitted.
    """
    columns = entities.columns

    def run(key, pdfs, state):
        wm = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        best = {}                                                     # entity: (time, entity, its row), of the earliest published
        for pdf in pdfs:
            for i, (at, name) in enumerate(zip(pdf["_at"].tolist(), pdf["entity"].tolist())):
                if at > wm * 1000 and name not in taken and (name not in best or at < best[name][0]):
                    best[name] = (at, name, pdf, i)
            best = {x[1]: x for x in sorted(best.values(), key=lambda x: x[:2])[:limit - len(taken)]}
        if not best:
            return
        state.update((taken + list(best),))
        ends = (int(key[1].toordinal()) - 719_163 + 1) * DAY_MS
        state.setTimeoutTimestamp(max(ends, wm + 1))
        yield pd.concat([pdf.iloc[[i]] for _, _, pdf, i in best.values()])[columns]

    rows = entities.withColumns({ts: F.col(ts).cast("timestamp"), "_day": F.to_date(F.col(ts).cast("timestamp"))})
    return _keyed(rows, ["owner", "_day"], ts, delay_hours, run, rows.drop("_day").schema, "taken array<string>")


# ---------------------------------------------------------------- sessions
def settle(minutes: np.ndarray, opened: tuple[int, int, int] | None, gap: int) -> tuple[list[tuple[int, int, int]], tuple[int, int, int] | None]:
    """(closed sessions, the last one) after adding sorted distinct `minutes`; a session is (first, last, minutes).

    `gap` or more without a minute ends a session.
    """
    if not len(minutes):
        return [], opened
    cut = np.flatnonzero(np.diff(minutes) >= gap) + 1
    runs = [(int(p[0]), int(p[-1]), len(p)) for p in np.split(minutes, cut)]
    if opened is not None:
        if runs[0][0] - opened[1] < gap:
            runs[0] = (opened[0], runs[0][1], opened[2] + runs[0][2])
        else:
            runs.insert(0, opened)
    return runs[:-1], runs[-1]


def keyed_sessions(readings: DataFrame, gap_hours: float, delay_hours: float, ts: str = "reading_ts") -> DataFrame:
    """Stretches of activity per source, in minutes: closed ones once, and what is open or may still change, per batch.

    The state is, per source of a bucket, the open session up to the watermark and the minutes after it, so its size
    follows the delay, not the volume. A session closes when a reading in time can no longer reach it: by a
    later reading that is settled, or by a timer if the source stays quiet while others go on. The timer is
    that of the bucket's next session; sources that are neither read nor due stay untouched.
    """
    gap, minute = int(gap_hours * 60), 60_000_000

    def one(opened, recent, now):
        """(rows, open session, minutes kept, when due) of a source."""
        closed, opened = settle(recent[recent < now], opened, gap)
        recent = recent[recent >= now]
        if opened is not None and now - opened[1] >= gap:
            closed, opened = [*closed, opened], None
        more, last = settle(recent, opened, gap)
        rows = [(*s, True) for s in closed] + [(*s, False) for s in ([*more, last] if last is not None else [])]
        due = [opened[1] + gap] if opened is not None else []
        due += [int(recent[0]) + 1] if len(recent) else []
        return rows, opened, recent, min(due) * 60_000 if due else None

    def run(key, pdfs, state):
        wm = state.getCurrentWatermarkMs()
        now = wm // 60_000                                            # minutes before this one can get no more readings
        held, *before, sizes, recent = state.get if state.exists else ([], [], [], [], [], [], [])
        new = [in_time(pdf, wm) for pdf in (() if state.hasTimedOut else pdfs)]
        seen = np.concatenate([np.empty(0, np.int64), *[x["_at"].to_numpy(np.int64) // minute for x in new]])
        fresh, names = _codes(held, np.concatenate([np.empty(0, object), *[x["source"].to_numpy(object) for x in new]]))
        o = np.lexsort((seen, fresh))
        seen, at = seen[o], np.searchsorted(fresh[o], np.arange(len(names) + 1))
        recent, cut = np.array(recent, np.int64), np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
        kept, rows = [], []
        for i, name in enumerate(names):
            first, last, n, due = (x[i] for x in before) if i < len(held) else (0, 0, 0, wm)
            mine = recent[cut[i]:cut[i + 1]] if i < len(held) else np.empty(0, np.int64)
            if due < wm or at[i + 1] > at[i] or i >= len(held):
                told, opened, mine, due = one((first, last, n) if n else None, np.union1d(mine, seen[at[i]:at[i + 1]]), now)
                rows += [(name, *s) for s in told]
                if due is None:
                    continue
                first, last, n = opened or (0, 0, 0)
            kept.append((name, first, last, n, due, mine))
        if kept:
            names, *lists, minutes = zip(*kept)
            state.update((list(names), *map(list, lists), [len(x) for x in minutes], np.concatenate(minutes).tolist()))
            state.setTimeoutTimestamp(max(min(lists[-1]), wm + 1))
        else:
            state.remove()
        if rows:
            who, start, last, n, closed = zip(*rows)
            at = lambda x: pd.to_datetime(np.array(x) * 60, unit="s")
            yield pd.DataFrame({"source": who, "start": at(start), "last": at(last), "minutes": n, "closed": closed})

    rows = readings.select(_bucket("source"), "source", F.col(ts).cast("timestamp").alias(ts)).filter(F.col(ts).isNotNull())
    return _keyed(rows, ["_bucket"], ts, delay_hours, run, "source string, start timestamp, last timestamp, minutes long, closed boolean",
                  "names array<string>, first array<long>, last array<long>, n array<long>, due array<long>, sizes array<long>, recent array<long>")


# ---------------------------------------------------------------- breaker
def keyed_breaker(attempts: DataFrame, trip_at: int, order: str = "at") -> DataFrame:
    """Length of the unbroken run of empty attempts per source; the state is three numbers.

    An attempt that called nobody, or saw something, resets the run; a dry run is ignored. Attempts
    arrive in log order: one that is not after the last one seen is a replay and changes nothing, nor does
    one without a time.
    """
    def run(key, pdfs, state):
        attempts, empty, last = state.get if state.exists else (0, 0, -(1 << 63))
        at, reset = [], []
        for pdf in pdfs:
            new = pdf[pdf["_order"] > last]
            at.append(new["_order"].to_numpy(np.int64))
            reset.append(new.loc[new["_reset"], "_order"].to_numpy(np.int64))
        at, reset = np.unique(np.concatenate(at)), np.concatenate(reset)
        if not len(at):
            return
        after = at[at > reset.max()] if len(reset) else at
        empty = len(after) + (0 if len(reset) else empty)
        attempts, last = attempts + len(at), int(at[-1])
        state.update((attempts, empty, last))
        yield pd.DataFrame({"source": [key[0]], "attempts": [attempts], "empty_rounds": [empty], "tripped": [empty >= trip_at]})

    time = F.unix_micros(order) if attempts.schema[order].dataType == T.TimestampType() else F.col(order).cast("long")
    reset = (F.coalesce("accounts_called", F.lit(0)) <= 0) | (F.coalesce("posts_seen", F.lit(0)) > 0)
    rows = (attempts.filter(~F.coalesce("dry_run", F.lit(False)) & F.col(order).isNotNull())
            .select("source", time.alias("_order"), reset.alias("_reset")))
    return rows.groupBy("source").applyInPandasWithState(
        run, "source string, attempts long, empty_rounds long, tripped boolean", "attempts long, empty long, last long", "update", GroupStateTimeout.NoTimeout)
