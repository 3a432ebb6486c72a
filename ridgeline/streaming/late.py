"""Training load of rides that arrive late: a ride within the delay is put in its place and all that follows is folded again, not dropped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import C

DAY_MS = 86_400_000


def _folded(last: float | None, ctl: float, atl: float, day: float, load: float) -> tuple[float, float]:
    gap = 0.0 if last is None else day - last
    return ctl * math.exp(-gap / C.ctl_days) + load * (1 - math.exp(-1 / C.ctl_days)), atl * math.exp(-gap / C.atl_days) + load * (1 - math.exp(-1 / C.atl_days))


def training_load(events: DataFrame, key: str = "rider", day: str = "day", id: str = "id", load: str = "trimp", delay: str = "14 days", provisional: bool = False, groups: int = 64) -> DataFrame:
    """Long and short load after every event, once the watermark has passed its day: key, id, day, ctl, atl, final. Any order of arrival within the delay gives the batch's result.

    The state of a key is the load up to the last settled event and the events that are not settled, ordered by (day, id); a timer at the first of these settles it without
    new events. Keys share the states of so many ``groups``, as a call costs more than a key; a group has to fit in a task, so take more for millions of keys.
    provisional: what a batch adds is also told at once, with final = false, together with everything after it that it changes. An event behind the
    watermark can't be placed any more: Spark leaves it out and counts it (numRowsDroppedByWatermark in the query's progress)."""
    schema = f"{key} long, {id} long, {day} double, ctl double, atl double, final boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    states = "keys array<long>, last array<double>, ctl array<double>, atl array<double>, whose array<long>, days array<double>, ids array<long>, loads array<double>"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, lasts, ctls, atls, whose, days, ids, loads = state.get if state.exists else ([], [], [], [], [], [], [], [])
        known = dict(zip(keys, zip(lasts, ctls, atls, strict=True), strict=True))
        waiting: dict[int | None, list[tuple]] = {}
        for w, *event in zip(whose, days, ids, loads, strict=True):
            waiting.setdefault(w, []).append(tuple(event))
        out, first_new = [], {}
        if not state.hasTimedOut:
            for frame in frames:
                for w, d, i, x in zip(frame[key].tolist(), frame[day].tolist(), frame[id].tolist(), frame[load].fillna(0.0).tolist(), strict=True):
                    event, w = (float(d), int(i), float(x)), None if pd.isna(w) else int(w)
                    waiting.setdefault(w, []).append(event)
                    first_new[w] = min(first_new.get(w, event), event)
        mark = state.getCurrentWatermarkMs()
        for w, events_ in waiting.items():
            events_.sort()
            last, ctl, atl = known.get(w, (None, 0.0, 0.0))
            settled = 0
            while settled < len(events_) and events_[settled][0] * DAY_MS < mark:
                d, i, x = events_[settled]
                ctl, atl = _folded(last, ctl, atl, d, x)
                last, settled = d, settled + 1
                out.append((w, i, d, ctl, atl, True))
            known[w], events_[:settled] = (last, ctl, atl), []
            if provisional and w in first_new:
                then, a, b = last, ctl, atl
                for event in events_:
                    a, b = _folded(then, a, b, event[0], event[2])
                    then = event[0]
                    if event >= first_new[w]:
                        out.append((w, event[1], event[0], a, b, False))
        left = [(w, *e) for w, es in waiting.items() for e in es]
        state.update((list(known), *([s[c] for s in known.values()] for c in range(3)), *([e[c] for e in left] for c in range(4))))
        if left:
            state.setTimeoutTimestamp(max(int(min(e[1] for e in left) * DAY_MS), mark) + 1)
        if out:
            yield pd.DataFrame(out, columns=names)

    timed = events.withColumn("_at", F.timestamp_micros((F.col(day) * DAY_MS * 1000).cast("long"))).withWatermark("_at", delay)
    timed = timed.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return timed.groupBy("_group").applyInPandasWithState(step, schema, states, "append", GroupStateTimeout.EventTimeTimeout)
