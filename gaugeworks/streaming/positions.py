"""Camera positions held by session: keyed state that a replayed, shuffled or repeated stream leaves the same.

An event is (seq, plan, camera, photographs). Without a camera it loads a plan,
which lets go of all positions of its session. With one it holds a position,
in place of an earlier one of that camera, and of any other camera's whose
photographs are mostly the same; a position read against another plan than the
session's isn't held. The state keeps the events by ``seq`` and folds them in
that order, so a late event lands where it belongs and a repeated one changes nothing.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Event = tuple[int, str | None, int | None, tuple[str, ...]]

#: Rows of a batch that a task hands back
BATCH = 10_000


@lru_cache(1 << 14)
def _shared(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """How many photographs two positions have in common, each matched once."""
    return sum((Counter(a) & Counter(b)).values())


def _place(held: dict[int, Event], event: Event) -> tuple[dict[int, Event], list[tuple[str, int | None, int]]]:
    """(what is held after it, changes) of an event that is held."""
    _, _, camera, photographs = event
    kept, changes, n = {}, [], len(photographs)
    for other, earlier in held.items():
        shared = _shared(earlier[3], photographs)
        if other == camera:
            changes.append(("replaced", other, shared))
        elif 2 * shared > n or 2 * shared > len(earlier[3]):
            changes.append(("moved", other, shared))
        else:
            kept[other] = earlier
    kept[camera] = event
    changes.sort(key=lambda c: c[1])
    return kept, changes or [("added", None, 0)]


def fold(events: Iterable[Event]) -> Iterator[tuple[Event, str, int | None, int, dict[int, Event]]]:
    """(event, change, other camera, shared photographs, what is held after it), in order of seq; of events with one seq the first counts.

    change: ``plan``, ``other-plan`` (not held), ``added``, ``replaced`` (the camera's own earlier one) or ``moved``
    (that of another camera, of which more than half of the smaller one's photographs are the same, each matched once). A
    position that replaces several gives a row for each.
    """
    plan: str | None = None
    held: dict[int, Event] = {}
    first: dict[int, Event] = {}
    for e in events:
        first.setdefault(e[0], e)
    for event in (first[k] for k in sorted(first)):
        if event[2] is None:
            plan, held = event[1], {}
            yield event, "plan", None, 0, held
        elif event[1] != plan:
            yield event, "other-plan", None, 0, held
        else:
            held, changes = _place(held, event)
            for change, other, shared in changes:
                yield event, change, other, shared, held


def _events(frame: pd.DataFrame) -> list[Event]:
    return [(int(s), None if pd.isna(p) else p, None if pd.isna(c) else int(c), tuple(x if x is not None else ())) for s, p, c, x in zip(frame["seq"], frame["plan"], frame["camera"], frame["photographs"], strict=True)]


def _order(e: Event) -> tuple:
    return e[0], str(e[1]), str(e[2]), e[3]


def _changes(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``position_changes``, of rows that come session by session in order of seq, the first of each with place 1; one waits only while its position is held."""
    out: list[tuple] = []
    key, plan, held = None, None, {}
    current: Event | None = None
    waiting: dict[int, list[tuple]] = {}

    def settle(event: Event) -> None:
        nonlocal plan, held
        seq, its_plan, camera, _ = event
        if camera is None:
            plan, held = its_plan, {}
            for rows in waiting.values():
                out.extend((*r, False) for r in rows)
            waiting.clear()
            out.append((key, seq, None, "plan", None, 0, False))
        elif its_plan != plan:
            out.append((key, seq, camera, "other-plan", None, 0, False))
        else:
            held, changes = _place(held, event)
            for c in changes:
                if c[1] is not None:
                    out.extend((*r, False) for r in waiting.pop(c[1]))
            waiting[camera] = [(key, seq, camera, *c) for c in changes]

    def close() -> None:
        nonlocal plan, held
        if current is not None:
            settle(current)
        for rows in waiting.values():
            out.extend((*r, True) for r in rows)
        waiting.clear()
        plan, held = None, {}

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for part in batches:
        *columns, photographs = part.columns
        names = photographs.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = photographs.offsets.to_pylist()
        for its_key, place, seq, its_plan, camera, lo, hi in zip(*(c.to_pylist() for c in columns), ends, ends[1:]):  # noqa: B905
            event = (seq, its_plan, camera, tuple(names[lo - ends[0] : hi - ends[0]]))
            if place == 1:
                close()
                key, current = its_key, event
            elif seq == current[0]:
                current = min(current, event, key=_order)
            else:
                settle(current)
                current = event
        if len(out) >= BATCH:
            yield batch()
    close()
    if out:
        yield batch()


def position_changes(events: DataFrame, session: str = "session") -> DataFrame:
    """``session``, seq, camera, change, other, shared, held: what each event changed, and whether its position is held at the end.

    events: ``session``, seq, plan, camera, photographs (array of strings, a null being empty). Rows without a seq are left
    out; a null session is a session; of rows that repeat a seq the least by plan, camera and photographs counts. A session is folded in one
    task, as its order demands, but never held whole: a window puts the rows of all sessions of a task in order, and they pass one by one. An empty table gives no rows.
    """
    kind = events.schema[session].dataType.simpleString()
    rows = events.where("seq IS NOT NULL").select(F.col(session).alias("_session"), F.col("seq").cast("long").alias("seq"), "plan", F.col("camera").cast("int").alias("camera"), F.coalesce("photographs", F.array().cast("array<string>")).alias("photographs"))
    # The place is read in the task, as the mark of a session's first row: so the window, and with it the order, stays.
    place = F.row_number().over(Window.partitionBy("_session").orderBy("seq"))
    placed = rows.select("_session", place.alias("_place"), "seq", "plan", "camera", "photographs")
    names = ["seq", "camera", "change", "other", "shared", "held"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _changes(chain([first], batches), pa.schema([pa.field("_session", first.schema.field(0).type), *map(pa.field, names, kinds)]))

    found = placed.mapInArrow(run, f"_session {kind}, seq long, camera int, change string, other int, shared int, held boolean")
    return found.withColumnRenamed("_session", session)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, session: str, age_s: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    text, latest = state.get if state.exists else ("[]", 0)
    known: list[Event] = [(s, p, c, tuple(x)) for s, p, c, x in json.loads(text)]
    before = len(known)
    seen = {e[0] for e in known}
    for frame in frames:
        latest = max(latest, int(frame["ts"].max().timestamp() * 1000) if frame["ts"].notna().any() else 0)
        for e in sorted(_events(frame[frame["seq"].notna()]), key=_order):
            if e[0] not in seen:
                seen.add(e[0])
                known.append(e)
    state.update((json.dumps(known), latest))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1000 * age_s)
    if len(known) == before:
        return
    held: dict[int, Event] = {}
    for *_, held in fold(known):
        pass
    text = json.dumps([{"camera": c, "seq": e[0], "photographs": len(e[3])} for c, e in sorted(held.items())])
    yield pd.DataFrame({session: [key[0]], "events": [len(known)], "held": [text]})


def stream_positions(stream: DataFrame, session: str = "session", age_s: int = 86_400) -> DataFrame:
    """A streaming ``session``, events, held (JSON by camera), a row each time a session learns something new.

    stream: the columns of ``position_changes`` and ``ts``, when an event happened. Of a session's rows, that with the most
    events is the latest (``latest_positions``). Events that differ under one seq are decided by the first batch that has it.
    Events later than ``age_s`` behind the newest of all are dropped, as the watermark says, and so is the state of a session
    whose last event is ``age_s`` older than that. Use it in update mode.
    """
    kind = stream.schema[session].dataType.simpleString()
    rows = stream.select(session, "seq", "plan", F.col("camera").cast("int").alias("camera"), "photographs", "ts").withWatermark("ts", f"{age_s} seconds")
    return rows.groupBy(session).applyInPandasWithState(partial(_advance, session=session, age_s=age_s), f"`{session}` {kind}, events long, held string", "events string, latest long", "update", GroupStateTimeout.EventTimeTimeout)


def latest_positions(rows: DataFrame, session: str = "session") -> DataFrame:
    """``session``, events and held of the row with the most events of each session."""
    return rows.groupBy(session).agg(F.max("events").alias("events"), F.max_by("held", "events").alias("held"))
