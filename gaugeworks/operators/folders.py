"""Whole camera positions read from fingerprints alone: runs found by their light, numbered by counting photographs.

A folder holds every photograph one camera took, in order: for each projector a
run of the plan, dark stretches for projectors that the camera can't see, extras
at both ends, and runs shot again at the end. Spark groups the photographs by
folder; a task reads one folder, of as many fingerprints as a camera took, in
numpy. Folders are never compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .indexing import PAIR_LIMIT
from .noise import EVIDENCE_SHARE

# Light that counts as light; how far a gap may be from whole runs; the least blocks of a run that is checked;
# the share of light inside a run's own, and of its blocks, that make a photograph more of it; the most contrast of phase steps;
# how far a plane and its complement differ; levels of black and white; the quantile that is a stretch's dark
DARK, SLACK, LEAST_CRESCENT, INSIDE, COVERED, CONTRAST, SEPARATION = 0.02, 3, 8, 0.9, 0.5, 0.55, 0.5
BLACK_LEVEL, WHITE_LEVEL, FLOOR_QUANTILE = 0.25, 0.75, 0.25


@dataclass(frozen=True)
class PositionPlan:
    """The kinds of a run's frames, how many projectors play it, and which frames are complements or the phase steps of an axis."""

    kinds: tuple[str, ...]
    projectors: int
    pairs: tuple[tuple[int, int], ...]
    phases: tuple[tuple[int, ...], ...]
    least_blocks: int = 1

    def fault(self) -> str | None:
        """Why nothing can be read with it: ``no-pairs``, ``no-projectors``, ``outside``, ``no-reference``, ``no-phases`` or ``phases``; null if it is sound."""
        if not self.pairs:
            return "no-pairs"
        if self.projectors < 1:
            return "no-projectors"
        if any(not 0 <= i < len(self.kinds) for pair in self.pairs for i in pair):
            return "outside"
        if not {"white", "black"} <= {*self.kinds}:
            return "no-reference"
        if not self.phases:
            return "no-phases"
        used = {i for pair in self.pairs for i in pair} | {self.kinds.index("white"), self.kinds.index("black")}
        for steps in self.phases:
            free = all(0 <= i < len(self.kinds) and i not in used and self.kinds[i] == "patterned" for i in steps)
            if len(steps) < 3 or len({*steps}) < len(steps) or not free:
                return "phases"
            used |= {*steps}
        return None


@dataclass
class _Run:
    start: int
    white: int
    black: int
    rise: np.ndarray  # white less black, 0 outside the crescent
    crescent: np.ndarray
    lit: np.ndarray
    verdict: str | None = None
    residual: float | None = None
    projector: int | None = None

    @property
    def modulation(self) -> float:
        return float(self.rise.sum())


class _Folder:
    """The photographs of one folder, and what they say of each other."""

    def __init__(self, values: np.ndarray, measured: np.ndarray, plan: PositionPlan):
        self.ok = measured & np.isfinite(values)
        self.v = np.where(self.ok, values, 0.0)
        self.plan, self.n, self.length = plan, len(values), len(plan.kinds)

    def window(self, start: int) -> _Run | None:
        white, black = (start + self.plan.kinds.index(kind) for kind in ("white", "black"))
        both = self.ok[white] & self.ok[black]
        rise = np.where(both, self.v[white] - self.v[black], 0.0)
        peak, up, down = rise.max(initial=0.0), rise[rise >= DARK].sum(), -rise[rise <= -DARK].sum()
        if peak < DARK or up < INSIDE * (up + down):
            return None
        crescent = rise >= max(DARK, EVIDENCE_SHARE * peak)
        return _Run(start, white, black, np.where(crescent, rise, 0.0), crescent, rise >= DARK)

    def level(self, f: int, run: _Run) -> float:
        """How far up from the run's black to its white a photograph sits over the crescent."""
        seen = run.crescent & self.ok[f]
        whole = run.rise[seen].sum()
        return float((self.v[f] - self.v[run.black])[seen].sum() / whole) if whole > 0 else math.nan

    def residual(self, a: int, b: int, white: int, black: int) -> float | None:
        """How far two photographs miss a white and a black together, over their modulation; None without evidence."""
        seen = self.ok[a] & self.ok[b] & self.ok[white] & self.ok[black]
        rise = np.where(seen, self.v[white] - self.v[black], 0.0)
        peak = rise.max(initial=0.0)
        if peak <= 0:
            return None
        kept = seen & (rise >= EVIDENCE_SHARE * peak)
        return float(np.abs(self.v[a] + self.v[b] - self.v[white] - self.v[black])[kept].sum() / rise[kept].sum())

    def holds(self, residual: float | None) -> bool:
        return residual is not None and residual <= PAIR_LIMIT

    def phase_steps(self, run: _Run) -> bool:
        """Whether the frames in the phase slots are steps of one cosine: opposite ones are complements, and none has too much contrast."""
        for steps in self.plan.phases:
            frames, n = [run.start + i for i in steps], len(steps)
            levels = np.array([self.level(f, run) for f in frames])
            if not np.isfinite(levels).all():
                return False
            if n % 2:
                if ((levels < BLACK_LEVEL) | (levels > WHITE_LEVEL)).any():
                    return False
                seen = run.crescent & self.ok[frames].all(axis=0)
                miss = np.abs((self.v[frames] - self.v[run.black]).sum(axis=0) - n / 2 * run.rise)[seen].sum()
                if not seen.any() or miss > PAIR_LIMIT * run.rise[seen].sum():
                    return False
                continue
            half = n // 2
            if (np.abs(levels[:half] + levels[half:] - 1) > PAIR_LIMIT).any():
                return False
            if 2 / n * abs((levels * np.exp(-2j * math.pi * np.arange(n) / n)).sum()) > CONTRAST:
                return False
            if not all(self.holds(self.residual(frames[k], frames[k + half], run.white, run.black)) for k in range(half)):
                return False
        return True

    def separates(self, run: _Run) -> bool:
        """Whether some plane is lit where its complement isn't: two copies of one photograph add up too."""
        for a, b in self.plan.pairs:
            f, g = run.start + a, run.start + b
            if np.abs(self.v[f] - self.v[g])[run.crescent & self.ok[f] & self.ok[g]].sum() >= SEPARATION * run.modulation:
                return True
        return False

    def above_black(self, run: _Run) -> bool:
        frames = slice(run.start, run.start + self.length)
        below = np.where(self.ok[frames] & self.ok[run.black], self.v[run.black] - self.v[frames], 0.0)
        return bool((np.where(below >= DARK, below, 0.0).sum(axis=1) <= (1 - INSIDE) * run.modulation).all())

    def inside(self, f: int, run: _Run) -> float | None:
        """The share of a photograph's light that falls where the run lights; None without light."""
        light = np.where(self.ok[f] & self.ok[run.black], self.v[f] - self.v[run.black], 0.0)
        light = np.where(light >= DARK, light, 0.0)
        return float(light[run.lit].sum() / light.sum()) if light.sum() > 0 else None

    def copies(self, f: int, g: int, run: _Run) -> bool:
        if not (self.ok[f] & self.ok[g])[run.crescent].all():
            return False
        near = np.abs(self.v[f] - self.v[g])[run.crescent].sum() <= PAIR_LIMIT * run.modulation
        return bool(near) and (self.inside(f, run) or 0.0) >= INSIDE

    def same(self, a: _Run, b: _Run) -> bool:
        """Two runs of one projector: each one's white and black add up to the other's."""
        return self.holds(self.residual(b.white, b.black, a.white, a.black)) and self.holds(self.residual(a.white, a.black, b.white, b.black))

    def lead_in(self, run: _Run, first: int = 0) -> int:
        """Where the copies of a run's white straight before it begin."""
        x = run.start
        while x > first and self.copies(x - 1, run.white, run):
            x -= 1
        return x

    def runs(self) -> list[_Run]:
        found, s = [], 0
        while s + self.length <= self.n:
            run = self.window(s)
            if run is not None and self.phase_steps(run) and self.separates(run) and self.above_black(run):
                found.append(run)
                s += self.length
            else:
                s += 1
        for i, run in enumerate(found):
            self.judge(run, found[i + 1] if i + 1 < len(found) else None)
        return found

    def judge(self, run: _Run, after: _Run | None) -> None:
        if run.crescent.sum() < LEAST_CRESCENT:
            run.verdict = "barely"
            return
        residuals = [self.residual(run.start + a, run.start + b, run.white, run.black) for a, b in self.plan.pairs]
        broken = [r for r in residuals if r is not None and r > PAIR_LIMIT]
        if broken:
            run.verdict, run.residual = "pair", broken[0]
        elif None in residuals:
            run.verdict = "unmeasured"
        else:
            f = run.start + self.length
            if f < self.n and not (after is not None and self.lead_in(after, f) == f):
                rise = np.where(self.ok[f], self.v[f] - self.v[run.black], 0.0)
                share = run.rise[run.crescent & self.ok[f] & (rise >= BLACK_LEVEL * run.rise)].sum() / run.modulation
                if (self.inside(f, run) or 0.0) >= INSIDE and self.level(f, run) >= BLACK_LEVEL and share >= COVERED:
                    run.verdict = "extra"

    def lit_blocks(self, low: int, high: int, black: int | None) -> int:
        """The blocks that some photograph of a stretch lights, above a run's black or else the stretch's own dark."""
        if high <= low:
            return 0
        v, ok = self.v[low:high], self.ok[low:high]
        if black is None:
            ranked, counts = np.sort(np.where(ok, v, np.inf), axis=0), ok.sum(axis=0)
            floor = ranked[np.floor(FLOOR_QUANTILE * np.maximum(counts - 1, 0)).astype(int), np.arange(v.shape[1])]
        else:
            floor, ok = self.v[black], ok & self.ok[black]
        return int((ok & (v - floor >= DARK)).any(axis=0).sum())


def _unseen(lit: int, cut: bool = False) -> str:
    return "unseen" if lit == 0 else "barely" if lit < LEAST_CRESCENT and not cut else "unread"


def _read(folder: _Folder) -> tuple[str | None, list[_Run], dict[int, str]]:
    """Why the folder is refused, its runs with their projector and verdict, and the status of each projector."""
    n, length, projectors = folder.n, folder.length, folder.plan.projectors
    if n < length * projectors - SLACK:
        return "few", [], {}
    runs = folder.runs()
    if not runs:
        return "no-runs", [], {}
    earlier = [[i for i in range(j) if folder.same(runs[i], runs[j])] for j in range(len(runs))]
    own = len(runs)
    while own > 1 and earlier[own - 1]:
        own -= 1
    if any(earlier[:own]):
        return "stepped-back", runs, {}
    # Count from the first run on, as far as gaps are whole runs.
    places = [0]
    for left, right in zip(runs[: own - 1], runs[1:own], strict=True):
        gap = right.start - left.start
        step = math.floor(gap / length + 0.5)
        if abs(gap - step * length) > SLACK:
            break
        places.append(places[-1] + step)
    counted, last = len(places), runs[len(places) - 1]
    end = folder.lead_in(runs[own], last.start + length) if own < len(runs) else n
    before, after = folder.lead_in(runs[0]), end - (last.start + length)
    left_over = lambda a: (before - a * length, after - (projectors - 1 - a - places[-1]) * length)
    readings = [a for a in range(projectors - places[-1]) if min(left_over(a)) >= -SLACK]
    if len(readings) != 1:
        return "ends" if readings else "numbering", runs, {}
    first, allowance = readings[0], length - 1 + length // 4
    front, back = left_over(first)
    if front > allowance or (counted == own and back > allowance):
        return "allowance", runs, {}

    status: dict[int, str] = {}
    for run, place in zip(runs, places, strict=False):
        run.projector = first + place
    for j in range(first):
        high = before - j * length
        status[first - 1 - j] = _unseen(folder.lit_blocks(max(0, high - length), high, None), high < length)
    for left, right in zip(runs[: counted - 1], runs[1:counted], strict=True):
        for k in range(1, right.projector - left.projector):
            low = left.start + k * length
            high = right.start if left.projector + k + 1 == right.projector else low + length
            status[left.projector + k] = _unseen(folder.lit_blocks(low, high, None))
    for k in range(1, projectors - last.projector):
        low = last.start + k * length
        status[last.projector + k] = "uncounted" if counted < own else _unseen(folder.lit_blocks(low, min(end, low + length), last.black))
    for run in runs[counted:own]:
        run.verdict = "uncounted"
    for run, matches in zip(runs[own:], earlier[own:], strict=True):
        known = {runs[i].projector for i in matches} - {None}
        if len(known) == 1:
            run.projector = known.pop()
        else:
            run.verdict = "ambiguous" if known else "unmatched"
    for p in sorted({run.projector for run in runs} - {None}):
        mine = [run for run in runs if run.projector == p]
        good = [run for run in mine if run.verdict is None]
        status[p] = "used" if good else mine[-1].verdict
        for run in good[:-1]:
            run.verdict = "replaced"
    return None, runs, status


def _fault(group: pd.DataFrame, plan: PositionPlan) -> str | None:
    blocks = group["_blocks"]
    size = blocks * blocks
    lengths = [group[c].map(lambda x: -1 if x is None else len(x)) for c in ("_values", "_measured")]
    if blocks.isna().any() or any((n != size).any() for n in lengths):
        return "shape"
    if blocks.nunique() > 1:
        return "grids"
    return "coarse" if blocks.min() < plan.least_blocks else None


def _open(group: pd.DataFrame, plan: PositionPlan) -> tuple[pd.DataFrame, str | None, list[_Run], dict[int, str]]:
    group = group.sort_values("_at", kind="stable").reset_index(drop=True)
    problem = plan.fault() or _fault(group, plan)
    if problem:
        return group, problem, [], {}
    number = lambda row: np.array([np.nan if x is None else x for x in row], dtype=float)
    values = np.stack([number(row) for row in group["_values"]])
    measured = np.stack([np.array([bool(x) for x in row]) for row in group["_measured"]])
    return group, *_read(_Folder(values, measured, plan))


def _grouped(frames: DataFrame, by: Sequence[str], order: str, blocks: str, values: str, measured: str):
    keys = [f"_k{i}" for i in range(len(by))]
    rows = frames.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(order).alias("_at"), F.col(blocks).cast("int").alias("_blocks"), F.col(values).cast("array<double>").alias("_values"), F.col(measured).cast("array<boolean>").alias("_measured"))
    fields = [StructField(k, rows.schema[k].dataType) for k in (*keys, "_at")]
    return keys, rows, fields


def index_position(frames: DataFrame, by: Sequence[str], order: str, plan: PositionPlan, blocks: str = "blocks", values: str = "values", measured: str = "measured") -> DataFrame:
    """``by``, order, projector, place, problem and residual of each photograph of a folder.

    frames: a row a photograph with its fingerprint, ``order`` unique within a
    folder. A run is a window of the plan's length whose white and black light
    a crescent, whose phase frames are steps of one cosine, one of whose pairs
    separates, and none of whose frames is darker than its black; after one
    the scan goes on behind it. Gaps between runs number the projectors, to
    within ``SLACK`` photographs; both ends must allow one first projector
    only. Runs at the end that repeat an earlier run's white and black are
    re-shoots of its projector; the latest run of a projector that passes is used.

    Photographs of a run in use have projector and place (from 0) and no
    problem. Those of other runs have the run's: ``barely`` (under
    ``LEAST_CRESCENT`` blocks), ``pair`` (with the residual of the first pair
    that doesn't add up), ``unmeasured``, ``extra`` (the next photograph is
    more of the run), ``replaced``, ``uncounted`` (behind a gap that isn't
    whole runs), ``unmatched`` or ``ambiguous`` (re-shoots). The rest are
    ``outside``. Refused whole: the faults of the plan, ``shape``, ``grids``,
    ``coarse`` (as in ``index_by_fingerprint``), ``few`` (too few for a
    position), ``no-runs``, ``stepped-back`` (a run repeats an earlier one and
    others follow), ``numbering`` (the ends allow no first projector),
    ``ends`` (several) and ``allowance`` (too many extras at an end).

    Null keys make a folder like any other; blocks that are null, not finite
    or not measured are never read. An empty table gives no rows.
    """
    keys, rows, fields = _grouped(frames, by, order, blocks, values, measured)
    schema = StructType([*fields, StructField("projector", IntegerType()), StructField("place", IntegerType()), StructField("problem", StringType()), StructField("residual", DoubleType())])

    def read(group: pd.DataFrame) -> pd.DataFrame:
        group, refusal, runs, _ = _open(group, plan)
        n = len(group)
        projector, place, residual = [None] * n, [None] * n, [None] * n
        problem = [refusal or "outside"] * n
        for run in () if refusal else runs:
            for i in range(len(plan.kinds)):
                at = run.start + i
                problem[at], residual[at] = run.verdict, run.residual
                if run.verdict is None:
                    projector[at], place[at] = run.projector, i
        out = group[[*keys, "_at"]].copy()
        out["projector"], out["place"] = pd.array(projector, dtype="Int32"), pd.array(place, dtype="Int32")
        out["problem"], out["residual"] = problem, pd.array(residual, dtype="Float64")
        return out

    return rows.groupBy(*keys).applyInPandas(read, schema).withColumnsRenamed(dict(zip([*keys, "_at"], [*by, order], strict=True)))


def position_projectors(frames: DataFrame, by: Sequence[str], order: str, plan: PositionPlan, blocks: str = "blocks", values: str = "values", measured: str = "measured") -> DataFrame:
    """``by``, projector and status of every projector of each folder that ``index_position`` doesn't refuse.

    ``used``; the verdict of its latest run where none passes; without a run
    ``unseen`` (its photographs are dark), ``barely`` (they light fewer than
    ``LEAST_CRESCENT`` blocks), ``unread`` (a run is there and wasn't found)
    or ``uncounted`` (behind a gap that isn't whole runs).
    """
    keys, rows, fields = _grouped(frames, by, order, blocks, values, measured)
    schema = StructType([*fields[:-1], StructField("projector", IntegerType()), StructField("status", StringType())])

    def read(group: pd.DataFrame) -> pd.DataFrame:
        group, _, _, status = _open(group, plan)
        out = pd.DataFrame({"projector": pd.array(sorted(status), dtype="Int32"), "status": pd.Series([status[p] for p in sorted(status)], dtype=object)})
        for k in keys:
            out[k] = pd.Series([group[k].iloc[0]] * len(out), dtype=group[k].dtype)
        return out[[*keys, "projector", "status"]]

    return rows.groupBy(*keys).applyInPandas(read, schema).withColumnsRenamed(dict(zip(keys, by, strict=True)))
