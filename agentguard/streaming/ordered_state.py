"""Folds over the rows of a key in their order, with what is not yet in turn held in the state store.

Neither fold gathers a key: rows are taken from the iterator one by one, at most HELD_ROWS are in memory, and what has to wait for
rows before it goes to map state in parts of that size. The store keeps it on disk (RocksDB), and every entry
leaves with its turn.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

HELD_ROWS = 5000
#: Rows of a key in one micro-batch that are not worth more than one place.
FEW_ROWS = 64
#: Length of the time slots that rows wait in; a slot of one key is sorted in memory.
SLOT_MS = 10_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(df: DataFrame) -> DataFrame:
    """The frame, in a session whose state stores are the kind that these folds need."""
    df.sparkSession.conf.set(STORE, ROCKS)
    return df


class _Waiting:
    """Map state of rows by (place, part), with the number of parts of each place."""

    def __init__(self, handle: StatefulProcessorHandle, columns, types):
        arrays = ", ".join(f"`{c}` array<{t}>" for c, t in zip(columns, types, strict=True))
        self.rows = handle.getMapState("rows", "place bigint, part int", arrays)
        self.parts = handle.getMapState("parts", "place bigint", "n int")

    def add(self, place: int, rows: list[tuple]) -> None:
        """Put rows away."""
        n = self.parts.getValue((place,))[0] if self.parts.containsKey((place,)) else 0
        self.rows.updateValue((place, n), tuple(list(c) for c in zip(*rows, strict=True)))
        self.parts.updateValue((place,), (n + 1,))

    def take(self, place: int) -> list[tuple]:
        """The rows of a place, which leave the state."""
        if not self.parts.containsKey((place,)):
            return []
        out: list[tuple] = []
        for part in range(self.parts.getValue((place,))[0]):
            out += zip(*self.rows.getValue((place, part)), strict=True)
            self.rows.removeKey((place, part))
        self.parts.removeKey((place,))
        return out


class _Runs:
    """Waiting rows of a key in places: ranges of slots, each sixteen times as long as those of the level below it.

    Rows that come together go to as few places as their times allow, so a key with few rows has one, whatever time they span. What is
    known of a place (parts, rows, first and last slot) is one value of the state. Places are cut again only where their turn comes.
    """

    INDEX = "places array<bigint>, parts array<int>, counts array<bigint>, firsts array<bigint>, lasts array<bigint>, timer bigint"
    TOP = 15

    def __init__(self, handle: StatefulProcessorHandle, columns, types, held_rows: int):
        arrays = ", ".join(f"`{c}` array<{t}>" for c, t in zip(columns, types, strict=True))
        self.rows = handle.getMapState("rows", "place bigint, part int", arrays)
        self.index = handle.getValueState("parts", self.INDEX)
        self.held_rows = held_rows

    def open(self) -> None:
        """Read what is known of the current key's places."""
        *lists, self.timer = self.index.get() if self.index.exists() else ([], [], [], [], [], None)
        self.places = {p: list(known) for p, *known in zip(*lists, strict=True)}
        self.stored = bool(self.places)

    def close(self) -> None:
        if self.places:
            ps = list(self.places)
            self.index.update((ps, *[[self.places[p][k] for p in ps] for k in range(4)], self.timer))
        elif self.stored:
            self.index.clear()

    def first(self) -> int | None:
        """The first slot that holds rows."""
        return min((e[2] for e in self.places.values()), default=None)

    def add(self, rows: list[tuple], whole: bool = False) -> None:
        """Put rows away; with `whole`, in one place."""
        slots = [r[0] // (1000 * SLOT_MS) for r in rows]
        for place, at in self._by_place(slots, self.TOP if whole else self._level(min(slots), max(slots))).items():
            self._put(place, [rows[k] for k in at], [slots[k] for k in at])

    @staticmethod
    def _level(low: int, high: int) -> int:
        """The lowest level at which the slots are in sixteen places at most."""
        level = 0
        while (high >> 4 * level) - (low >> 4 * level) > 15:
            level += 1
        return level

    @staticmethod
    def _by_place(slots, level: int) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for k, slot in enumerate(slots):
            out.setdefault((slot >> 4 * level) * 32 + level, []).append(k)
        return out

    def _put(self, place: int, rows, slots) -> None:
        known = self.places.setdefault(place, [0, 0, slots[0], slots[0]])
        self.rows.updateValue((place, known[0]), tuple(list(c) for c in zip(*rows, strict=True)))
        known[:] = known[0] + 1, known[1] + len(rows), min(known[2], *slots), max(known[3], *slots)

    def _take(self, place: int) -> Iterator[list[tuple]]:
        """The parts of a place, which leave the state."""
        for part in range(self.places.pop(place)[0]):
            rows = list(zip(*self.rows.getValue((place, part)), strict=True))
            self.rows.removeKey((place, part))
            yield rows

    def _cut(self, place: int) -> None:
        """Put the rows of a place into places of a lower level, `held_rows` of each in memory."""
        level = min(self._level(*self.places[place][2:]), place % 32 - 1)
        held: dict[int, tuple[list, list]] = {}
        for rows in self._take(place):
            slots = [r[0] // (1000 * SLOT_MS) for r in rows]
            for to, at in self._by_place(slots, level).items():
                mine = held.setdefault(to, ([], []))
                mine[0].extend(rows[k] for k in at)
                mine[1].extend(slots[k] for k in at)
                if len(mine[0]) >= self.held_rows:
                    self._put(to, *held.pop(to))
        for to, mine in held.items():
            self._put(to, *mine)

    def take_before(self, end: int) -> Iterator[list[tuple]]:
        """The rows before a slot in their order, some at a time; they leave the state."""
        most = 4 * self.held_rows
        while True:
            due = sorted((e[2], p) for p, e in self.places.items() if e[2] < end)
            if not due:
                return
            taken, rows = [], 0
            for _, p in due:
                if taken and rows + self.places[p][1] > most:
                    break
                taken.append(p)
                rows += self.places[p][1]
            bound = end if len(taken) == len(due) else due[len(taken)][0]
            if bound == due[0][0]:
                taken, bound = [p for first, p in due if first == bound], bound + 1
            wide = [p for p in taken if self.places[p][3] >= bound and self.places[p][3] > self.places[p][2]]
            if rows > most:
                wide = wide or [p for p in taken if self.places[p][3] > self.places[p][2] and self.places[p][1] > most]
            if wide and (rows > most or len(taken) < len(due)):
                for p in wide:
                    self._cut(p)
                continue
            out = [r for p in taken for part in self._take(p) for r in part]
            later = [r for r in out if r[0] // (1000 * SLOT_MS) >= bound]
            for k in range(0, len(later), self.held_rows):
                self.add(later[k:k + self.held_rows], whole=len(later) <= FEW_ROWS)
            yield sorted((r for r in out if r[0] // (1000 * SLOT_MS) < bound) if later else out, key=lambda r: r[:2])


def _same(state):
    return state


class TimeFold(StatefulProcessor):
    """`step(state, row) -> (state, outputs)` over the rows of a key by time and id, once the watermark has passed them.

    A row that comes behind the watermark is not lost: it is taken at once, after the rows that have been given out.
    Rows are (microseconds, id, ...); `fold` is the schema of the state, a tuple that is None before the first row. `keep(state, us)`
    says whether a state can still matter at a time, and `wake(state)` when to ask that; where it cannot, it leaves the store.
    A step may work on another form of the state, which it may change: `load` makes it of the tuple and `save` the tuple of it.

    A key has one timer, for the slot of its first waiting row, and all slots that the watermark has passed are taken with it.
    """

    def __init__(self, columns, types, names, fold: str, step, keep=None, wake=None, held_rows: int = HELD_ROWS, load=_same, save=_same):
        self.columns, self.types, self.fold_schema, self.step, self.keep, self.wake = columns, types, fold, step, keep, wake
        self.names, self.held_rows, self.load, self.save = names, held_rows, load, save

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = _Runs(handle, self.columns, self.types, self.held_rows)
        self.fold = handle.getValueState("fold", self.fold_schema)
        self.out_row = Row(*self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held: list[tuple] = []
        at, cut = None, False
        self.waiting.open()
        for row in rows:
            if at is None:
                at = [row.__fields__.index(c) for c in self.columns] if isinstance(row, Row) else self.columns
            held.append(tuple([row[c] for c in at]))
            if len(held) >= self.held_rows:
                self.waiting.add(held)
                held, cut = [], True
        if held:
            self.waiting.add(held, whole=not cut and len(held) <= FEW_ROWS)
        self._set_timer()
        self.waiting.close()
        return iter(())

    def _set_timer(self) -> None:
        first = self.waiting.first()
        if first is not None and (self.waiting.timer is None or (first + 1) * SLOT_MS < self.waiting.timer):
            self.waiting.timer = (first + 1) * SLOT_MS
            self.handle.registerTimer(self.waiting.timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        at = max(fired, timerValues.getCurrentWatermarkInMs()) // SLOT_MS * SLOT_MS
        self.waiting.open()
        state = self.load(tuple(self.fold.get())) if self.fold.exists() else None
        changed = False
        for rows in self.waiting.take_before(at // SLOT_MS):
            changed = True
            for row in rows:
                state, outputs = self.step(state, row)
                for out in outputs:
                    yield self.out_row(*key, *out)
        if self.waiting.timer is not None and self.waiting.timer <= at:
            self.waiting.timer = None
        self._set_timer()
        self.waiting.close()
        if self.keep is not None and state is not None and not self.keep(state, at * 1000):
            self.fold.clear()
        elif state is not None:
            if changed:
                self.fold.update(self.save(state))
            if self.wake is not None and self.waiting.timer is None and (later := self.wake(state)) > at * 1000:
                # A look at the state when it may have ended.
                self.handle.registerTimer((later // (1000 * SLOT_MS) + 1) * SLOT_MS)

    def close(self) -> None:
        pass


class SequenceFold(StatefulProcessor):
    """`step(state, row) -> (state, outputs)` over the rows of a key by a number that counts from 0 without gaps.

    A row is given out as soon as all before it have come. Rows are (number, last, ...): a true `last` ends the key, and its
    state leaves the store.
    """

    def __init__(self, columns, types, names, fold: str, step, held_rows: int = HELD_ROWS):
        self.columns, self.types, self.fold_schema, self.step = columns, types, fold, step
        self.names, self.held_rows = names, held_rows
        self.nothing = (None,) * len(StructType.fromDDL(fold).names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = _Waiting(handle, self.columns, self.types)
        self.out_row = Row(*self.names)
        # One value: each call of the store is a message to the JVM, and most keys have few rows.
        self.fold = handle.getValueState("fold", f"number bigint, begun boolean, {self.fold_schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.fold.get() if self.fold.exists() else None
        number, begun, *fold = known or (0, False)
        state = tuple(fold) if begun else None
        held: dict[int, tuple] = {}
        ended, stored = False, known is not None
        for row in rows:
            values = tuple(row[c] for c in self.columns)
            held[values[0]] = values
            if len(held) >= self.held_rows:
                for place, one in held.items():
                    self.waiting.add(place, [one])
                held, stored = {}, True
            while True:
                found = [held.pop(number)] if number in held else self.waiting.take(number) if stored else []
                if not found:
                    break
                state, outputs = self.step(state, found[0])
                ended = ended or bool(found[0][1])
                number += 1
                for out in outputs:
                    yield self.out_row(*key, *out)
        for place, one in held.items():
            self.waiting.add(place, [one])
        if ended:
            self.fold.clear()
        else:
            self.fold.update((number, state is not None, *(state or self.nothing)))

    def close(self) -> None:
        pass
