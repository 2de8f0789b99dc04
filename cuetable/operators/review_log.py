"""The review log folded in pieces: every piece is summed up as a function from the state before it to the state after it.

What an event does depends on whether its item exists, is busy, exporting, ready or reviewed, and on whether the revision held is the
one the event names. So a piece of a log has few different ways to go: one for each of those flags, and one more for each revision that it compares the one
before it with. All ways of all pieces run side by side, as columns; strings come in only by the place of the event that set them. One walk
over the summaries, a row a way, gives each piece the state it starts from, and then all pieces run once more for their outcomes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.plans.folders import cut_lineage
from cuetable.plans.ordered import EvenTime, ordered
from cuetable.plans.shipping import ship
from cuetable.plans.sizes import broadcast_if_small

PIECE = 128
ACTIONS = ("add", "claim", "processing", "analysis", "save", "approve", "unapprove", "export", "export_status", "remove")
ADD, CLAIM, PROCESSING, ANALYSIS, SAVE, APPROVE, UNAPPROVE, EXPORT, EXPORT_STATUS, REMOVE = range(len(ACTIONS))
CONFLICTS = ("", "unknown item", "not claimable", "processing", "changed elsewhere", "not ready", "revision changed", "not reviewed", "work under way")
FIELDS = ("processing", "error", "revision", "reviewed_revision", "export_status", "export_error", "exported_revision", "output")
P, ERROR, REVISION, REVIEWED, STATUS, X_ERROR, EXPORTED, OUTPUT = range(len(FIELDS))
NEW = ("pending", "", "", "", "idle", "", "", "")
#: Where a field's value comes from when no event of the piece set it: from before the piece, or from a new item.
BEFORE, FRESH = -1, -2
#: Codes of revisions: empty, null, then those that occur; below, the one held and the one reviewed before the piece, not yet compared.
EMPTY, NULL, HELD, HELD_REVIEWED, UNGUARDED = 0, 1, -1, -2, -9


def prepared(events: DataFrame) -> DataFrame:
    """Events with their action as a number, what their status means, and the value each field takes if they set it."""
    act, text = F.col("action"), lambda c: F.coalesce(F.col(c), F.lit(""))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ACTIONS)), act) - 1, F.lit(-1)).cast("int")
    is_in = lambda values: F.coalesce(F.col("status").isin(*values), F.lit(False))
    values = {
        "processing": F.when(act == "claim", "queued").when(act == "processing", F.col("status")).otherwise("ready"),
        "error": F.when(act == "processing", text("error")).otherwise(""), "revision": F.col("revision"),
        "reviewed_revision": F.when(act == "approve", F.col("revision")).otherwise(""),
        "export_status": F.when(act == "export", "queued").otherwise(F.col("status")),
        "export_error": F.when(act == "export_status", text("error")).otherwise(""),
        "exported_revision": text("revision"), "output": text("output")}
    return events.select(
        "item_id", "_n", F.floor(F.col("_n") / PIECE).alias("_piece"), F.unix_micros("ts").alias("ts"), "seq", "action", code.alias("_act"), "expected",
        is_in(fixed.BUSY).alias("_busy"), is_in(fixed.EXPORTING).alias("_exporting"), is_in(["force"]).alias("_forced"), is_in(["done"]).alias("_done"),
        *[values[f].alias(f"_{f}") for f in FIELDS])


class Ways:
    """Ways through pieces, as columns: the piece of each, its state so far, and the event that set each field."""

    def __init__(self, piece: np.ndarray, flags: np.ndarray, held: np.ndarray, reviewed: np.ndarray):
        self.piece, self.held, self.reviewed = piece, held.copy(), reviewed.copy()
        self.exists, self.busy, self.exporting, self.ready = (flags[:, i].copy() for i in range(4))
        self.source = np.full((len(FIELDS), len(piece)), BEFORE, np.int32)

    def forget(self, rows: np.ndarray) -> None:
        self.source[:, rows] = FRESH
        self.held[rows] = self.reviewed[rows] = EMPTY
        self.busy[rows] = self.exporting[rows] = self.ready[rows] = False


class Pieces:
    """Complete pieces of logs, an event a row, in order of piece and place."""

    def __init__(self, rows: pd.DataFrame, more: list[np.ndarray] | None = None):
        start = np.flatnonzero(np.append(True, (rows["item_id"].to_numpy()[1:] != rows["item_id"].to_numpy()[:-1]) | (rows["_piece"].to_numpy()[1:] != rows["_piece"].to_numpy()[:-1])))
        self.start, self.size = start, np.diff(np.append(start, len(rows)))
        revisions = [rows["_revision"].to_numpy(object), rows["expected"].to_numpy(object), *(more or [])]
        codes, self.revisions = pd.factorize(np.concatenate([["", "-"], *revisions]))
        none = np.concatenate([[False, False], *[pd.isna(x) for x in revisions]])
        codes = np.where(none, NULL, codes)  # the dash stands where null does
        real = np.flatnonzero(~none[2:] & (np.concatenate(revisions) == "-")) + 2
        if len(real):  # a revision that is a dash itself
            codes[real] = len(self.revisions)
            self.revisions = np.append(self.revisions, "-")
        at = np.cumsum([2, *map(len, revisions)])
        self.codes = [codes[a:b].astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.revision, self.expected = self.codes[0], np.where(self.codes[1] == NULL, UNGUARDED, self.codes[1])
        self.act = rows["_act"].to_numpy()
        self.to_busy, self.to_exporting, self.forced, self.done = (rows[c].to_numpy(bool) for c in ("_busy", "_exporting", "_forced", "_done"))

    def run(self, w: Ways, each: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> set[tuple[int, int, int]]:
        """Takes ``w`` through all events; returns the revisions compared with unknown ones, as piece, which of the two, and code."""
        compared: set[tuple[int, int, int]] = set()

        def same(rows: np.ndarray, known: np.ndarray, other: np.ndarray) -> np.ndarray:
            unknown = other < 0
            if unknown.any():
                compared.update(zip(w.piece[rows[unknown]].tolist(), other[unknown].tolist(), known[unknown].tolist(), strict=True))
            return known == other

        for t in range(int(self.size.max(initial=0))):
            live = np.flatnonzero(self.size[w.piece] > t)
            event = self.start[w.piece[live]] + t
            act, conflict = self.act[event], np.zeros(len(live), np.int8)
            born = live[~w.exists[live] & np.isin(act, (ADD, PROCESSING, ANALYSIS, SAVE))]
            w.forget(born)
            w.exists[born] = True
            conflict[~w.exists[live]] = 1
            here = conflict == 0

            def of(*kinds: int, here=here, act=act) -> np.ndarray:
                return np.flatnonzero(here & np.isin(act, kinds))

            def refuse(at: np.ndarray, bad: np.ndarray, reason: int, conflict=conflict) -> np.ndarray:
                conflict[at[bad]] = reason
                return at[~bad]

            def put(rows: np.ndarray, *fields: int, t=t) -> None:
                for f in fields:
                    w.source[f, rows] = t

            at = of(CLAIM)
            at = refuse(at, w.busy[live[at]] | w.exporting[live[at]] | (w.ready[live[at]] & ~self.forced[event[at]]), 2)
            put(live[at], P, ERROR)
            w.busy[live[at]] = True

            at = of(PROCESSING)
            put(live[at], P, ERROR)
            w.busy[live[at]] = self.to_busy[event[at]]

            at = of(SAVE)
            at = refuse(at, w.busy[live[at]], 3)
            guarded = self.expected[event[at]] != UNGUARDED
            bad = np.zeros(len(at), bool)
            bad[guarded] = ~same(live[at[guarded]], self.expected[event[at[guarded]]], w.held[live[at[guarded]]])
            at = refuse(at, bad, 4)
            put(live[at], P, REVISION)
            seen = of(ANALYSIS)
            put(live[seen], P, ERROR, REVISION)
            at = np.concatenate([at, seen])
            w.held[live[at]], w.ready[live[at]], w.busy[live[at]] = self.revision[event[at]], True, False

            at = of(APPROVE, UNAPPROVE)
            at = refuse(at, w.busy[live[at]] | ~w.ready[live[at]], 5)
            at = refuse(at, self.revision[event[at]] <= NULL, 6)
            at = refuse(at, ~same(live[at], self.revision[event[at]], w.held[live[at]]), 6)
            put(live[at], REVIEWED)
            w.reviewed[live[at]] = np.where(act[at] == APPROVE, w.held[live[at]], EMPTY)

            at = of(EXPORT)
            at = refuse(at, (w.held[live[at]] == EMPTY) | (w.held[live[at]] == NULL), 7)
            known = w.held[live[at]] >= 0
            bad = w.held[live[at]] != w.reviewed[live[at]]  # unknown against unknown is settled by the flags
            bad[known] = ~same(live[at[known]], w.held[live[at[known]]], w.reviewed[live[at[known]]])
            at = refuse(at, bad, 7)
            at = refuse(at, w.busy[live[at]] | w.exporting[live[at]], 8)
            put(live[at], STATUS, X_ERROR)
            w.exporting[live[at]] = True

            at = of(EXPORT_STATUS)
            put(live[at], STATUS, X_ERROR)
            w.exporting[live[at]] = self.to_exporting[event[at]]
            put(live[at[self.done[event[at]]]], EXPORTED, OUTPUT)

            at = of(REMOVE)
            at = refuse(at, w.busy[live[at]] | w.exporting[live[at]], 8)
            w.forget(live[at])
            w.exists[live[at]] = False
            if each:
                each(t, live, event, conflict)
        return compared


#: Flags an item can have before a piece: existing, busy, exporting, ready, reviewed; a reviewed one is ready.
ENTRIES = np.array([(0, 0, 0, 0, 0), *[(1, b, e, r, v) for b in (0, 1) for e in (0, 1) for r, v in ((0, 0), (1, 0), (1, 1))]], bool)
WAYS_DDL = ("item_id string, _piece bigint, entry int, any_held boolean, held string, any_reviewed boolean, reviewed string, "
            "`exists` boolean, busy boolean, exporting boolean, ready boolean, source array<int>, value array<string>")


def batches_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows sorted by item and piece, the last piece of a batch kept back until it is whole."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        last = (rows["item_id"] == rows["item_id"].iloc[-1]) & (rows["_piece"] == rows["_piece"].iloc[-1])
        cut = int((~last).to_numpy().nonzero()[0].max(initial=-1)) + 1
        if cut or (kept and (kept[-1]["item_id"].iloc[-1], kept[-1]["_piece"].iloc[-1]) != (rows["item_id"].iloc[0], rows["_piece"].iloc[0])):
            yield pd.concat([*kept, rows.iloc[:cut]], ignore_index=True)
            kept = []
        kept.append(rows.iloc[cut:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def summed_up(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each way through each piece."""
    pieces = Pieces(rows)
    n, done, out = len(pieces.start), set(), []
    first = rows["_piece"].to_numpy()[pieces.start] == 0
    todo = [(k, e, HELD if ENTRIES[e][0] else EMPTY, (HELD if ENTRIES[e][4] else HELD_REVIEWED) if ENTRIES[e][0] else EMPTY)
            for k in range(n) for e in range(1 if first[k] else len(ENTRIES))]
    helds: dict[int, set[int]] = {}
    revieweds: dict[int, set[int]] = {}
    while todo:
        done.update(todo)
        piece, entry, held, reviewed = (np.array(x, np.int64) for x in zip(*todo, strict=True))
        ways = Ways(piece, ENTRIES[entry], held, reviewed)
        for k, which, code in pieces.run(ways):
            (helds if which == HELD else revieweds).setdefault(k, set()).add(code)
        event = np.where(ways.source >= 0, pieces.start[piece] + ways.source, 0)
        values = np.stack([np.where(ways.source[f] >= 0, rows[f"_{name}"].to_numpy(object)[event[f]], None) for f, name in enumerate(FIELDS)], 1)
        label = lambda codes: np.where((codes < 0) | (codes == NULL), None, pieces.revisions[np.maximum(codes, 0)])
        at = pieces.start[piece]
        out.append(pd.DataFrame({
            "item_id": rows["item_id"].to_numpy()[at], "_piece": rows["_piece"].to_numpy()[at], "entry": entry, "any_held": held < 0, "held": label(held), "any_reviewed": reviewed < 0,
            "reviewed": label(reviewed), "exists": ways.exists, "busy": ways.busy, "exporting": ways.exporting, "ready": ways.ready, "source": list(ways.source.T), "value": list(values)}))
        todo = []
        for k in {*helds, *revieweds}:  # a way for each revision that was compared, also with those found since
            for e in range(1, len(ENTRIES)):
                if ENTRIES[e][4]:
                    todo += [(k, e, c, c) for c in helds.get(k, ()) if c > NULL]
                else:
                    todo += [(k, e, h, r) for h in (HELD, *helds.get(k, ())) for r in (HELD_REVIEWED, *revieweds.get(k, ())) if h != r or h <= NULL]
        todo = [x for x in todo if x not in done]
    return pd.concat(out)


class State:
    """A concrete state between two pieces."""

    def __init__(self) -> None:
        self.exists = self.busy = self.exporting = self.ready = False
        self.values: list[str | None] = list(NEW)

    def entry(self) -> int:
        reviewed = self.exists and bool(self.values[REVISION]) and self.values[REVISION] == self.values[REVIEWED]
        flags = (self.exists, self.busy, self.exporting, self.ready, reviewed) if self.exists else (False,) * 5
        return ENTRY_OF[flags]

    def after(self, ways: dict[tuple, tuple]) -> None:
        """The state after a piece, by the way that starts from this state."""
        entry = self.entry()
        if not self.exists:
            way = ways[0, "", ""]
        else:
            held, reviewed = self.values[REVISION], self.values[REVIEWED]
            held = held if ("held", held) in ways else ANY
            if ENTRIES[entry][4]:
                reviewed = held
            else:
                reviewed = reviewed if ("reviewed", reviewed) in ways else ANY
            way = ways[entry, held, reviewed]
        self.exists, self.busy, self.exporting, self.ready, source, value = way
        self.values = [v if s >= 0 else NEW[f] if s == FRESH else self.values[f] for f, (s, v) in enumerate(zip(source, value, strict=True))]


ANY = object()
ENTRY_OF = {tuple(map(bool, e)): i for i, e in enumerate(ENTRIES)}
ENTRIES_DDL = "item_id string, _piece bigint, `exists` boolean, busy boolean, exporting boolean, ready boolean, " + ", ".join(f"_{f} string" for f in FIELDS)


def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state each piece but an item's first starts from; rows come sorted by item and piece, and one state is held."""
    item, piece, state, ways, out = None, None, State(), {}, []

    def close() -> None:
        if ways:
            state.after(ways)
            out.append((item, piece + 1, state.exists, state.busy, state.exporting, state.ready, *state.values))

    names = [c.split()[0].strip("`") for c in ENTRIES_DDL.split(", ")]
    for frame in frames:
        frame = frame.astype(object).where(frame.notna(), None)
        for r in frame.itertuples(index=False):
            own, at, entry, any_held, held, any_reviewed, reviewed, *way = r
            if (own, at) != (item, piece):
                close()
                ways = {}
                if own != item:
                    state = State()
                item, piece = own, at
            if not any_held and entry:
                ways["held", held] = ()
            if not any_reviewed and entry and not ENTRIES[entry][4]:
                ways["reviewed", reviewed] = ()
            ways[entry, ANY if any_held else held, ANY if any_reviewed else reviewed] = tuple(way)
        yield pd.DataFrame(out, columns=names)
        out = []
    close()
    yield pd.DataFrame(out, columns=names)


OUTCOME_DDL = ("item_id string, ts timestamp, seq bigint, action string, accepted boolean, conflict string, `exists` boolean, processing string, ready boolean, revision string, "
               "reviewed_revision string, exported_revision string, export_status string, error string, export_error string, output string")


def told(rows: pd.DataFrame) -> pa.RecordBatch:
    """Outcomes of the events of complete pieces; a piece's first row may be the state it starts from."""
    head = rows["_n"].to_numpy() < 0
    events = rows[~head].reset_index(drop=True)
    heads = {(i, p): k for k, (i, p) in enumerate(zip(rows["item_id"][head], rows["_piece"][head], strict=True))}
    given = rows[head].reset_index(drop=True)
    first = events.drop_duplicates(["item_id", "_piece"])
    from_head = np.array([heads.get(k, -1) for k in zip(first["item_id"], first["_piece"], strict=True)], np.int64)
    pieces = Pieces(events, [given["_revision"].to_numpy(object), given["_reviewed_revision"].to_numpy(object)])
    take = lambda values, none: np.where(from_head >= 0, np.append(values, none)[from_head], none)
    flags = np.stack([take(given[c].to_numpy(), False).astype(bool) for c in ("exists", "busy", "exporting", "ready")], 1) if len(first) else np.zeros((0, 4), bool)
    ways = Ways(np.arange(len(first)), flags, take(pieces.codes[2], EMPTY), take(pieces.codes[3], EMPTY))
    n = len(events)
    conflict, exists, ready = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool)
    source = np.zeros((len(FIELDS), n), np.int64)

    def each(t: int, live: np.ndarray, event: np.ndarray, refused: np.ndarray) -> None:
        conflict[event], exists[event], ready[event] = refused, ways.exists[live], ways.ready[live]
        before = np.where(from_head[live] >= 0, n + from_head[live], n + len(given))
        origin = ways.source[:, live]
        source[:, event] = np.where(origin >= 0, pieces.start[live] + origin, np.where(origin == BEFORE, before, n + len(given)))

    pieces.run(ways, each)
    shown = {f: pa.array(np.concatenate([events[f"_{f}"].to_numpy(object), given[f"_{f}"].to_numpy(object), [NEW[i]]]), pa.string(), from_pandas=True).take(pa.array(source[i])) for i, f in enumerate(FIELDS)}
    shown |= {"item_id": pa.array(events["item_id"], pa.string()), "ts": pa.array(events["ts"], pa.int64(), from_pandas=True), "seq": pa.array(events["seq"], pa.int64()),
              "action": pa.array(events["action"], pa.string(), from_pandas=True), "accepted": pa.array(conflict == 0), "conflict": pa.array(np.array(CONFLICTS, object)[conflict], pa.string()), "exists": pa.array(exists), "ready": pa.array(ready)}
    names = [c.split()[0].strip("`") for c in OUTCOME_DDL.split(", ")]
    return pa.RecordBatch.from_arrays([shown[c] for c in names], names)


def review_outcomes(events: DataFrame, span_ms: int = 86_400_000) -> DataFrame:
    """Every event with its outcome and the item's state after it.

    ``events(item_id, ts, seq, action, revision, expected, status, error, output)``, in order of time. One item's log is dealt over tasks
    in pieces; only the summaries of an item with several pieces are walked through in order, and that walk holds one state.
    """
    ship(events.sparkSession)
    numbered = ordered(events.withColumn("_ms", F.unix_millis("ts")), ["item_id"], ["ts", "seq"], EvenTime("_ms", span_ms), number="_n")
    log = cut_lineage(prepared(numbered), "review-events")
    longer = log.groupBy("item_id").agg(F.max("_piece").alias("_last")).filter("_last > 0")
    earlier = log.join(broadcast_if_small(cut_lineage(longer, "review-items")), "item_id").filter("_piece < _last").drop("_last")
    laid = lambda rows: rows.repartition("item_id", "_piece").sortWithinPartitions("item_id", "_piece", "_n")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_pieces(batches):
            out = summed_up(rows)
            yield pa.RecordBatch.from_pandas(out, WAYS_SCHEMA, preserve_index=False)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_pieces(batches):
            yield told(rows)

    ways = laid(earlier).drop("ts", "seq", "action").mapInArrow(sum_up, WAYS_DDL)
    starts = cut_lineage(ways.repartition("item_id").sortWithinPartitions("item_id", "_piece").mapInPandas(walk, ENTRIES_DDL), "review-states")
    heads = starts.withColumn("_n", F.lit(-1).cast("bigint"))
    out = laid(log.unionByName(heads, allowMissingColumns=True)).mapInArrow(tell, OUTCOME_DDL.replace("ts timestamp", "ts bigint"))
    return out.withColumn("ts", F.timestamp_micros("ts"))


WAYS_SCHEMA = pa.schema([("item_id", pa.string()), ("_piece", pa.int64()), ("entry", pa.int32()), ("any_held", pa.bool_()), ("held", pa.string()), ("any_reviewed", pa.bool_()),
                         ("reviewed", pa.string()), ("exists", pa.bool_()), ("busy", pa.bool_()), ("exporting", pa.bool_()), ("ready", pa.bool_()),
                         ("source", pa.list_(pa.int32())), ("value", pa.list_(pa.string()))])
