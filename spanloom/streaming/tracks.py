"""Text tracks: readings of one text followed from frame to frame, on tables and on streams.

``Follower`` holds the open tracks of a source and takes one moment after the other. On a table it is
a fold over natural runs of a source; on a stream it lives in the state of ``transformWithState``: readings wait
in a list until the watermark has passed their time, so late ones still come in order, and timers
by event time close tracks and confirm their ends. State of a source goes when its last track does.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from spanloom.operators.folds import folded, runs
from spanloom.sources.shipping import ship

# Sampling steps after which a track is closed, seconds of absence that confirm its end, seconds the blur goes on then.
ABSENCE_STEPS, CONFIRM, TAIL = 2.5, 3.0, 0.5
# Letters and share of a text that lies in another one, matching runs and shared runs of three letters that go on with a text.
PIECE, PIECE_SHARE, ALIKE, SHARED = 4, 0.38, 0.48, 0.42
# Zones of the middle, whose texts may belong to the film.
INNER_ZONES = ("middle-center", "top-center", "subtitle")
SIDES = ("x1", "y1", "x2", "y2")
TRACK = "source {}, start double, end double, blur_end double, confirmed boolean, observations long, zone string, x1 double, y1 double, x2 double, y2 double, text string, confidence double, persistent boolean, priority string"
READING = StructType([StructField(c, DoubleType()) for c in ("t", "confidence", *SIDES)] + [StructField(c, StringType()) for c in ("zone", "text")])


def goes_on(before: str, now: str) -> bool:
    """Whether a text is another reading of one, so that changing subtitles are no track."""
    a, b = ("".join(c for c in x.upper() if c.isalnum()) for x in (before or "", now or ""))
    if not a or not b:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if a == b or (len(short) >= PIECE and short in long and len(short) >= PIECE_SHARE * len(long)):
        return True
    threes = [{x[k : k + 3] for k in range(len(x) - 2)} for x in (a, b)]
    fewer = min(map(len, threes))
    return (fewer > 0 and len(threes[0] & threes[1]) >= SHARED * fewer) or SequenceMatcher(None, a, b, autojunk=False).ratio() >= ALIKE


def overlap(a: tuple, b: tuple) -> float:
    common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / total if total > 0 else 0.0


def same_place(last: tuple, box: tuple) -> bool:
    """A fifth in common, or centres that are near for the size of the last box."""
    off = [abs((last[i] + last[i + 2]) - (box[i] + box[i + 2])) / 2 for i in (0, 1)]
    near = off[0] <= max(24.0, 0.45 * max(1, last[2] - last[0])) and off[1] <= max(18.0, 0.55 * max(1, last[3] - last[1]))
    return near or overlap(last, box) >= 0.20


class Follower:
    """Open tracks of a source: dicts of start, last (time), n, zone, box (the last), union, text (the last), best (text and confidence)."""

    def __init__(self, every: float, open_: list[dict] | None = None):
        self.every, self.open = every, open_ or []

    def moment(self, t: float, readings: list) -> None:
        """Readings of one frame, the surest first, each to the free track of its zone, place and text that it overlaps most."""
        free = [k for k in self.open if t - k["last"] <= ABSENCE_STEPS * self.every]
        for r in sorted(readings, key=lambda r: (-r.confidence, r.x1, r.y1, r.x2, r.y2, r.text or "")):
            box = tuple(getattr(r, s) for s in SIDES)
            fits = [k for k in free if k["zone"] == r.zone and same_place(k["box"], box) and goes_on(k["text"], r.text)]
            track = max(fits, key=lambda k: overlap(k["box"], box), default=None)
            if track is None:
                track = {"start": t, "n": 0, "zone": r.zone, "union": box, "confidence": -1.0, "shown": ""}
                self.open.append(track)
            else:
                free = [k for k in free if k is not track]
            u = track["union"]
            track.update(last=t, n=track["n"] + 1, box=box, text=r.text or "", union=(min(u[0], box[0]), min(u[1], box[1]), max(u[2], box[2]), max(u[3], box[3])))
            if r.confidence > track["confidence"]:
                track.update(confidence=r.confidence, shown=r.text or "")

    def due(self, track: dict) -> float:
        """When a track is closed and its end is confirmed."""
        return track["last"] + max(ABSENCE_STEPS * self.every, self.every + CONFIRM)

    def told(self, source, track: dict, through: float) -> tuple:
        absent = track["last"] + self.every
        confirmed = through - absent >= CONFIRM
        persistent = track["n"] >= 3 and track["last"] - track["start"] >= 2 * self.every
        priority = "low" if not persistent else "medium" if track["zone"] in INNER_ZONES else "high"
        return (source, track["start"], absent, absent + (TAIL if confirmed else CONFIRM), confirmed, track["n"], track["zone"], *track["union"], track["shown"], track["confidence"], persistent, priority)

    def closed(self, source, t: float) -> Iterator[tuple]:
        """Tracks that are due before t, which leave the state."""
        for k in [k for k in self.open if self.due(k) < t]:
            yield self.told(source, k, t)
        self.open = [k for k in self.open if self.due(k) >= t]


def text_tracks(readings: DataFrame, every: float) -> DataFrame:
    """Tracks of readings (source, t, confidence, x1, y1, x2, y2, zone, text) of a table, which is read through for all sources.

    A reading goes on with a track of its zone and place whose last text it continues, at most 2.5 steps after that one's last
    sighting. An end is confirmed if the source was read for CONFIRM seconds after it. Returns (source, start, end, blur_end, confirmed, observations, zone,
    x1, y1, x2, y2, text, confidence, persistent, priority).
    """
    ship(readings.sparkSession)
    least = max(ABSENCE_STEPS * every, every + CONFIRM)
    through = readings.groupBy("source").agg(F.max("t").alias("through"))
    cut = runs(readings.withColumn("until", F.col("t")), "source", "t", "until", least).join(through, "source")

    def fold(rows: Iterator) -> Iterator[tuple]:
        follower, source, end = Follower(every), None, None
        for t, moment in itertools.groupby(rows, key=lambda r: r.t):
            moment = list(moment)
            source, end = moment[0].source, moment[0].through
            yield from ((*x[:3], x[2] + (TAIL if end - x[2] >= CONFIRM else CONFIRM), end - x[2] >= CONFIRM, *x[5:]) for x in follower.closed(source, t))
            follower.moment(t, moment)
        yield from (follower.told(source, k, end) for k in follower.open)

    return folded(cut, ["source", "run"], ["t"], fold, TRACK.format(readings.schema["source"].dataType.simpleString()))


class _Tracks(StatefulProcessor):
    def __init__(self, every: float, columns: list[str]):
        self.every, self.columns = every, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", READING)
        fields = [StructField(c, DoubleType()) for c in ("start", "last", "n", "confidence", *SIDES, *[f"u_{s}" for s in SIDES])]
        self.tracks = handle.getListState("tracks", StructType(fields + [StructField(c, StringType()) for c in ("zone", "text", "shown")]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList([tuple(None if pd.isna(r[c]) else r[c] for c in READING.names) for r in pdf.to_dict("records")])
            for t in set(pdf["t"]):
                self.handle.registerTimer(int(t * 1000))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All readings that the watermark has passed, in order; later timers of the same batch find nothing left."""
        now = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = [r for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((_Row(r) for r in waiting if r[0] < now), key=lambda r: r.t)
        follower, out = Follower(self.every, [self._track(x) for x in self.tracks.get()] if self.tracks.exists() else []), []
        for t, moment in itertools.groupby(ready, key=lambda r: r.t):
            out += follower.closed(key[0], t)
            follower.moment(t, list(moment))
        out += follower.closed(key[0], now)
        rest = [tuple(r) for r in waiting if r[0] >= now]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        self.tracks.clear()
        if follower.open:
            self.tracks.put([(k["start"], k["last"], float(k["n"]), k["confidence"], *k["box"], *k["union"], k["zone"], k["text"], k["shown"]) for k in follower.open])
            self.handle.registerTimer(int(min(map(follower.due, follower.open)) * 1000) + 1)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass

    @staticmethod
    def _track(x) -> dict:
        return {"start": x[0], "last": x[1], "n": int(x[2]), "confidence": x[3], "box": tuple(x[4:8]), "union": tuple(x[8:12]), "zone": x[12], "text": x[13], "shown": x[14]}


class _Row:
    def __init__(self, values):
        for name, v in zip(READING.names, values, strict=True):
            setattr(self, name, v)


def text_track_stream(readings: DataFrame, every: float, late: str) -> DataFrame:
    """Tracks of a stream of readings (source, ts, confidence, x1, y1, x2, y2, zone, text), each told once, when its end is confirmed.

    Readings may be late by ``late``. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    ship(readings.sparkSession)
    schema = TRACK.format(readings.schema["source"].dataType.simpleString())
    rows = readings.withWatermark("ts", late).withColumn("t", F.unix_millis("ts") / 1000.0)
    return rows.groupBy("source").transformWithStateInPandas(_Tracks(every, [c.split()[0] for c in schema.split(", ")]), schema, "Append", "EventTime")
