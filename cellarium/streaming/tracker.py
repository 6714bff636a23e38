"""Object tracking over a stream of detections (T1-T8): state by scene and object, with event time, timers and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "scene long, frame long, object long, track long, event string"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Second of event time of frame 0: a watermark starts at 0, and what is not after it is late.
ORIGIN = 86_400


def step(scene: int, rows: pd.DataFrame, tracks: dict, following: int, stale_after: int, cap: int) -> tuple[list, dict, int]:
    """One batch of a scene's detections, frame by frame: stale tracks end, unknown objects get new ids up to the cap, the lowest scores of the excess are dropped and reported."""
    out = []
    for frame, now in rows.sort_values(["frame", "object"]).groupby("frame"):
        for o in [o for o, (_, seen) in tracks.items() if frame - seen > stale_after]:
            out.append((scene, frame, o, tracks.pop(o)[0], "stale"))
        new = now[~now["object"].isin(tracks)].sort_values(["score", "object"], ascending=[False, True])
        room = max(0, cap - len(tracks))
        for k, r in enumerate(new.itertuples()):
            if k < room:
                tracks[int(r.object)] = (following, int(frame))
                out.append((scene, frame, int(r.object), following, "promoted"))
                following += 1
            else:
                out.append((scene, frame, int(r.object), -1, "dropped"))
        for o in now["object"]:
            if int(o) in tracks:
                tracks[int(o)] = (tracks[int(o)][0], max(tracks[int(o)][1], int(frame)))
    return out, tracks, following


class Tracker(StatefulProcessor):
    """Tracks of a scene: a map of objects to their track and the last frame they were in, and the next track's number.

    A frame is a second of event time. A track that no later frame of its scene ends is ended by a timer, once the watermark
    shows that no detection within its time can come.
    """

    def __init__(self, stale_after: int, cap: int):
        self.stale_after, self.cap = stale_after, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "object long", "track long, seen long")
        self.following = handle.getValueState("following", "n long")

    def held(self) -> dict[int, tuple[int, int]]:
        return {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.tracks.iterator()}

    def keep(self, before: dict, after: dict) -> None:
        """Writes what has changed, and sets a timer for each track's end."""
        for o in before.keys() - after.keys():
            self.tracks.removeKey((o,))
        for o, (track, seen) in after.items():
            if before.get(o) != (track, seen):
                self.tracks.updateValue((o,), (track, seen))
                self.handle.registerTimer(1000 * (ORIGIN + seen + self.stale_after + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held()
        following = int(self.following.get()[0]) if self.following.exists() else 0
        out, after, following = step(int(key[0]), pd.concat(list(rows)), dict(before), following, self.stale_after, self.cap)
        self.keep(before, after)
        self.following.update((following,))
        yield pd.DataFrame(out, columns=["scene", "frame", "object", "track", "event"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Tracks whose time was over at the timer's own frame end at that frame."""
        frame, before = expiredTimerInfo.getExpiryTimeInMs() // 1000 - ORIGIN, self.held()
        gone = {o: v for o, v in before.items() if v[1] + self.stale_after < frame}
        self.keep(before, {o: v for o, v in before.items() if o not in gone})
        yield pd.DataFrame([(int(key[0]), frame, o, track, "stale") for o, (track, _) in sorted(gone.items())], columns=["scene", "frame", "object", "track", "event"])

    def close(self) -> None:
        pass


def track(detections: DataFrame, stale_after: int = 10, cap: int = 512, late: str = "5 seconds") -> DataFrame:
    """Track events of a stream (scene, frame, object, score); ids are never used again, also over restarts.

    Detections more than `late` frames behind the latest are dropped. State is in RocksDB, by object, so its size is that of
    the live tracks; the session's state store is set to that if it is another.
    """
    spark = detections.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    timed = detections.select(F.col("scene").cast("long"), F.col("frame").cast("long"), F.col("object").cast("long"), F.col("score").cast("double"), F.timestamp_seconds(F.col("frame") + ORIGIN).alias("at")).withWatermark("at", late)
    return timed.groupBy("scene").transformWithStateInPandas(Tracker(stale_after, cap), OUT, "append", "eventTime")


def reseed_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and type of a stream with column ts."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def upsert_frames(stream: DataFrame, path: str, checkpoint: str):
    """Writes frames (frame, segment, payload) so that a frame's latest segment wins, although it was written before."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("frame").agg(F.max_by(F.struct("segment", "payload"), "segment").alias("x")).select("frame", "x.segment", "x.payload")
        latest.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_frames(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("frame").agg(F.max_by(F.struct("segment", "payload"), F.struct("segment", "epoch")).alias("x")).select("frame", "x.segment", "x.payload")
