"""The tracker as a stream: late frames, timers and restarts."""

from cellarium.streaming import tracker

SCHEMA = "scene long, frame long, object long, score double"


def test_stream(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = tracker.track(spark.readStream.schema(SCHEMA).parquet(source), stale_after=3, cap=2, late="2 seconds")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return {(r.scene, r.frame, r.object, r.track, r.event) for r in spark.read.parquet(out).collect()}

    provider = spark.conf.get(tracker.PROVIDER)
    try:
        first = {(1, 0, 7, 0, "promoted"), (1, 0, 8, 1, "promoted"), (1, 1, 9, -1, "dropped"), (2, 0, 5, 0, "promoted")}
        assert run([(1, 0, 7, 0.9), (1, 0, 8, 0.8), (1, 1, 9, 0.1), (1, 1, 7, 0.5), (2, 0, 5, 1.0)]) == first
        # a restart: 7 goes on under its track; 8 ends at a later frame of its scene, which makes room
        second = first | {(1, 4, 8, 1, "stale"), (1, 4, 9, 2, "promoted")}
        assert run([(1, 4, 9, 0.3), (1, 4, 7, 0.2)]) >= second
        # scene 2 has no later frame; the watermark of scene 1 sets off its timer, and a frame from before is too late
        run([(1, 20, 7, 0.9)])
        last = run([(2, 1, 6, 1.0), (1, 21, 7, 0.9)])
        assert (2, 4, 5, 0, "stale") in last and not any(o == 6 for _, _, o, _, _ in last)
        ids = [(s, t) for s, _, _, t, e in last if e == "promoted"]
        assert len(ids) == len(set(ids)) and (1, 20, 7, 3, "promoted") in last
    finally:
        spark.conf.set(tracker.PROVIDER, provider)
