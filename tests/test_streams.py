"""Streams over several files give the batch answer."""

import datetime as dt

from pyspark.sql import functions as F

from ebbtide import PanelConfig
from ebbtide.operators.labels import decay_label
from ebbtide.streaming import streams as T

CFG = PanelConfig(frac=0.3)


def readings(spark):
    base = F.lit("2024-01-01").cast("timestamp")
    pub = F.timestamp_add("HOUR", (F.col("id") % 5 * 30).cast("int"), base)
    age = (F.col("id") * 37 % 211).cast("double")
    return spark.range(400).select(
        F.concat(F.lit("e"), F.col("id") % 5).alias("entity"), F.concat(F.lit("o"), F.col("id") % 2).alias("owner"),
        F.lit("video").alias("source"), F.col("id").alias("seq"), pub.alias("published_at"), age.alias("age_hours"),
        F.timestamp_add("HOUR", age.cast("int"), pub).alias("reading_ts"),
        (F.sqrt(age + 1) * 100 + F.col("id") % 13).alias("value"))


def files(spark, df, path, n=4):
    """n files that arrive in id order, so ages arrive out of order."""
    for i in range(n):
        df.filter(F.col("seq") % n == i).coalesce(1).write.mode("append").parquet(path)
    return T.stream_table(spark, path, files_per_trigger=1)


def test_labels_equal_the_batch(spark, tmp_path):
    df = readings(spark)
    s = files(spark, df, str(tmp_path / "in"))
    got = T.stream_decay_label(s, str(tmp_path / "run"), CFG, "seq").drop("final").collect()
    want = decay_label(df, CFG, "seq").collect()
    key = lambda rows: sorted(tuple(r.asDict().items()) for r in rows)
    assert key(got) == key(want)


def test_a_repeated_run_adds_nothing(spark, tmp_path):
    s = files(spark, readings(spark), str(tmp_path / "in"), 2)
    a = T.available_now(s, str(tmp_path / "run")).count()
    assert T.available_now(s, str(tmp_path / "run")).count() == a == 400


def test_cap_holds_across_batches(spark, tmp_path):
    rows = [(f"e{i:02d}", "o", dt.datetime(2024, 1, 1, i % 24), i) for i in range(40)]
    d = spark.createDataFrame(rows, "entity string, owner string, published_at timestamp, seq int")
    s = files(spark, d, str(tmp_path / "in"), 3).drop("seq")
    assert T.stream_owner_cap(s, str(tmp_path / "run"), 5).count() == 5


def test_panel_state_equals_the_batch(spark, tmp_path):
    df = readings(spark)
    out = T.available_now(T.stream_panel_state(files(spark, df, str(tmp_path / "in")), CFG), str(tmp_path / "run"), "update")
    got = {r.entity: (r.reading_count, r.scheduled_count, r.last_reading_at) for r in T.latest(out, ["entity"]).collect()}
    want = {r.entity: (r.n, r.s, r.m) for r in df.groupBy("entity").agg(
        F.count("*").alias("n"), F.count_if(F.col("age_hours") >= CFG.first_mark_opens).alias("s"),
        F.max("reading_ts").alias("m")).collect()}
    assert got == want


def test_breaker_run_spans_batches(spark, tmp_path):
    rows = [(i, "s", False, 3, 5 if i == 1 else 0) for i in range(6)]
    d = spark.createDataFrame(rows, "at int, source string, dry_run boolean, accounts_called int, posts_seen int")
    for lo, hi in ((0, 3), (3, 6)):
        d.filter((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        r = T.breaker(T.stream_table(spark, str(tmp_path / "in")), str(tmp_path / "run"), trip_at=4).first()
    assert (r.attempts, r.empty_rounds, r.tripped) == (6, 4, True)


def test_dedupe_keeps_one_copy_and_merge_the_freshest(spark, tmp_path):
    df = readings(spark).withColumns({"_ingested_at": F.lit("1"), "dt": F.to_date("reading_ts")})
    again = df.withColumns({"_ingested_at": F.lit("2"), "value": F.lit(7.0)})
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = T.stream_table(spark, str(tmp_path / "in"), 1)
    assert T.available_now(T.stream_dedupe(s, ["entity", "reading_ts", "seq"], delay="90 days"), str(tmp_path / "d")).count() == 400
    out = T.stream_merge(s, str(tmp_path / "t"), str(tmp_path / "m"), ("entity", "seq"), ("dt",))
    assert out.count() == 400 and out.filter("value <> 7.0").count() == 0


def test_lateness_and_late_rows(spark):
    d = spark.createDataFrame([(1.2, dt.datetime(2024, 1, 1)), (2.5, dt.datetime(2024, 1, 5)), (0.1, dt.datetime(2024, 1, 5))],
                              "age_hours double, reading_ts timestamp")
    r = T.with_lateness(d, PanelConfig()).collect()
    assert [(x.mark, x.late) for x in r] == [(1.0, False), (3.0, False), (None, None)]
    ok, late = T.split_late(d, "2024-01-05 00:00:00", 48.0)
    assert (ok.count(), late.count()) == (2, 1)


def stream_of(spark, path, *batches):
    """One file per batch, in order of arrival."""
    import time
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return T.stream_table(spark, path, files_per_trigger=1)


def test_cap_gives_no_place_to_those_already_admitted(spark, tmp_path):
    make = lambda names: spark.createDataFrame([(n, "o", dt.datetime(2024, 5, 2, i)) for i, n in enumerate(names)],
                                               "entity string, owner string, published_at timestamp")
    s = stream_of(spark, str(tmp_path / "in"), make("uvw"), make("uvwxyz"), make("vz"))
    got = [r.entity for r in T.stream_owner_cap(s, str(tmp_path / "run"), 5).collect()]
    assert sorted(got) == list("uvwxy")


def test_heartbeat_judges_silent_sources_and_never_goes_back(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame([(s, dt.datetime(2024, 5, d, h)) for s, d, h in rows], "source string, reading_ts timestamp")
    s = stream_of(spark, str(tmp_path / "in"), make(("p", 2, 9), ("q", 2, 8)), make(("q", 3, 11)), make(("q", 3, 4)))
    got = {r.source: r for r in T.heartbeat(s, str(tmp_path / "run"), lambda: "2024-05-03 12:00:00").collect()}
    assert got["q"].last_data_at == dt.datetime(2024, 5, 3, 11) and not got["q"].stopped
    assert got["p"].stopped and got["p"].hours_silent == 27


def test_a_stream_reads_its_own_path_only(spark, tmp_path):
    d = spark.range(5).coalesce(1)
    d.write.parquet(str(tmp_path / "cap"))
    d.write.parquet(str(tmp_path / "caprun"))
    assert T.available_now(T.stream_table(spark, str(tmp_path / "cap")), str(tmp_path / "r1")).count() == 5
    part = next((tmp_path / "cap").glob("part-*.parquet"))
    part.with_name("one.parquet").write_bytes(part.read_bytes())
    part.with_name("one.parquet_old").write_bytes(part.read_bytes())
    assert T.available_now(T.stream_table(spark, str(tmp_path / "cap" / "one.parquet")), str(tmp_path / "r2")).count() == 5


def test_readings_land_and_are_read_back(spark, tmp_path):
    from ebbtide.sources import bronze
    rows = [("e%d" % i, "2024-05-02T0%d:00:00Z" % i, "video", dt.date(2024, 5, 2), i, "2024-05-02T10:00:00Z") for i in range(6)]
    d = spark.createDataFrame(rows, "post_id string, snapshot_ts string, platform string, dt date, views long, _ingested_at string")
    root = str(tmp_path / "land")
    bronze.write_bronze(d, root, "snapshots", str(tmp_path / "stage"))
    bronze.write_bronze(d.limit(3), root, "snapshots", str(tmp_path / "stage"))
    assert bronze.read_bronze(spark, root, "snapshots", "video").agg({"views": "sum"}).first()[0] == 15
    assert bronze.read_bronze(spark, root, "snapshots", "photo").count() == 0
    assert T.available_now(T.stream_readings(spark, root), str(tmp_path / "run")).count() == 6


def label_rows(spark, *rows):
    """(entity, published day, age in hours, value) as readings."""
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(e, t0 + dt.timedelta(days=d), t0 + dt.timedelta(days=d, hours=a), float(a), float(v), i) for i, (e, d, a, v) in enumerate(rows)],
                                 "entity string, published_at timestamp, reading_ts timestamp, age_hours double, value double, seq int")


def test_a_label_becomes_final_when_others_move_time_on(spark, tmp_path):
    cfg = PanelConfig(min_intervals=2, sustain=1)
    old = [("x", 0, a, v) for a, v in ((1, 10), (3, 40), (6, 41), (12, 41))]
    s = stream_of(spark, str(tmp_path / "in"), label_rows(spark, *old[2:]), label_rows(spark, *old[:2]), label_rows(spark, *old),      # out of order, a replay
                  label_rows(spark, ("y", 60, 1, 5), ("y", 60, 3, 9)))
    got = {r.entity: r for r in T.stream_decay_label(s, str(tmp_path / "run"), cfg, "seq").collect()}
    assert got["x"].final and not got["y"].final
    want = decay_label(label_rows(spark, *old), cfg, "seq").first()
    assert [got["x"][c] for c in want.asDict()] == list(want)


def test_no_batch_reads_earlier_output(spark, tmp_path):
    """The label, the cap and the breaker go on from their state alone: what earlier runs stored is gone."""
    def two_runs(name, first, second, run):
        path, folder = str(tmp_path / name), tmp_path / f"{name}-run"
        first.coalesce(1).write.parquet(path)
        run(T.stream_table(spark, path), str(folder)).count()
        for d in (folder / "out").glob("batch=*"):
            d.rename(tmp_path / f"{name}-gone-{d.name}")
        second.coalesce(1).write.mode("append").parquet(path)
        return run(T.stream_table(spark, path), str(folder)).collect()

    x = [("x", 0, a, v) for a, v in ((1, 10), (3, 40), (6, 41), (12, 41), (24, 60))]
    cfg = PanelConfig(min_intervals=2)
    got = two_runs("l", label_rows(spark, *x[:3]), label_rows(spark, *x[3:]), lambda s, f: T.stream_decay_label(s, f, cfg, "seq"))
    want = decay_label(label_rows(spark, *x), cfg, "seq").first()
    assert [got[0][c] for c in want.asDict()] == list(want)
    names = lambda n: spark.createDataFrame([(c, "o", dt.datetime(2024, 5, 2, i)) for i, c in enumerate(n)], "entity string, owner string, published_at timestamp")
    assert [r.entity for r in two_runs("c", names("abc"), names("xcyz"), lambda s, f: T.stream_owner_cap(s, f, 5))] == ["x", "y"]
    log = lambda *seen: spark.createDataFrame([(a, "s", False, 1, p) for a, p in seen], "at int, source string, dry_run boolean, accounts_called int, posts_seen int")
    r = two_runs("b", log((1, 4), (2, 0), (3, 0)), log((3, 0), (4, 0)), lambda s, f: T.breaker(s, f, 3))[0]       # attempt 3 comes twice
    assert (r.attempts, r.empty_rounds, r.tripped) == (4, 3, True)


def test_a_closed_day_admits_nobody(spark, tmp_path):
    day = lambda d, *names: spark.createDataFrame([(n, "o", dt.datetime(2024, 5, d, i)) for i, n in enumerate(names)], "entity string, owner string, published_at timestamp")
    s = stream_of(spark, str(tmp_path / "in"), day(2, "a", "b"), day(20, "c"), day(2, "d"), day(20, "e"))
    out = T.stream_owner_cap(s, str(tmp_path / "run"), 3, delay_hours=24.0)
    assert sorted(r.entity for r in out.collect()) == ["a", "b", "c", "e"]


def test_sessions_close_by_readings_and_by_time(spark, tmp_path):
    at = lambda *hm: spark.createDataFrame([(s, dt.datetime(2024, 5, 1) + dt.timedelta(hours=h)) for s, h in hm], "source string, reading_ts timestamp")
    # p: 0-1, 9-10, 18; the reading at 9 comes after that at 18. q falls silent after 2, r is the clock.
    s = stream_of(spark, str(tmp_path / "in"), at(("p", 0), ("p", 1), ("q", 2), ("r", 2)), at(("p", 18), ("p", 10), ("r", 18)), at(("p", 9), ("p", 9)),
                  at(("p", 0)), at(("r", 200)))
    sessions = T.stream_sessions(s, str(tmp_path / "run"), gap_hours=3.0, delay_hours=24.0)
    hour = lambda t: (t - dt.datetime(2024, 5, 1)).total_seconds() / 3600
    got = sorted((r.source, hour(r.start), hour(r["last"]), r.minutes, r.closed) for r in sessions.collect())
    assert got == [("p", 0, 1, 2, True), ("p", 9, 10, 2, True), ("p", 18, 18, 1, True), ("q", 2, 2, 1, True),
                   ("r", 2, 2, 1, True), ("r", 18, 18, 1, True), ("r", 200, 200, 1, False)]
    gaps = sorted((r.source, hour(r.last_data_at), hour(r.resumed_at), r.hours_quiet) for r in T.outages_between(sessions).collect())
    assert gaps == [("p", 1, 9, 8), ("p", 10, 18, 8), ("r", 2, 18, 16), ("r", 18, 200, 182)]


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    make = lambda *days: spark.createDataFrame([(f"e{d}", dt.datetime(2024, 5, d)) for d in days], "entity string, reading_ts timestamp")
    s = stream_of(spark, str(tmp_path / "in"), make(1, 2), make(9, 3), make(8, 2, 7), make(1, 9))
    for _ in range(2):                                               # a second run finds nothing new
        ok, late = T.stream_split_late(s, str(tmp_path / "run"), 48.0)
        assert sorted(r.entity for r in ok.collect()) == ["e1", "e2", "e3", "e8", "e9", "e9"]
        assert sorted(r.entity for r in late.collect()) == ["e1", "e2", "e7"]


def test_a_repeated_split_step_overwrites_its_own_rows(spark, tmp_path):
    """A crash after the sinks but before the commit: the batch is run again and splits the same way."""
    make = lambda *days: spark.createDataFrame([(d, dt.datetime(2024, 5, d)) for d in days], "k int, reading_ts timestamp")
    path, folder = str(tmp_path / "in"), tmp_path / "run"
    s = stream_of(spark, path, make(1, 9), make(2, 10))
    T.stream_split_late(s, str(folder), 48.0)
    (folder / "checkpoint" / "commits" / "1").rename(tmp_path / "lost")
    (folder / "checkpoint" / "commits" / ".1.crc").rename(tmp_path / "lost.crc")
    ok, late = T.stream_split_late(T.stream_table(spark, path, 1), str(folder), 48.0)
    assert sorted(r.k for r in ok.collect()) == [1, 9, 10] and [r.k for r in late.collect()] == [2]


def test_panel_state_is_forgotten_after_the_window(spark, tmp_path):
    cfg = PanelConfig()
    s = stream_of(spark, str(tmp_path / "in"), label_rows(spark, ("x", 0, 1, 1), ("x", 0, 3, 2)), label_rows(spark, ("y", 60, 1, 1)), label_rows(spark, ("y", 60, 3, 1)))
    out = T.available_now(T.stream_panel_state(s, cfg), str(tmp_path / "run"), "update")
    assert {r.entity: (r.reading_count, r.scheduled_count) for r in T.latest(out, ["entity"]).collect()} == {"x": (2, 2), "y": (2, 2)}
    kept = spark.read.format("statestore").load(str(tmp_path / "run" / "checkpoint"))
    assert [r.key[0] for r in kept.select("key").collect()] == ["y"]


def test_entities_and_sources_share_buckets(spark, tmp_path, monkeypatch):
    """Handlers are called per bucket, not per entity; a name may be null; each entity keeps its own answer."""
    from ebbtide.streaming import state
    monkeypatch.setattr(state, "BUCKETS", 3)
    df = readings(spark).withColumn("entity", F.when(F.col("seq") % 40 > 0, F.concat(F.lit("e"), F.col("seq") % 40)))
    df = df.withColumn("reading_ts", F.timestamp_add("HOUR", F.col("age_hours").cast("int"), F.col("published_at")))
    key = lambda rows: sorted(str(sorted(r.asDict().items())) for r in rows)
    s = files(spark, df, str(tmp_path / "in"))
    got = T.stream_decay_label(s, str(tmp_path / "run"), CFG, "seq").drop("final").collect()
    assert key(got) == key(decay_label(df, CFG, "seq").collect()) and len(got) == 40
    assert spark.read.format("statestore").load(str(tmp_path / "run" / "checkpoint")).count() <= 3
    sessions = T.stream_sessions(files(spark, df.filter("entity IS NOT NULL").withColumn("source", F.col("entity")), str(tmp_path / "in2")), str(tmp_path / "run2"), 6, delay_hours=400.0)
    minutes = df.filter("entity IS NOT NULL").select("entity", "reading_ts").distinct().groupBy("entity").count().collect()
    assert {r.source: r["sum(minutes)"] for r in sessions.groupBy("source").sum("minutes").collect()} == {r.entity: r["count"] for r in minutes}
    assert spark.read.format("statestore").load(str(tmp_path / "run2" / "checkpoint")).count() <= 3


def test_a_delivery_of_many_rows_is_several_files_of_one_batch(spark, monkeypatch):
    from checks import streams
    rows = readings(spark).select("seq", "reading_ts").filter("seq < 300 OR seq = 399")
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    seen, asked, plain = [], [], T.stream_table
    monkeypatch.setattr(streams.T, "stream_table", lambda s, path, files_per_trigger: asked.append((len(s.read.parquet(path).inputFiles()), files_per_trigger)) or plain(s, path, files_per_trigger))
    q = (streams.deliver(spark, "many-files", rows, shuffled=True).writeStream.trigger(availableNow=True)
         .foreachBatch(lambda b, i: seen.append(sorted(r.seq for r in b.select("seq").collect()))).start())
    q.awaitTermination()
    assert asked == [(48, 8)] and len(seen) == 6 and seen[-1] == seen[1]
    assert sorted(x for b in seen[:-1] for x in b) == sorted(r.seq for r in rows.collect())


def test_panel_state_is_kept_per_bucket(spark, tmp_path, monkeypatch):
    """Entities share a state row and a handler call; each keeps its own numbers, and is forgotten by itself."""
    from ebbtide.streaming import state
    monkeypatch.setattr(state, "PANEL_BUCKETS", 1, raising=False)
    df = readings(spark).withColumn("entity", F.when(F.col("seq") % 40 > 0, F.concat(F.when(F.col("seq") % 2 == 0, "e").otherwise("f"), F.col("seq") % 40)))
    out = T.available_now(T.stream_panel_state(files(spark, df, str(tmp_path / "in")), CFG), str(tmp_path / "run"), "update")
    got = {r.entity: (r.reading_count, r.scheduled_count, r.last_reading_at) for r in T.latest(out, ["entity"]).collect()}
    want = {r.entity: (r.n, r.s, r.m) for r in df.groupBy("entity").agg(
        F.count("*").alias("n"), F.count_if(F.col("age_hours") >= CFG.first_mark_opens).alias("s"), F.max("reading_ts").alias("m")).collect()}
    assert got == want and len(got) == 40
    assert spark.read.format("statestore").load(str(tmp_path / "run" / "checkpoint")).count() <= 3      # names with e, with f, null
    s = stream_of(spark, str(tmp_path / "in2"), label_rows(spark, ("x1", 0, 1, 1), ("x2", 50, 1, 1)), label_rows(spark, ("x3", 60, 1, 1)), label_rows(spark, ("x2", 50, 300, 2)))
    out = T.available_now(T.stream_panel_state(s, PanelConfig()), str(tmp_path / "run2"), "update")
    assert {r.entity: (r.reading_count, r.scheduled_count) for r in T.latest(out, ["entity"]).collect()} == {"x1": (1, 1), "x2": (2, 2), "x3": (1, 1)}
    kept = spark.read.format("statestore").load(str(tmp_path / "run2" / "checkpoint")).collect()
    assert [sorted(r.value.asDict(True)["groupState"]["names"]) for r in kept] == [["x2", "x3"]]
