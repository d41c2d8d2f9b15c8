"""Collection: landing, silver, due lists, coverage, outages, frames, exports."""

import datetime as dt
from dataclasses import replace
import json
import os

import pytest
from pyspark.sql import functions as F

from ebbtide import PanelConfig
from ebbtide.functions import scalars as S
from ebbtide.operators import frame as FR
from ebbtide.operators import monitor as M
from ebbtide.operators import panel as P
from ebbtide.operators import silver
from ebbtide.operators import tables as TB
from ebbtide.sources import bronze, tables

CFG = PanelConfig()


def t(s):
    return dt.datetime.fromisoformat(s)


# ---------------------------------------------------------------- landing
REC = "post_id string, v long, _ingested_at string"


def test_merge_keeps_both_runs_and_the_later_value(spark):
    one = spark.createDataFrame([("a", 100, "15:05")], REC)
    two = spark.createDataFrame([("b", 200, "15:45"), ("a", 150, "15:45")], REC)
    m = bronze.merge_bronze(one, two, ("post_id",))
    for _ in range(3):
        m = bronze.merge_bronze(m, two, ("post_id",))
    assert sorted(map(tuple, m.collect())) == [("a", 150, "15:45"), ("b", 200, "15:45")]
    older = spark.createDataFrame([("a", 1, "15:00")], REC)
    assert bronze.merge_bronze(m, older, ("post_id",)).filter("post_id = 'a'").first().v == 150


def test_kinds_without_a_key_append(spark):
    one = spark.createDataFrame([("a", 1, "1")], REC)
    assert bronze.merge_bronze(one, one, None).count() == 2


def test_partition_merge_touches_only_its_partitions(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, "1", "x"), ("b", 1, "1", "y")], REC + ", dt string")
    for _ in range(2):
        bronze.merge_partitions(d, str(tmp_path / "t"), str(tmp_path / "s"), ("post_id",), ("dt",))
    before = {p: os.path.getmtime(tmp_path / "t" / p) for p in ("dt=x", "dt=y")}
    fresh = d.filter("dt = 'x'").withColumns({"v": F.lit(9).cast("long"), "_ingested_at": F.lit("2")})
    bronze.merge_partitions(fresh, str(tmp_path / "t"), str(tmp_path / "s"), ("post_id",), ("dt",))
    got = {r.post_id: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {"a": 9, "b": 1} and os.path.getmtime(tmp_path / "t" / "dt=y") == before["dt=y"]


def test_bronze_ids_stay_text_and_platforms_are_pruned(spark, tmp_path):
    for platform, pid in (("video", 17), ("photo", "18")):
        d = tmp_path / f"platform={platform}" / "dt=2026-09-01"
        d.mkdir(parents=True)
        (d / "posts-2026-09-01T15.jsonl").write_text(json.dumps({"post_id": pid, "published_at": "2026-09-01T00:00:00Z"}) + "\n")
        (d / "snapshots-2026-09-01T15.jsonl").write_text(json.dumps({"post_id": pid}) + "\n")
    r = bronze.read_bronze(spark, str(tmp_path), "posts", platform="video").collect()
    assert [(x.post_id, x.platform) for x in r] == [("17", "video")]


def test_broken_cycle_logs_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cycle_id": "c", "quota": {"units_spent": 65, "by_endpoint": {"x": 60, "y": 5}}}, indent=1))
    (tmp_path / "b.json").write_text("{ not json")
    logs = tables.read_cycle_logs(spark, str(tmp_path))
    assert logs.count() == 1
    assert {r.endpoint: r.units for r in M.spend_by_endpoint(logs).collect()} == {"x": 60, "y": 5}


# ---------------------------------------------------------------- scalars
def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("iso,sec", [("PT1H2M3S", 3723.0), ("PT45S", 45.0), ("PT0S", None), ("PT", None),
                                     ("P1DT2H", None), (None, None), ("PT1M30.5S", 90.5)])
def test_iso_duration(spark, iso, sec):
    assert one(spark, S.iso_duration_seconds("x"), x=iso) == sec


@pytest.mark.parametrize("age,mark", [(0.4, 1.0), (1.2, 1.0), (2.4, 3.0), (3.3, 3.0), (8.3, 6.0), (11.9, 12.0)])
def test_fade_mark(spark, age, mark):
    assert one(spark, S.fade_mark("x"), x=age) == mark


@pytest.mark.parametrize("x,y", [(99.5, 100), (0.4, 0), (-5.0, 0), (1234.0, 1200), (1250.0, 1200), (987654.0, 990000)])
def test_two_significant_figures(spark, x, y):
    assert one(spark, S.round_sig2("x"), x=x) == y


@pytest.mark.parametrize("link", ["https://www.youtube.com/watch?v=abcdefghij1&t=3", "youtu.be/abcdefghij1?si=2",
                                  "HTTPS://M.YOUTUBE.COM/shorts/abcdefghij1", "abcdefghij1", " https://youtube.com/live/abcdefghij1/ "])
def test_video_id(spark, link):
    assert one(spark, S.video_id("x"), x=link) == "abcdefghij1"


def test_long_links_are_read_too(spark):
    assert one(spark, S.video_id("x"), x="https://www.youtube.com/watch?list=" + "p" * 900 + "&v=abcdefghij1") == "abcdefghij1"


@pytest.mark.parametrize("link", ["https://example.com/watch?v=abcdefghij1", "https://youtube.com/watch?v=short", "", None,
                                  "https://youtube.com/channel/abcdefghij1"])
def test_not_a_video_id(spark, link):
    assert one(spark, S.video_id("x"), x=link) is None


def test_redaction(spark):
    text = "404 for https://api/x?part=a&key=SECRET1 and 'https://api/y?key=SECRET2'; token T0K"
    out = one(spark, S.redact("x", ["T0K"]), x=text)
    assert "SECRET" not in out and "T0K" not in out and out.count("REDACTED") == 3


def test_owner_fold_is_the_hash_modulo_five(spark):
    import hashlib
    ids = [f"UC{i}" for i in range(200)]
    d = spark.createDataFrame([(i,) for i in ids], "o string").select("o", S.owner_fold("o").alias("f"))
    assert all(r.f == int(hashlib.sha256(r.o.encode()).hexdigest(), 16) % 5 for r in d.collect())


def test_cohort_bounds_are_half_open(spark):
    bounds = (("A", "2026-09-16 00:00:00"), ("B", "2026-10-04 00:00:00"), ("C", "2026-10-15 00:00:00"))
    times = ["2026-09-15T23:59:59", "2026-09-16T00:00:00", "2026-10-03T23:59:59", "2026-10-04T00:00:00",
             "2026-10-14T23:59:59", "2026-10-15T00:00:00"]
    d = spark.createDataFrame([(t(x),) for x in times], "p timestamp")
    assert [r[0] for r in d.select(S.cohort_of("p", bounds)).collect()] == ["A", "B", "B", "C", "C", "later"]


# ---------------------------------------------------------------- silver
def test_grid_items(spark):
    node = lambda **k: {"node": {"shortcode": "s", "taken_at_timestamp": 1756710000, **k}}
    user = {"id": "9", "edge_followed_by": {"count": 5}, "edge_owner_to_timeline_media": {"edges": [
        node(shortcode="hid", like_and_view_counts_disabled=True, edge_liked_by={"count": 0}),
        node(shortcode="pre", edge_media_preview_like={"count": 7}, comments_disabled=True, edge_media_to_comment={"count": 3}),
        node(shortcode="cap", owner={"id": "8", "username": "u"}, is_video=True, video_view_count=11, pinned_for_users=[{"id": "1"}],
             edge_media_to_caption={"edges": [{"node": {"text": "#a #b @c"}}]}),
        node(shortcode="", edge_liked_by={"count": 1}), {"node": {"shortcode": "notime"}}]}}
    d = spark.createDataFrame([("q", json.dumps(user))], "queried_handle string, raw string")
    r = {x.post_id: x for x in silver.flatten_grid_payload(d).collect()}
    assert set(r) == {"ig_hid", "ig_pre", "ig_cap"}
    assert r["ig_hid"].likes is None and r["ig_hid"].counts_hidden and r["ig_hid"].owned_by_queried_account
    assert (r["ig_pre"].likes, r["ig_pre"].comments, r["ig_pre"].views) == (7, None, None)
    c = r["ig_cap"]
    assert (c.creator_id, c.owned_by_queried_account, c.hashtag_count, c.mention_count, c.is_pinned, c.views) == ("8", False, 2, 1, True, 11)


def test_daily_cap_keeps_the_earliest(spark):
    rows = [(f"e{i:03d}", "bulk", "video", t("2026-09-01T10:00:00") + dt.timedelta(seconds=i)) for i in range(100)]
    rows += [("n1", "bulk", "video", t("2026-09-02T00:00:00")), ("p1", "pics", "photo", t("2026-09-01T00:00:00"))]
    d = silver.owner_daily_cap(spark.createDataFrame(rows, "entity string, owner string, source string, published_at timestamp"), CFG.daily_cap)
    kept = sorted(r.entity for r in d.filter(~F.col("over_daily_cap")).collect())
    assert kept == ["e000", "e001", "e002", "e003", "e004", "n1", "p1"]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan                # the bulk day is cut before the shuffle


# ---------------------------------------------------------------- panel and monitoring
GRID = replace(CFG, schedule=(2.0, 5.0, 9.0), marks=(2.0, 5.0), tolerance=0.5, max_track=9.0)


def test_due_follows_marks_not_the_number_of_readings(spark):
    """One entity per set of reading ages; at each age since publication, who is owed a reading?"""
    ages = {"none": [], "early": [0.2, 0.9, 1.4], "opening": [1.5], "first": [2.0], "two": [1.9, 5.3], "stray": [0.1, 2.2, 2.4]}
    start = dt.datetime(2031, 3, 14, 22, 10)
    posts = spark.createDataFrame([(e, "o", "video", start) for e in ages], "entity string, owner string, source string, published_at timestamp")
    reads = spark.createDataFrame([(e, a, start + dt.timedelta(hours=a)) for e, xs in ages.items() for a in xs],
                                  "entity string, age_hours double, reading_ts timestamp")
    state = P.panel_state(posts, reads, GRID)
    scheduled = {r.entity: r.scheduled_count for r in state.collect()}
    assert scheduled == {"none": 0, "early": 0, "opening": 1, "first": 1, "two": 2, "stray": 2}
    for hours in (1.0, 2.0, 4.0, 5.0, 8.0):
        now = start + dt.timedelta(hours=hours)
        passed = sum(m <= hours for m in GRID.schedule)
        due = {r.entity for r in P.due_list(state, now.strftime("%Y-%m-%d %H:%M:%S"), GRID).collect()}
        assert due == {e for e, n in scheduled.items() if n < passed}, hours


@pytest.mark.parametrize("scope", [None, 5, 30])
def test_silence_is_measured_from_all_data_in_any_scope(spark, scope):
    """Three entities of different lengths; the last of them was read in the hour from 17:00."""
    last = {"a": dt.datetime(2031, 3, 10, 17, 40), "b": dt.datetime(2031, 3, 10, 11, 5), "c": dt.datetime(2031, 3, 8, 2, 0)}
    posts = spark.createDataFrame([(e, x - dt.timedelta(hours=20)) for e, x in last.items()], "entity string, published_at timestamp")
    reads = spark.createDataFrame([(e, 20.0 - k, x - dt.timedelta(hours=k)) for e, x in last.items() for k in range(0, 20, 2 + ord(e) % 3)],
                                  "entity string, age_hours double, reading_ts timestamp")
    for quiet in (0.75, 3.0, 3.25, 31.5, 400.0):
        now = (dt.datetime(2031, 3, 10, 17) + dt.timedelta(hours=quiet)).strftime("%Y-%m-%d %H:%M:%S")
        r = M.health(posts, reads, now, CFG, recent_hours=scope).first()
        assert r.hours_since_last_data == quiet == M.silence(reads, now).first().hours_since_last_data
        assert ("collection stopped" in r.problems) == (quiet > M.MAX_SILENT_HOURS)


def test_a_late_reading_is_not_a_reading_of_the_next_mark(spark):
    posts = spark.createDataFrame([("p", t("2026-09-01T00:00:00"))], "entity string, published_at timestamp")
    reads = lambda ages: spark.createDataFrame([("p", a) for a in ages], "entity string, age_hours double")
    get = lambda ages: {r.mark: (r.on_time, r.late) for r in M.mark_coverage(posts, reads(ages), "2026-09-01 07:00:00", CFG).collect()}
    assert get([3.0, 6.0]) == {1.0: (False, False), 3.0: (True, False), 6.0: (True, False)}
    assert get([2.0])[1.0] == (False, True)


def test_closed_outage(spark):
    hours = [0, 1, 2, 7, 8]
    d = spark.createDataFrame([(t("2026-09-01T00:30:00") + dt.timedelta(hours=h),) for h in hours], "reading_ts timestamp")
    r = M.outages(d).collect()
    assert [(x.start, x.hours_missing) for x in r] == [(t("2026-09-01T03:00:00"), 4)]


def test_empty_rounds_count_back_to_the_last_sign_of_life(spark):
    rows = [(1, False, 3, 5), (2, False, 3, 0), (3, True, 0, 0), (4, False, 3, 0)]
    d = spark.createDataFrame(rows, "started_at int, dry_run boolean, accounts_called int, posts_seen int")
    assert M.empty_rounds(d).first()[0] == 2
    assert M.empty_rounds(d.filter("started_at > 1")).first()[0] == 2
    assert M.empty_rounds(d.limit(0)).first()[0] == 0


def test_equivalence_check(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 3.0)], "k string, v double, w double")
    assert M.equivalence_check(a, a, ["k"]).first().agrees
    b = a.withColumn("v", F.col("v") + 1e-3)
    assert not M.equivalence_check(a, b, ["k"]).first().agrees
    assert M.equivalence_check(a, b, ["k"], atol=1e-2).first().agrees
    assert M.equivalence_check(a, a.limit(1), ["k"]).first().unmatched == 1


# ---------------------------------------------------------------- frame and exports
def test_pinned_items_do_not_slow_an_account(spark):
    base = t("2026-09-01T00:00:00")
    rows = [("fast", base + dt.timedelta(hours=i), False) for i in range(12)] + [("fast", base - dt.timedelta(days=8), True)]
    r = FR.screen_accounts(spark.createDataFrame(rows, "owner string, published_at timestamp, is_pinned boolean").withColumn(
        "counts_hidden", F.lit(False)), 3.0, 72.0).first()
    assert r.per_day > 20 and r.verdict == "REJECT"


@pytest.mark.parametrize("n,k", [(7, 3), (10, 4), (5, 9), (100, 7)])
def test_even_spread(spark, n, k):
    d = spark.range(n).select(F.lit("mid").alias("tier"), F.col("id").alias("size"))
    got = sorted(r["size"] for r in FR.even_spread(d, "tier", ["size"], k).collect())
    assert got == (list(range(n)) if n <= k else [int(i * n / k) for i in range(k)])


def test_busy_owners_are_marked_and_counted_in_full(spark):
    d = spark.range(250).select(F.lit("o").alias("owner"), F.lit("2026-09-10").cast("timestamp").alias("uploaded_at"))
    r = FR.upload_rates(d, "2026-09-01").first()
    assert r.saturated and r.uploads_seen == 250


def test_strict_json_at_any_depth(spark, tmp_path):
    d = spark.sql("SELECT double('NaN') AS a, array(struct(double('inf') AS b, 1.5D AS c)) AS d, map('k', double('-inf')) AS m")
    tables.export_strict_json(d, str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("part-*.json")).read_text()
    assert json.loads(text) == {"d": [{"c": 1.5}], "m": {"k": None}}


def test_identifiers_are_dropped_at_any_depth(spark):
    d = spark.sql("SELECT 1 AS post_id, struct('x' AS handle, array(struct('t' AS title, 2 AS n)) AS s) AS o, map('title', 'x', 'ok', 'y') AS m")
    assert json.loads(tables.strip_identifiers(d).toJSON().first()) == {"o": {"s": [{"n": 2}]}, "m": {"ok": "y"}}


def test_hand_off_order_and_written_predictions(spark, tmp_path):
    rows = [("b", 3.0, 3.1), ("a", 6.0, 6.2), ("a", 3.0, 3.4), ("a", 3.0, 2.9)]
    d = spark.createDataFrame(rows, "entity_key string, mark double, age_hours double")
    assert [tuple(r) for r in TB.hand_off_order(d).collect()] == sorted(rows)
    p = spark.createDataFrame([("e1", 5.0), ("e2", 7.0)], "entity string, predicted double")
    for _ in range(2):                                             # a second write replaces the first
        tables.write_predictions({"m1": p, "m2": p.limit(1)}, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted((r.model, r.entity, r.predicted) for r in back.collect()) == [("m1", "e1", 5.0), ("m1", "e2", 7.0), ("m2", "e1", 5.0)]
    assert back.filter("model = 'm2'").inputFiles() and back.columns[-1] == "model"


def test_decided_pairs_go_on_until_there_are_enough(spark):
    """Nearly all neighbours in the deal are too close; the few far pairs are found all the same."""
    from ebbtide.operators.pairs import decided_pairs
    d = spark.range(4000).select(F.concat(F.lit("e"), "id").alias("entity"), F.lit(True).alias("event_observed"),
                                 F.when(F.col("id") % 50 == 0, 500.0).otherwise(10.0).alias("t_death"),
                                 F.when(F.col("id") % 3 == 0, 1.0).otherwise(2.0).alias("m"))
    rows = decided_pairs(d, 25, 24.0, 3, picks={"model": "m"}).collect()
    assert len(rows) == 25 and len({x for r in rows for x in (r.a_entity, r.b_entity)}) == 50
    assert all(abs(r.a_t - r.b_t) >= 24 and r["first"] == ("a" if r.a_t < r.b_t else "b") and r.model_pick == ("a" if r.a_m < r.b_m else "b") for r in rows)
    every = decided_pairs(d, 5000, 24.0, 3).collect()              # not that many exist: all of the deal's pairs
    assert 60 < len(every) < 90


def test_percentiles_name_the_owners_behind_them(spark):
    ref = spark.createDataFrame([(m, float(i), 5.0, f"o{i % k}") for m, k in ((1.0, 6), (3.0, 9)) for i in range(40)],
                                "mark double, x double, log_subscribers double, owner string")
    ask = spark.createDataFrame([(1, 2.0, 1.0, 5.0), (2, 2.0, 2.0, None)], "id int, value double, age_hours double, log_subscribers double")
    assert {r.id: r.reference_owners for r in TB.midrank_percentile(ref, ask, "x", CFG).collect()} == {1: 6, 2: 9}


def test_column_medians_are_exact_by_either_plan(spark):
    from ebbtide.operators.skew import column_medians
    d = spark.range(301).selectExpr("id % 3 AS g", "double(id * 7919 % 83) AS a", "CASE WHEN id % 4 = 0 THEN double(id) END AS b", "cast(null as double) AS c")
    cols = {x: F.col(x) for x in "abc"}
    get = lambda **k: sorted((r.g, r.feature, r.median) for r in column_medians(d, cols, ["g"], **k).collect())
    pdf = d.toPandas()
    want = sorted((g, x, float(v[x].median())) for g, v in pdf.groupby("g") for x in "ab")
    assert get() == get(max_rows=5) == get(max_rows=1000) == want


def test_digest_ignores_order_and_sees_changes(spark):
    d = spark.range(50).select("id", (F.col("id") / 7).alias("x"))
    dig = lambda x: TB.table_digest(x).first().digest
    assert dig(d) == dig(d.repartition(7).orderBy(F.desc("id")))
    assert dig(d) != dig(d.withColumn("x", F.when(F.col("id") == 3, 0.0).otherwise(F.col("x"))))


def test_midrank_percentile(spark):
    ref = spark.createDataFrame([(1.0, float(i % 4), 5.0, f"o{i % 6}") for i in range(40)], "mark double, x double, log_subscribers double, owner string")
    ask = spark.createDataFrame([(1, 2.0, 1.0, 5.0), (2, -1.0, 1.0, None), (3, 1.5, 1.0, 5.0)], "id int, value double, age_hours double, log_subscribers double")
    for rows in (None, 3):
        got = {r.id: (r.percentile, r.reference_group) for r in TB.midrank_percentile(ref, ask, "x", CFG, rows).collect()}
        assert got == {1: (62.5, "all sizes"), 2: (0.0, "all sizes"), 3: (50.0, "all sizes")}


def test_percentiles_make_their_inputs_once(spark):
    sc = spark.sparkContext
    made = [sc.accumulator(0), sc.accumulator(0)]

    def counted(rows, schema, k):
        def one(row):
            made[k].add(1)
            return row
        return spark.createDataFrame(sc.parallelize(rows, 2).map(one), schema)
    ref = counted([(m, float(i % 4), 5.0, f"o{i % 6}") for m in (1.0, 3.0) for i in range(40 if m == 1 else 120)],
                  "mark double, x double, log_subscribers double, owner string", 0)
    ask = counted([(1, 2.0, 1.0, 5.0), (2, 2.0, 2.0, 5.0), (3, 1.5, 3.0, 5.0), (4, 0.0, 3.0, None), (None, 1.0, 1.0, 5.0), (6, None, 1.0, 5.0)],
                  "id int, value double, age_hours double, log_subscribers double", 1)
    got = {r.id: tuple(r)[1:5] for r in TB.midrank_percentile(ref, ask, "x", CFG).collect()}
    band = S.REFERENCE_BANDS[1][1]
    assert got == {1: (62.5, 40, 6, "all sizes"), 2: (62.5, 120, 6, "all sizes"), 3: (50.0, 120, 6, band), 4: (12.5, 120, 6, "all sizes")}
    assert [x.value for x in made] == [160, 6]
    twice = spark.createDataFrame([(1, 2.0, 1.0, 5.0), (1, 0.0, 3.0, 5.0)], "id int, value double, age_hours double, log_subscribers double")
    assert {tuple(r)[:5] for r in TB.midrank_percentile(ref, twice, "x", CFG).collect()} == {(1, 62.5, 120, 6, "all sizes")}


def test_schema_contract(spark):
    d = spark.range(1)
    assert tables.assert_schema(d, {"id": "bigint"}) is d
    with pytest.raises(ValueError):
        tables.assert_schema(d, {"id": "string"})
