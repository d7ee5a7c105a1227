import datetime as dt

import pytest

from msgspark.operators import filters, limits, lookups, normalize, reports
from msgspark.plans import ingest
from msgspark.schemas import LINK, RAW_MESSAGE, ROSTER
from msgspark.sources.messages import (
    history_scan,
    land_messages,
    read_messages,
    recent_scan,
    roster_scan,
)

RAW = [
    # channel, ts, user, text, bot_id, subtype, thread_ts
    ("C1", "1712345678.901200", "U1", " hello ", None, None, None),
    ("C1", "1712345679.000001", None, "no user", "", None, "1712345678.901200"),
    ("C1", "1712345680.000000", "U2", "\u3000\n", None, None, None),
    ("C1", "1712345681.000000", "U2", None, None, None, None),
    ("C1", "1712345682.000000", "U3", "from a bot", "B7", None, None),
    ("C2", "1712345683.000000", "U3", "also a bot", None, "bot_message", None),
    (None, "1712345684.000000", "U3", "no channel", None, None, None),
    ("C2", "", "U3", "no ts", None, None, None),
    ("D9", "1712345685.000000", "U4", "a question <@U12AB>", None, None, ""),
    ("D9", "1712345686.000000", "U4", "<@U12AB>", None, None, None),
]
CHANNELS = [
    ("C1", "general", True, 5, False),
    ("C2", "old", True, 3, True),
    ("C3", "quiet", None, None, None),
    ("C4", "new", True, 1, False),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, RAW_MESSAGE)


@pytest.fixture(scope="module")
def roster(spark):
    return spark.createDataFrame(CHANNELS, ROSTER)


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([("C1", "1712345678.901200", "https://x/1")], LINK)


def texts(df):
    return sorted(r.text or "" for r in df.collect())


def test_filters(raw):
    assert filters.drop_blank(raw).count() == 8
    assert filters.drop_bots(raw).count() == 8  # an empty bot_id keeps the row
    assert filters.drop_keyless(raw).count() == 8
    reasons = sorted(r.reason for r in filters.rejected(raw).collect())
    assert reasons == ["blank", "blank", "bot", "bot", "no key", "no key"]


def test_allow_list(spark, raw):
    assert filters.filter_allowed(raw, "").count() == len(RAW)
    assert filters.filter_allowed(raw, " C2 ,D9").count() == 4
    long = spark.createDataFrame([(" C2",), ("D9 ",)], "id string")
    assert filters.filter_allowed(raw, long).count() == 4
    assert filters.filter_allowed(raw, "general").count() == 0  # ids only, not names


def test_routes(raw):
    routes = {(r.channel, r.route) for r in filters.route_messages(raw, realtime=False).collect()}
    assert routes == {("C1", "skip"), ("C2", "skip"), (None, "skip"), ("D9", "question")}


def test_normalize(raw, roster, links):
    rows = {r.id: r for r in normalize.normalize_messages(raw, roster, links).collect()}
    assert len(rows) == 4
    first = rows["C1-1712345678.901200"]
    assert (first.text, first.channel_name, first.permalink) == ("hello", "general", "https://x/1")
    second = rows["C1-1712345679.000001"]
    assert (second.user, second.permalink, second.thread_ts) == ("unknown", "", "1712345678.901200")
    assert rows["D9-1712345685.000000"].channel_name == "D9"


def test_questions(raw):
    rows = {r.ts: r for r in normalize.clean_questions(raw.filter("channel = 'D9'")).collect()}
    asked, bare = rows["1712345685.000000"], rows["1712345686.000000"]
    assert (asked.question, asked.kind, asked.reply_to) == ("a question", "question", asked.ts)
    assert (bare.question, bare.kind) == ("", "empty")


def test_lookup_ignores_duplicate_dimension_rows(spark, raw, roster):
    twice = roster.unionByName(roster)
    named = lookups.with_channel_names(raw, twice)
    assert named.count() == len(RAW)


def test_resolve(spark, roster):
    asked = spark.createDataFrame([("#general",), ("##new",), ("nope",)], "request string")
    got = {r.request: (r.id, r.found) for r in lookups.resolve_channels(asked, roster).collect()}
    assert got == {"#general": ("C1", True), "##new": ("C4", True), "nope": (None, False)}


def test_roster_scan(roster):
    assert sorted(r.id for r in roster_scan(roster).collect()) == ["C1", "C3", "C4"]
    assert [r.num_members for r in roster_scan(roster).filter("id = 'C3'").collect()] == [0]
    assert sorted(r.id for r in roster_scan(roster, only_joined=True).collect()) == ["C1", "C4"]


def test_history_keeps_bots_and_caps_after_the_filter(raw, roster):
    rows = history_scan(raw.filter("channel = 'C1'"), roster, limit=2).collect()
    assert sorted(r.text for r in rows) == ["from a bot", "no user"]
    whole = history_scan(raw.filter("channel = 'C1'"), roster, limit=None)
    assert " hello " in texts(whole)  # a history keeps the text as written


def test_recent_caps_before_the_filter(raw):
    cutoff = dt.datetime(2024, 4, 5, 19, 34, 39)
    page = recent_scan(raw.filter("channel = 'C1'"), cutoff, limit=3)
    assert texts(page) == []  # the three newest rows are a bot and two blanks
    page = recent_scan(raw.filter("channel = 'C1'"), cutoff, limit=4)
    assert texts(page) == ["no user"]
    exact = dt.datetime(2024, 4, 5, 19, 34, 38, 901200)
    assert "hello" in texts(recent_scan(raw.filter("channel = 'C1'"), exact))


def test_recent_cutoff_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_type AS channel", "cast(event_id as string) AS ts", "cast(user_id as string) AS user",
        "props AS text", "cast(null as string) AS bot_id", "cast(null as string) AS subtype",
        "cast(null as string) AS thread_ts", "ts AS event_time",
    )
    plan = recent_scan(events, dt.datetime(2024, 1, 29), time_column="event_time")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-29" in text
    assert "value" not in text.split("ReadSchema")[1]
    assert "Window" not in text  # no cap unless asked for
    capped = recent_scan(events, dt.datetime(2024, 1, 29), limit=5, time_column="event_time")
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_recent_does_not_depend_on_the_session_zone(spark, raw, sf_dir, zone):
    import check_oracles

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        con = check_oracles.database(sf_dir)
        assert check_oracles.compare(spark, con, "recent_scan", sf_dir)[0] == "ok"
        exact = dt.datetime(2024, 4, 5, 19, 34, 38, 901200)
        page = recent_scan(raw.filter("channel = 'C1'"), exact)
        assert texts(page) == ["hello", "no user"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_name_lookup_broadcasts_a_small_roster(raw, roster):
    plan = lookups.with_channel_names(raw, roster)
    plan.collect()
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_top_n_with_a_hot_key(spark):
    df = spark.range(0, 20000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 97)) AS k", "cast(id as string) AS id", "id % 1000 AS v"
    )
    from pyspark.sql import functions as F

    order = [F.col("v").desc(), F.col("id").asc()]
    got = {(r.k, r.rank, r.id) for r in limits.top_n_per_key(df, ["k"], order, 7, "id").collect()}
    want = set()
    rows = df.collect()
    for k in {r.k for r in rows}:
        mine = sorted((-r.v, r.id) for r in rows if r.k == k)[:7]
        want |= {(k, n, i) for n, (_, i) in enumerate(mine, 1)}
    assert got == want


def test_catchup_and_backfill(raw, roster, links):
    cutoff = dt.datetime(2024, 1, 1)
    found = ingest.catchup_messages(raw, roster, cutoff)
    assert texts(found) == ["hello", "no user"]
    known = ingest.index_documents(found)
    assert ingest.backfill_messages(raw, roster, known, links).count() == 0
    fresh = ingest.backfill_messages(raw, roster, known.filter("false"), links)
    assert {r.permalink for r in fresh.collect()} == {"https://x/1", ""}


def test_reports(spark, raw, roster):
    said = normalize.normalize_messages(raw, roster)
    chunks = ingest.index_documents(said)
    failed = spark.createDataFrame([("C4",)], "channel string")
    outcome = {r.channel: r.outcome for r in reports.channel_outcomes(roster, said, chunks, failed).collect()}
    assert outcome == {"C1": "indexed", "C2": "no messages", "C3": "no messages", "C4": "failed"}
    total = [r for r in reports.ingest_summary(said, chunks, chunks.union(chunks)).collect() if r.channel is None]
    assert [(r.channels, r.messages, r.chunks) for r in total] == [(2, 4, 4)]
    lines = {r.id: r.line for r in reports.dry_run_listing(roster_scan(roster)).collect()}
    assert lines["C3"] == "#quiet (C3) - 0 members [not joined]"


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc", "csv"])
def test_sources_in_every_format(spark, raw, tmp_path, fmt):
    path = str(tmp_path / fmt)
    flat = raw.filter("text is not null and text not like '%\n%'")
    flat.write.format(fmt).save(path)
    assert read_messages(spark, path, fmt).count() == flat.count()


def test_recent_scan_reads_only_landed_days_since_the_cutoff(spark, tmp_path):
    path = str(tmp_path / "landed")
    day = 86400
    said = [("C1", f"{n * day + 3600}.5", "U1", f"day {n}", None, None, None) for n in range(10)]
    raw = spark.createDataFrame(said + [("C1", None, "U1", "no time", None, None, None)], RAW_MESSAGE)
    land_messages(raw, path)
    again = [("C1", f"{8 * day + 7200}.0", "U1", "day 8 anew", None, None, None)]
    land_messages(spark.createDataFrame(again, RAW_MESSAGE), path)  # replaces its day alone
    landed = spark.read.parquet(path)
    assert landed.count() == 11
    recent = recent_scan(landed, dt.datetime(1970, 1, 8, 0, 30))
    assert sorted(r.text for r in recent.collect()) == ["day 7", "day 8 anew", "day 9"]
    assert "landed_day" not in recent.columns
    scan = next(x for x in recent._jdf.queryExecution().executedPlan().toString().split("\n") if "Scan parquet" in x)
    assert "1970-01-08" in scan.split("PartitionFilters")[1].split("]")[0]
