import datetime as dt
import os
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from msgspark.operators import index, normalize
from msgspark.plans import ingest
from msgspark.plans.bindings import BOT_USER, conversation_messages, membership_events
from msgspark.schemas import CHUNK, MEMBERSHIP_EVENT, RAW_MESSAGE
from msgspark.sources import commits
from msgspark.sources.messages import stream_messages
from msgspark.sources.storage import fresh_path, shared_folder, stored
from msgspark.streaming import jobs


def chunk(id, text="t", url="", n=0):
    return (id, text, "c", "c", "u", "1", url, n)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_last_write_wins_and_replay_is_a_no_op(spark):
    path = fresh_path(spark, "log")
    first = spark.createDataFrame([chunk("a-chunk-0", "one"), chunk("a-chunk-1", "two")], CHUNK)
    second = spark.createDataFrame([chunk("a-chunk-0", "new")], CHUNK)
    index.append(first, path, 1)
    index.append(second, path, 2)
    once = rows(index.latest(index.read_log(spark, path)))
    assert [r[1] for r in once] == ["new", "two"]  # a stale chunk stays
    index.append(second, path, 2)
    index.append(first, path, 1)
    assert rows(index.current(spark, path)) == once
    assert index.read_log(spark, path).count() == 3  # a replayed batch replaces itself
    data = [r[:8] for r in once]
    assert rows(index.upsert(first, second)) == data
    assert rows(index.upsert(first, second.unionByName(second))) == data
    whole = index.upsert(first, second, replace_document=True)
    assert [r[1] for r in rows(whole)] == ["new"]
    index.compact(spark, path)
    assert rows(index.current(spark, path)) == once and index.read_log(spark, path).count() == 2
    index.append(spark.createDataFrame([chunk("a-chunk-1", "late")], CHUNK), path, 3)
    assert [r[1] for r in rows(index.current(spark, path))] == ["new", "late"]
    index.vacuum(spark, path)
    assert [r[1] for r in rows(index.current(spark, path))] == ["new", "late"]


def test_newest_version_wins_over_later_jobs(spark):
    path = fresh_path(spark, "log")
    version = lambda text, v: spark.createDataFrame([chunk("a", text)], CHUNK).withColumn("version", F.lit(v))
    index.append(version("edited", "9.5"), path, 1, writer="live")
    index.append(version("history", "1.0"), path, 7)
    assert [r.text for r in index.current(spark, path).collect()] == ["edited"]
    index.append(version("same time", "9.5"), path, 7, writer="other")
    assert [r.text for r in index.current(spark, path).collect()] == ["same time"]


def base_rows(spark, n=300):
    return spark.range(n).selectExpr(
        "concat('c-', id, '-chunk-0') AS id", "repeat('text ', 50) AS text", "'c' AS channel", "'c' AS channel_name",
        "'u' AS user", "'1' AS ts", "'' AS permalink", "0 AS chunk_index",
    )


def moved(df):
    """Columns of every shuffle of the plan that is run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange":
            found.append(node.output().mkString(" "))
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_reads_move_no_texts_and_a_compacted_index_is_only_scanned(spark):
    path = fresh_path(spark, "log")
    base = base_rows(spark)
    index.append(base, path, 1)
    index.append(base.limit(5).withColumn("text", F.lit("new")), path, 2)
    made = index.current(spark, path)
    assert made.filter("text = 'new'").count() == 5 and made.count() == 300
    assert moved(made) and not [x for x in moved(made) if "text#" in x or "weights" in x]
    assert index.compact(spark, path)
    there = sorted(os.listdir(shared_folder(spark)))
    made = index.current(spark, path)
    assert moved(made) == [] and made.count() == 300
    index.append(base.limit(2).withColumn("text", F.lit("newer")), path, 3)
    made = index.current(spark, path)
    assert not [x for x in moved(made) if "text#" in x] and made.filter("text = 'newer'").count() == 2
    assert sorted(os.listdir(shared_folder(spark))) == there  # nothing is written to read


def test_a_write_moves_no_texts_unless_ids_repeat(spark):
    path = fresh_path(spark, "log")
    assert moved(index.as_log(base_rows(spark))) == []
    twice = spark.createDataFrame([chunk("a", "two"), chunk("a", "one"), chunk("b")], CHUNK)
    assert index.append(twice, path, 1) == {"messages": 3, "chunks": 2, "embedded": 3}
    assert [r[1] for r in rows(index.current(spark, path))] == ["one", "t"]


def test_readers_see_no_unfinished_work(spark):
    path = fresh_path(spark, "log")
    index.append(base_rows(spark), path, 1)
    before = rows(index.current(spark, path))
    half = base_rows(spark, 50).withColumn("text", F.lit("half")).withColumn("version", F.lit("9"))
    for folder in ("base=dead/_temporary/0", "base=dead/bucket=3", "batch=dead"):  # jobs that died or still run
        index.as_log(half).write.parquet(f"{path}/data/{folder}")
    (tmp, system) = commits._hadoop(spark, f"{path}/_commits/.half")
    system.create(tmp, True).close()
    assert rows(index.current(spark, path)) == before
    assert index.compact(spark, path) and rows(index.current(spark, path)) == before
    index.vacuum(spark, path)
    assert rows(index.current(spark, path)) == before


def test_a_write_during_a_compaction_survives(spark, monkeypatch):
    path = fresh_path(spark, "log")
    index.append(base_rows(spark), path, 1)
    index.append(base_rows(spark, 10).withColumn("text", F.lit("late")), path, 2)
    ready, go = threading.Event(), threading.Event()
    put = commits.commit

    def slow(*args):
        if threading.current_thread() is not threading.main_thread():
            ready.set()
            assert go.wait(60)
        return put(*args)

    monkeypatch.setattr(commits, "commit", slow)
    done = []
    other = threading.Thread(target=lambda: done.append(index.compact(spark, path)))
    other.start()
    assert ready.wait(60)  # its files are written, its commit waits
    opened = index.current(spark, path)
    index.append(base_rows(spark, 3).withColumn("text", F.lit("meanwhile")), path, 3)
    index.append(base_rows(spark, 5).withColumn("text", F.lit("replayed")), path, 2)
    go.set()
    other.join()
    assert done == [True]
    texts = [r.text for r in index.current(spark, path).orderBy("id").collect()]
    assert texts.count("meanwhile") == 3 and texts.count("replayed") == 2 and texts.count("late") == 5
    assert opened.filter("text = 'late'").count() == 10  # an open reader keeps its state
    kept = rows(index.current(spark, path))
    assert index.compact(spark, path) and rows(index.current(spark, path)) == kept


def test_writers_that_commit_at_once_all_succeed(spark):
    path = fresh_path(spark, "log")
    index.append(spark.createDataFrame([chunk("z")], CHUNK), path, 0)
    write = lambda k: index.append(spark.createDataFrame([chunk(f"m{k}")], CHUNK), path, 1, writer=f"w{k}")
    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in rows(index.current(spark, path))] == ["m0", "m1", "m2", "m3", "z"]
    assert len({b.commit for b in index.batches(spark, path).collect()}) == 5


def test_a_compaction_that_comes_second_changes_nothing(spark, monkeypatch):
    path = fresh_path(spark, "log")
    index.append(base_rows(spark), path, 1)
    put, raced = commits.commit, []

    def race(*args):
        if not raced:
            raced.append(True)
            assert index.compact(spark, path)
        return put(*args)

    monkeypatch.setattr(commits, "commit", race)
    assert index.compact(spark, path) is False
    assert index.current(spark, path).count() == 300


def test_a_compaction_rewrites_the_touched_buckets_only(spark):
    path = fresh_path(spark, "log")
    index.append(base_rows(spark), path, 1)
    index.compact(spark, path)
    before = index.state(spark, path)["base"]
    index.append(spark.createDataFrame([chunk("c-7-chunk-0", "new"), chunk("c-7-chunk-1", "more")], CHUNK), path, 2)
    (touched,) = index.state(spark, path)["late"][0]["touched"]
    index.compact(spark, path)
    after = index.state(spark, path)["base"]
    assert {k for k in after if after[k] != before[k]} == {str(touched)}
    assert index.current(spark, path).count() == index.count(spark, path) == 301
    index.append(spark.createDataFrame([chunk("c-7-chunk-0", "newer"), chunk("d", "d")], CHUNK), path, 3)
    assert index.count(spark, path) == 302 == index.current(spark, path).count()
    one = index.current(spark, path, buckets=[touched])
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in one.inputFiles() if "/base=" in f}
    assert read == {f"bucket={touched}"}
    assert {r.id for r in one.collect()} >= {"c-7-chunk-0", "c-7-chunk-1"}
    index.append(spark.createDataFrame([chunk("c-7-chunk-0", "gone")], CHUNK), path, 2)  # merged: left out
    assert [r.text for r in index.current(spark, path).filter("id = 'c-7-chunk-0'").collect()] == ["newer"]


def by_bucket(spark, path):
    """Every message of the index is found by its bucket alone; the texts by id."""
    count = index.state(spark, path)["buckets"]
    whole = {r.id: r.text for r in index.current(spark, path).collect()}
    placed = index.current(spark, path).select("id", index.bucket_of(count).alias("b")).collect()
    for b in sorted({r.b for r in placed})[:3]:
        found = {r.id for r in index.current(spark, path, buckets=[b], count=count).collect()}
        assert found == {r.id for r in placed if r.b == b}
    assert index.count(spark, path) == len(whole)
    return whole


def test_an_index_that_grows_gets_more_buckets(spark, monkeypatch):
    path = fresh_path(spark, "log")
    monkeypatch.setattr(index, "BUCKET_ROWS", 2)
    index.append(base_rows(spark, 100), path, 1)
    assert index.compact(spark, path) and index.state(spark, path)["buckets"] == 64
    index.append(base_rows(spark), path, 2)
    assert index.compact(spark, path) and index.state(spark, path)["buckets"] == 256
    assert len(by_bucket(spark, path)) == 300
    before = index.state(spark, path)["base"]
    index.append(spark.createDataFrame([chunk("c-7-chunk-0", "new")], CHUNK), path, 3)
    (touched,) = index.state(spark, path)["late"][0]["touched"]
    assert index.compact(spark, path)
    after = index.state(spark, path)["base"]
    assert {k for k in after if after[k] != before.get(k)} == {str(touched)}
    assert by_bucket(spark, path)["c-7-chunk-0"] == "new"
    assert index.compact(spark, path, buckets=8) and set(index.state(spark, path)["base"]) <= set(map(str, range(8)))
    assert len(by_bucket(spark, path)) == 300
    index.vacuum(spark, path)
    assert len(by_bucket(spark, path)) == 300


@pytest.mark.parametrize("first", ["write", "growth"])
def test_a_write_beside_a_change_of_buckets_is_found_in_the_new_ones(spark, monkeypatch, first):
    path = fresh_path(spark, "log")
    index.append(base_rows(spark), path, 1)
    put, raced = commits.commit, []
    write = lambda: index.append(spark.createDataFrame([chunk("c-7-chunk-0", "new"), chunk("z")], CHUNK), path, 2)
    grow = lambda: index.compact(spark, path, buckets=24)
    inner, outer = (write, grow) if first == "write" else (grow, write)

    def race(*args):
        if not raced:
            raced.append(True)
            assert inner()
        return put(*args)

    monkeypatch.setattr(commits, "commit", race)
    assert outer()
    assert index.state(spark, path)["buckets"] == 24
    assert index.state(spark, path)["late"][0]["touched"] == list(range(24))
    found = by_bucket(spark, path)
    assert len(found) == 301 and found["c-7-chunk-0"] == "new"
    stale = index.current(spark, path, buckets=[1], count=64)  # numbers of before say nothing now
    assert stale.count() == 301
    assert index.compact(spark, path) and by_bucket(spark, path) == found


def test_jobs_without_messages_change_nothing(spark):
    path = fresh_path(spark, "log")
    none = spark.createDataFrame([], CHUNK)
    for seq in (1, 2):
        assert index.append(none, path, 2 * seq) == {"messages": 0, "chunks": 0, "embedded": 0}
        assert ingest.write_chunks(none, path, 2 * seq + 1) == {"messages": 0, "chunks": 0, "embedded": 0}
        assert index.compact(spark, path) and index.current(spark, path).count() == index.count(spark, path)
        index.append(base_rows(spark, 4), path, 10 + seq)
    assert index.current(spark, path).count() == 4


def test_merged_batches_are_ranges():
    batch = lambda w, n: {"writer": w, "batch": n}
    merged = index._with_merged({}, [batch("a", n) for n in (3, 1, 2, 7)] + [batch("b", 0)])
    assert merged == {"a": [[1, 3], [7, 7]], "b": [[0, 0]]}
    assert index._with_merged(merged, [batch("a", n) for n in (4, 5, 6)])["a"] == [[1, 7]]


def test_job_embeds_only_what_is_missing(spark):
    path = fresh_path(spark, "log")
    said = [("C1", f"{n}.0", "U1", f"message number {n}", None, None, None) for n in range(20)]
    raw = spark.createDataFrame(said, RAW_MESSAGE)
    first = ingest.run_index(normalize.normalize_messages(raw.filter("cast(ts as double) < 8")), path, 1)
    assert {r.metric: r.value for r in first.collect()} == {"messages": 8, "chunks": 8, "embedded": 8, "index_chunks": 8}
    again = ingest.run_index(normalize.normalize_messages(raw), path, 2)
    assert {r.metric: r.value for r in again.collect()} == {"messages": 20, "chunks": 20, "embedded": 12, "index_chunks": 20}
    fresh = index.with_vectors(ingest.index_documents(normalize.normalize_messages(raw))).drop("reused")
    assert rows(index.current(spark, path).select(fresh.columns)) == rows(fresh)


def test_a_long_channel_reaches_the_index_whole(spark):
    path = fresh_path(spark, "log")
    raw = spark.range(1500).selectExpr(
        "'C1' AS channel", "concat(id, '.0') AS ts", "'U' AS user", "concat('line ', id) AS text",
        "cast(null as string) AS bot_id", "cast(null as string) AS subtype", "cast(null as string) AS thread_ts",
    )
    roster = spark.createDataFrame([("C1", "one", True, 3, False)], "id string, name string, is_member boolean, num_members int, is_archived boolean")
    none = spark.createDataFrame([], CHUNK)
    ingest.run_index(ingest.backfill_messages(raw, roster, none), path, 1)
    assert index.current(spark, path).count() == 1500
    found = ingest.catchup_messages(raw, roster, dt.datetime(1970, 1, 1))
    assert found.count() == 1500


def test_known_permalink_can_be_kept(spark):
    path = fresh_path(spark, "log")
    index.append(spark.createDataFrame([chunk("a", url="https://x"), chunk("b")], CHUNK), path, 1)
    index.append(spark.createDataFrame([chunk("a"), chunk("b")], CHUNK), path, 2)
    log = index.read_log(spark, path)
    assert [r[6] for r in rows(index.latest(log))] == ["", ""]
    assert [r[6] for r in rows(index.latest(log, keep_known_permalink=True))] == ["https://x", ""]


def test_reset(spark):
    path = fresh_path(spark, "log")
    index.append(spark.createDataFrame([chunk("a")], CHUNK), path, 1)
    index.reset(spark, path)
    assert index.size(index.latest(index.read_log(spark, path))).first().chunks == 0
    index.append(spark.createDataFrame([chunk("b")], CHUNK), path, 2)
    assert index.size(index.latest(index.read_log(spark, path))).first().chunks == 1


def test_shared_folder_is_the_session_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = stored(spark.range(5), "t")
    assert kept.count() == 5
    assert kept.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark))


def test_shared_folder_without_a_setting():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default=None: default)
        context = SimpleNamespace(master=master, applicationId="app-test")
        return SimpleNamespace(conf=conf, sparkContext=context)

    for master in ("local[2]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_live_index_equals_batch_for_any_split(spark, sf_dir, tmp_path, parts):
    feed_dir, path, state = (str(tmp_path / n) for n in ("feed", "log", "state"))
    raw = conversation_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    raw.repartition(parts).write.parquet(feed_dir)
    feed = stream_messages(spark, feed_dir, max_files=1)
    for _ in range(2):  # the second start finds nothing new
        jobs.stream_index(feed, path, state, 1, available_now=True).awaitTermination()
    log = index.read_log(spark, path)
    want = rows(jobs.live_chunks(raw))
    assert log.count() == len(want)
    assert rows(index.latest(log).select(*index.DATA)) == want


@pytest.mark.parametrize("texts", [("zzz old", "aaa new"), ("aaa old", "zzz new")])
def test_the_last_write_wins_over_stream_and_batch(spark, tmp_path, texts):
    feed_dir, path, state = (str(tmp_path / n) for n in ("feed", "log", "state"))
    for n, text in enumerate((texts[0], texts[1])):
        row = ("C1", "1.0", "U1", text, None, None, None)
        spark.createDataFrame([row], RAW_MESSAGE).write.mode("append").parquet(feed_dir)
        if n:
            said = spark.createDataFrame([("C1-1.0-chunk-0", "batch old", "C1", "C1", "U1", "1.0", "", 0)], CHUNK)
            index.append(said, path, 2)
            assert [r.text for r in index.current(spark, path).collect()] == ["batch old"]
        jobs.stream_index(stream_messages(spark, feed_dir), path, state, 1, available_now=True).awaitTermination()
    assert [r.text for r in index.current(spark, path).collect()] == [texts[1]]
    index.compact(spark, path)
    assert [r.text for r in index.current(spark, path).collect()] == [texts[1]]


def test_a_replayed_feed_is_not_embedded_again(spark, tmp_path):
    feed_dir, path = (str(tmp_path / n) for n in ("feed", "log"))
    said = [("C1", f"{n}.0", "U1", f"message {n}", None, None, None) for n in range(6)]
    spark.createDataFrame(said, RAW_MESSAGE).write.parquet(feed_dir)
    for n in range(2):
        feed = stream_messages(spark, feed_dir)
        jobs.stream_index(feed, path, str(tmp_path / f"state-{n}"), 1, available_now=True, writer=f"w{n}").awaitTermination()
    assert {r.writer: (r.messages, r.rows, r.embedded) for r in index.batches(spark, path).collect()} == {
        "w0": (6, 6, 6), "w1": (6, 6, 0),
    }
    assert index.count(spark, path) == 6


def test_live_index_takes_late_files(spark, tmp_path):
    feed_dir, path, state = (str(tmp_path / n) for n in ("feed", "log", "state"))
    message = ("C1", "1.0", "U1", "hello there", None, None, None)
    for n in range(2):
        row = (message[0], f"{n}.0", *message[2:])
        spark.createDataFrame([row], RAW_MESSAGE).write.mode("append").parquet(feed_dir)
        feed = stream_messages(spark, feed_dir)
        jobs.stream_index(feed, path, state, 1, allowed="C1, C2", available_now=True).awaitTermination()
        assert index.latest(index.read_log(spark, path)).count() == n + 1


def test_backfill_on_join_equals_batch(spark, sf_dir, tmp_path):
    feed_dir, path, state = (str(tmp_path / n) for n in ("feed", "log", "state"))
    events = membership_events(spark.read.parquet(f"{sf_dir}/nation.parquet"))
    events.unionByName(events).write.parquet(feed_dir)  # every channel is joined twice
    posts = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "cast(c_nationkey as string) AS channel", "cast(c_custkey as string) AS ts", "c_name AS text",
        "c_mktsegment AS user", "cast(null as string) AS bot_id", "cast(null as string) AS subtype",
        "cast(null as string) AS thread_ts",
    )
    history = normalize.normalize_messages(posts)
    feed = stream_messages(spark, feed_dir, MEMBERSHIP_EVENT)
    jobs.stream_backfill(feed, history, BOT_USER, path, state, 1, available_now=True).awaitTermination()
    got = index.latest(index.read_log(spark, path))
    wanted = events.filter(f"user = '{BOT_USER}'").select("channel")
    batch = ingest.index_documents(history.join(wanted, "channel", "left_semi"))
    assert rows(got.select(*index.DATA)) == rows(batch) and got.count() > 0
    assert index.read_log(spark, path).count() == batch.count()  # a channel joined twice is read once


def test_questions_are_landed_then_answered_once(spark, tmp_path):
    feed_dir, path, state = (str(tmp_path / n) for n in ("feed", "asked", "state"))
    said = [
        ("D1", "1.0", "U1", "where is the red apple", None, None, None),
        ("D1", "2.0", "U1", " ", None, None, None),
        ("D1", "3.0", "U1", "zebra", None, None, "1.0"),
        ("C1", "4.0", "U1", "not a question", None, None, None),
        ("D1", "5.0", "B", "bot talk", "B1", None, None),
    ]
    spark.createDataFrame(said, RAW_MESSAGE).write.parquet(feed_dir)
    jobs.stream_questions(stream_messages(spark, feed_dir), path, state, available_now=True).awaitTermination()
    chunks = spark.createDataFrame([chunk("k", "the red apple is here", "https://x")], CHUNK)
    answered = jobs.answer_landed(spark, path, chunks)
    got = {r.query_id: (r.status, r.reply_to) for r in answered.collect()}
    assert got == {"D1-1.0": ("answerable", "1.0"), "D1-3.0": ("low_confidence", "1.0")}
    assert jobs.answer_landed(spark, path, chunks, answered).count() == 0
    none = jobs.answer_landed(spark, path, chunks.limit(0))
    assert {r.status for r in none.collect()} == {"no_hits"}
    answers = str(tmp_path / "answers")
    for run in (1, 2, 2):
        kept = jobs.write_answers(spark, path, answers, chunks, run)
    assert sorted((r.query_id, r.run) for r in kept.collect()) == [("D1-1.0", 1), ("D1-3.0", 1)]


@pytest.mark.parametrize("texts", [("zzz old", "aaa new"), ("aaa old", "zzz new")])
def test_an_edit_in_a_later_batch_wins(spark, tmp_path, texts):
    feed_dir, path, state = (str(tmp_path / n) for n in ("feed", "log", "state"))
    for text in texts:
        row = ("C1", "1.0", "U1", text, None, None, None)
        spark.createDataFrame([row], RAW_MESSAGE).write.mode("append").parquet(feed_dir)
        jobs.stream_index(stream_messages(spark, feed_dir), path, state, 1, available_now=True).awaitTermination()
    assert [r.text for r in index.current(spark, path).collect()] == [texts[1]]


def test_streams_and_batches_share_an_index_and_go_on_after_a_reset(spark, tmp_path):
    path = str(tmp_path / "log")

    def say(name, number):
        feed_dir, state = str(tmp_path / f"feed-{name}"), str(tmp_path / f"state-{name}")
        row = ("C1", f"{number}.0", "U1", f"{name} {number}", None, None, None)
        spark.createDataFrame([row], RAW_MESSAGE).write.mode("append").parquet(feed_dir)
        feed = stream_messages(spark, feed_dir)
        jobs.stream_index(feed, path, state, 1, available_now=True, writer=name).awaitTermination()

    held = lambda: sorted(r.text for r in index.current(spark, path).collect())
    say("one", 1)
    say("two", 2)
    index.append(spark.createDataFrame([chunk("x", "batch")], CHUNK), path, 5)
    say("one", 3)
    assert held() == ["batch", "one 1", "one 3", "two 2"]
    index.reset(spark, path)
    assert held() == []
    say("two", 4)
    assert held() == ["two 4"]


def test_questions_are_answered_as_they_come(spark, tmp_path):
    feed_dir, path, answers, state = (str(tmp_path / n) for n in ("feed", "log", "answers", "state"))
    index.append(spark.createDataFrame([chunk("k", "the red apple is here", "https://x")], CHUNK), path, 1)

    def ask(*said):
        rows = [("D1", ts, "U1", text, None, None, None) for ts, text in said]
        spark.createDataFrame(rows, RAW_MESSAGE).write.mode("append").parquet(feed_dir)

    def run():
        jobs.stream_answers(stream_messages(spark, feed_dir), path, answers, state, available_now=True).awaitTermination()
        return {r.query_id: (r.status, r.batch) for r in jobs.read_answers(spark, answers).collect()}

    ask(("1.0", "where is the red apple"), ("2.0", "blue pear"), ("3.0", " "))
    first = {"D1-1.0": ("answerable", 0), "D1-2.0": ("low_confidence", 0)}
    assert run() == first and run() == first  # a restart adds nothing
    index.append(spark.createDataFrame([chunk("p", "a blue pear", "https://y")], CHUNK), path, 2)
    ask(("4.0", "blue pear"), ("1.0", "where is the red apple"))  # one was asked before
    assert run() == {**first, "D1-4.0": ("answerable", 1)}
    index.reset(spark, path)
    ask(("5.0", "blue pear"))
    assert run()["D1-5.0"] == ("no_hits", 2)


def test_mentions_without_text_are_kept_as_empty(spark):
    said = [("C1", "1.0", "U1", "<@U9> ", None, None, None), ("C1", "2.0", "U1", "<@U9> hi", None, None, None)]
    asked = jobs.live_questions(spark.createDataFrame(said, RAW_MESSAGE), mentions=True)
    assert {r.query_id: (r.text, r.kind) for r in asked.collect()} == {
        "C1-1.0": ("", "empty"), "C1-2.0": ("hi", "question"),
    }


def test_message_time_is_exact(spark):
    from msgspark.functions.text import message_time

    row = spark.range(1).select(message_time(F.lit("1712345678.901201")).alias("t")).first()
    assert row.t == dt.datetime(2024, 4, 5, 19, 34, 38, 901201)
