"""Pages, files, work tables, streams and the catalogue."""

import hashlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mediaspark.operators import labels, work
from mediaspark.plans import streams
from mediaspark.sources import feeds, files, pages
from mediaspark.streaming import jobs

def tag(name, inner="", cls="", **attrs):
    """An element; the class names are those of the preview pages."""
    named = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in ({"class": cls} | attrs).items() if v)
    return f"<{name}{named}>{inner}</{name}>"


def message(number, *inner, feed="harbour"):
    return tag("div", "".join(inner), "tgme_widget_message", data_post=f"{feed}/{number}")


def photo(url, number):
    return tag("a", "", "tgme_widget_message_photo_wrap", style=f"background-image:url('{url}')", href=f"https://t.me/harbour/{number}")


def video(number, length, src=None):
    clip = tag("video", src=src) if src else ""
    return tag("a", clip + tag("time", length, "message_video_duration"), "tgme_widget_message_video_player", href=f"https://t.me/harbour/{number}")


def test_feed_page(spark):
    body = [
        message(7, video(7, "2:00:05"), tag("div", "long film", "tgme_widget_message_text")),
        message(8, feed="lighthouse"),
        message(12, photo("https://img.test/gull.png", 12), video(13, "1:40", "https://img.test/waves.mp4")),
        message(
            20,
            tag("div", "ferry<br>" + tag("a", "tickets", href="https://ferry.test/buy") + " here", "tgme_widget_message_text"),
            tag("a", tag("time", "noon", datetime="2024-06-05T12:30:00+00:00"), "tgme_widget_message_date"),
            tag("div", tag("a", "One") + tag("a", "Two"), "tgme_widget_message_inline_row"),
            photo("https://img.test/bay.jpg", 20),
        ),
    ]
    html = tag("html", '<meta property="og:title" content=" Harbour notes ">' + "".join(body) + tag("a", "", "tme_messages_more", data_before="7"))
    df = spark.createDataFrame([(3, "Harbour", html)], "page_id bigint, feed string, html string")
    parsed = pages.page_to_posts(df)
    page = parsed.first()
    assert (page.title, page.next_before, [p.id for p in page.posts]) == ("Harbour notes", 7, [7, 12, 20])
    last = page.posts[2]
    assert (last.text, last.links, last.buttons) == ("ferry\ntickets here", ["https://ferry.test/buy"], 2)
    media = pages.posts_to_media(pages.posts_of(parsed)).orderBy("item_id").collect()
    assert [(m.item_id, m.kind, m.url, m.duration) for m in media] == [
        (7, "too_big", "", 7205), (12, "photo", "https://img.test/gull.png", None),
        (13, "video", "https://img.test/waves.mp4", 100), (20, "photo", "https://img.test/bay.jpg", None),
    ]


def test_durations(spark):
    df = spark.createDataFrame([("0:14",), ("2:05",), ("1:00:00",), ("",), ("live",)], "d string")
    assert [r[0] for r in df.select(pages.parse_duration("d")).collect()] == [14, 125, 3600, None, None]


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "sub/b.mp4", "c.txt", ".d.png"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.name for r in files.scan_files(spark, str(tmp_path)).collect()) == ["a.JPG", "b.mp4"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("p/q.gif", "__MACOSX/x.gif", "p/.h.gif", "big.gif"):
            z.writestr(name, "y" * (50 if name == "big.gif" else 3))
    raw = [("z.zip", bytearray((tmp_path / "z.zip").read_bytes())), ("bad.zip", bytearray(b"PK no archive")), ("none.zip", None)]
    got = files.scan_archive(spark.createDataFrame(raw, "name string, content binary"), max_bytes=10).collect()
    assert sorted((r.ref, r.too_large) for r in got if not r.error) == [("z.zip:big.gif", True), ("z.zip:p/q.gif", False)]
    assert sorted(r.ref for r in got if r.error) == ["bad.zip", "none.zip"]


def test_history_stops_at_failure(spark):
    posts = spark.createDataFrame([(1, i, i == 5) for i in range(1, 10)], "feed_id bigint, post_id bigint, failed boolean")
    f = spark.createDataFrame([(1, 8, 8, 0, 0, False)], "feed_id bigint, last_post_id bigint, oldest_post_id bigint, history_posts bigint, backfill_limit int, history_done boolean")
    handled, state = feeds.history_backfill(posts, f)
    assert sorted(r.post_id for r in handled.collect()) == [6, 7]
    assert state.first().asDict() == {"feed_id": 1, "oldest_post_id": 6, "history_posts": 2, "history_done": False}
    _, done = feeds.history_backfill(posts.withColumn("failed", F.lit(False)), f)
    assert done.first().history_done and done.first().oldest_post_id == 1


def test_feed_backoff(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 7)], "n int")
    wait, status = work.feed_backoff(F.col("n"))
    assert [tuple(r) for r in df.select(wait, status).collect()] == [
        (1.0, "pending"), (2.0, "pending"), (4.0, "pending"), (8.0, "pending"), (16.0, "pending"), (30.0, "failed"),
    ]


@pytest.mark.parametrize("bucket", [86_400, 7])
def test_streaks_do_not_depend_on_buckets(spark, bucket):
    flags = [1, 1, 0, 1, 1, 1, 1, 0, 0, 1]
    rows = [(1, i, bool(f)) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "key bigint, seq bigint, failed boolean").withColumn("ts", F.timestamp_seconds(F.col("seq") * 3))
    got = [r.streak for r in work.failure_streaks(df, bucket).orderBy("seq").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 4, 0, 0, 1]


def test_scopes_in_one_pass(spark):
    rows = [(1, "done", "", 2, "2024-01-01"), (2, "failed", "Connection reset by peer", 1, "2024-01-01"), (3, "failed", "decode failed", 1, "2024-01-01"), (4, "processing", "", 0, "2024-02-29"), (5, "pending", "", 0, "2024-03-01")]
    df = spark.createDataFrame(rows, "id long, status string, error string, attempts int, at string").withColumn("updated_at", F.col("at").cast("timestamp"))
    now = F.lit("2024-03-01").cast("timestamp")
    got = work.select_scopes(df, now)
    for scope in work.SCOPES:
        one = work.select_scope(df, scope, now)
        assert sorted(got.filter(F.col("scope") == scope).drop("scope").collect()) == sorted(one.collect())
    assert got.count() == sum(work.select_scope(df, s, now).count() for s in work.SCOPES)


def test_encoder_is_signed_hashing():
    encode = labels.hashing_encoder(16)
    texts = [["query", "cat", "cat"], [], ["dog"]]
    want = np.zeros((3, 16))
    for i, words in enumerate(texts):
        for w in words:
            h = hashlib.md5(w.encode()).hexdigest()
            want[i, int(h[:6], 16) % 16] += 1 if int(h[6], 16) < 8 else -1
    assert (encode(texts) == want).all() and encode([[]]).tolist() == [[0.0] * 16]


def test_sounds(spark):
    rows = [(1, 0, "Music", 0.6), (1, 1, "Music", 0.8), (1, 0, "Speech", 0.9), (1, 0, "Dog", 0.1), (1, 1, "Unknown thing", 0.2)]
    tags = labels.audio_tags(spark.createDataFrame(rows, "item_id bigint, window bigint, label string, score double"))
    assert [(r.label, r.score) for r in tags.orderBy("r").collect()] == [("Music", 0.8), ("Unknown thing", 0.2)]
    assert labels.tag_labels(tags).first().sounds == ["music / музыка", "unknown thing"]
    assert labels.has_music(tags).first().music


def test_debounce_rule(spark, tmp_path):
    seconds = [0, 10, 20, 70, 100, 130, 131, 500]
    df = spark.createDataFrame([("v", s) for s in seconds], "scope string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted(r.bump for r in jobs.run_available(jobs.debounce(stream), "t").collect())
    assert got == [0, 60, 120, 180, 500]


def test_stream_equals_batch(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))

    def same(a, b, cols):
        assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))

    stream = jobs.event_stream(spark, sf, schema)
    cols = ["item_id", "request_seq", "done_seq", "waited_us"]
    same(jobs.run_available(jobs.stream_notify(streams.requests(stream)), "n"), jobs.notify_join(streams.requests(batch)), cols)

    def owned(df):
        return df.select(F.col("user_id").alias("owner"), F.col("event_type").alias("outcome"))

    same(jobs.run_available(jobs.counters(owned(stream)), "c", "update"), jobs.counters(owned(batch)), ["owner", "outcome", "n"])


def sliced(spark, rows, schema, folder, batches):
    """Rows as files of one batch each, in order of time."""
    rows = sorted(rows, key=lambda r: r[1])
    step = -(-len(rows) // batches)
    for k in range(batches):
        part = spark.createDataFrame(rows[k * step : (k + 1) * step], schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        part.coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.read.parquet(f"{folder}/*"), spark.read.parquet(f"{folder}/000").schema


def run_twice(spark, folder, schema, job, tmp_path, mode):
    """Six batches, the query ended and started again after the third; rows with their batch, and the last progress."""
    out, offsets, rows, last = str(tmp_path / "out"), str(tmp_path / "offsets"), [], None
    for files in (3, 6):
        for k in range(files):
            spark.read.parquet(f"{folder}/{k:03d}").write.mode("ignore").parquet(f"{tmp_path}/live/{k:03d}")
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/live")
        write = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")
        query = job(raw).writeStream.outputMode(mode).option("checkpointLocation", offsets).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        last = query.recentProgress
    return spark.read.parquet(out), last


CALLS = [(k % 4, 1000 + 40 * k + (7 * k) % 30, k, (k * k) % 5 != 0) for k in range(600)]


def test_windows_over_batches(spark, tmp_path):
    """K1 and K3 in append mode over six batches with a restart: the rows of closed windows equal the batch form."""
    folder = str(tmp_path / "in")
    batch, schema = sliced(spark, CALLS, "caller long, s long, seq long, failed boolean", folder, 6)
    for name, job, end in (("a", lambda d: jobs.rate_limit(d, limit=1), lambda r: r.minute), ("b", jobs.rate_10m, lambda r: r["at"])):
        (tmp_path / name).mkdir()
        got, _ = run_twice(spark, folder, schema, job, tmp_path / name, "append")
        want = job(batch).collect()
        rows = got.drop("batch").select(*job(batch).columns).collect()
        closed = max(map(end, rows))
        assert len(rows) > 100 and sorted(map(tuple, rows)) == sorted(tuple(r) for r in want if end(r) <= closed)


def test_latest_state_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(k % 7, 60 * k, k, f"status{k % 5}") for k in range(120)]
    batch, schema = sliced(spark, rows, "item_id long, s long, seq long, status string", folder, 6)
    got, _ = run_twice(spark, folder, schema, jobs.latest_state, tmp_path, "update")
    assert sorted(map(tuple, jobs.newest(got, ["item_id"]).collect())) == sorted(map(tuple, jobs.latest_state(batch).collect()))


def fold_throttle(rows, limit, life):
    held, out = {}, []
    for caller, s, seq, failed in sorted(rows, key=lambda r: (r[1], r[2])):
        count, until = held.get(caller, (0, 0))
        if s >= until:
            count = 0
        out.append((caller, seq, count >= limit))
        if count < limit:
            held[caller] = (count + 1, s + life) if failed else (0, 0)
    return sorted(out)


def test_state_over_batches_ends(spark, tmp_path):
    """K2, K4 and K8 over six batches with a restart equal a plain fold, and no state is left once the log is quiet."""
    quiet = [(9, 10**6 + k, 10_000 + k, False) for k in range(100)]
    folder = str(tmp_path / "in")
    batch, schema = sliced(spark, CALLS[:500] + quiet, "caller long, s long, seq long, failed boolean", folder, 6)
    (tmp_path / "k2").mkdir()
    got, progress = run_twice(spark, folder, schema, lambda d: jobs.throttle_with_clear(d, limit=3, life_seconds=120), tmp_path / "k2", "append")
    assert sorted((r.caller, r.seq, r.refused) for r in got.collect()) == fold_throttle(CALLS[:500] + quiet, 3, 120)
    assert progress[-1].stateOperators[0].numRowsTotal == 0

    (tmp_path / "k8").mkdir()
    results = lambda d: d.select(F.col("caller").alias("item_id"), "ts", "seq", F.when(F.col("caller") == 9, "done").when(F.col("failed"), "transient").otherwise("other").alias("outcome"))
    got, progress = run_twice(spark, folder, schema, lambda d: jobs.retry_state(results(d), life=3600), tmp_path / "k8", "update")
    want = {}
    for caller, _, _, failed in sorted(CALLS[:500], key=lambda r: (r[1], r[2])):
        attempts, passing = want.get(caller, (0, 0))
        want[caller] = (attempts, passing + 1) if failed and passing < 12 else (attempts + 1, passing)
    last = {r.item_id: (r.attempts, r.transient) for r in jobs.newest(got, ["item_id"]).collect()}
    assert last == want | {9: (0, 0)} and progress[-1].stateOperators[0].numRowsTotal == 0

    (tmp_path / "k4").mkdir()
    changes = lambda d: d.select(F.lit("v").alias("scope"), "ts")
    got, progress = run_twice(spark, folder, schema, lambda d: jobs.debounce(changes(d), every=90), tmp_path / "k4", "append")
    bumps = []
    for s in sorted({r[1] for r in CALLS[:500] + quiet}):
        if not bumps or s >= bumps[-1] + 90:
            bumps.append(s)
        elif s > bumps[-1]:
            bumps.append(bumps[-1] + 90)
    assert sorted(r.bump for r in got.collect()) == bumps


def test_ingest_twice_adds_once(spark, sf):
    out = streams.stream_ingest(spark, sf)
    assert out.count() == out.select("sha256").distinct().count() == out.select("url").distinct().count() > 0


def test_catalogue():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 126


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["q", "id", "score", "r", "total", "semantic"] and out.count() > 0
