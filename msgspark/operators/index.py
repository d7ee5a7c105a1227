"""The chunk index: committed batches over a bucketed base, merged when read.

A write is a folder of rows that becomes visible with its commit (``sources.commits``);
batch jobs, any number of streams and compactions share one index and never wait for each
other. A reader opens the state of the last commit and keeps it.

``data/batch=…`` holds the rows of one write as they came, ``data/base=…/bucket=…`` those
of a compaction by a hash of the message id, one row an id. A compaction rewrites only
the buckets that the batches it merges have rows of; when the index has outgrown its
buckets it rewrites all of it into more, so a bucket does not grow with the index.

The newest row of an id wins: by the version of its message (its time, or that of its
edit), then by the number of the commit, whoever wrote it. None is read from a clock. A
replay of a writer's batch takes the place of the first, with its number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import DIM, term_vector
from ..schemas import CHUNK, INDEX_ROW
from ..sources import commits
from ..sources.commits import State
from ..sources.storage import tidy

DATA = [f.name for f in CHUNK.fields]
VECTOR = ["text_hash", "buckets", "weights"]
FIELDS = [f.name for f in INDEX_ROW.fields]
PLACE = ["version", "commit", "late"]
ROW = ["_file", "_row"]
#: Buckets of a new index; a batch of few messages reads and rewrites few of them.
BUCKETS = 64
#: Rows that a bucket may hold on average; an index that outgrew it gets twice the buckets.
BUCKET_ROWS = 4_000_000
#: Keys of this many rows, some 100 bytes each, may travel to every task.
MOST_SENT = 200_000
#: A bit for each of this many rows may travel to every task.
MOST_MARKED = 1 << 29
#: Rows that one bitmap of Spark's has bits for.
MARKS = 1 << 15
#: Buckets of a compaction of many rows are made in so many rounds, whose shuffle files go one after the other.
ROUNDS = 4
#: Parquet codec of the index: two thirds of the bytes of the default one.
CODEC = "zstd"


def _place() -> Column:
    return F.struct(*PLACE)


def message_id() -> Column:
    return F.regexp_replace("id", "-chunk-[0-9]+$", "")


def bucket_of(count: int) -> Column:
    return F.pmod(F.xxhash64(message_id()), F.lit(count)).cast("int")


def with_vectors(chunks: DataFrame, existing: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Add ``text_hash``, ``buckets``, ``weights`` and ``reused``.

    ``existing`` index rows (one an id) lend their vector to the same id and text; only the
    rest is embedded. ``few`` says that the ids of ``chunks`` may travel to every task:
    of the index then only their rows are moved.
    """
    rows = chunks.withColumn("text_hash", F.md5("text"))
    if existing is None:
        return rows.withColumn("_v", term_vector(F.col("text"), DIM)).select(
            *rows.columns, F.col("_v.buckets"), F.col("_v.weights"), F.lit(False).alias("reused")
        )
    known = existing.select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.struct("buckets", "weights").alias("_known")
    )
    if few:
        ids = F.broadcast(chunks.select(F.col("id").alias("_id")).distinct())
        known = known.join(ids, "_id", "left_semi")
    joined = rows.join(known, (F.col("id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    reused = F.col("_known").isNotNull()
    made = joined.withColumn("reused", reused).withColumn("_v", term_vector(F.when(~reused, F.col("text")), DIM))
    return made.withColumn("_v", F.when(F.col("reused"), F.col("_known")).otherwise(F.col("_v"))).select(
        *rows.columns, F.col("_v.buckets"), F.col("_v.weights"), "reused"
    )


def as_log(chunks: DataFrame) -> DataFrame:
    """Index rows of one write, with their version; nothing is moved or sorted.

    ``version`` is a column of ``chunks`` or else the message time; text without one
    counts as older than all. The commit is known when the rows are read.
    """
    if "buckets" not in chunks.columns:
        chunks = with_vectors(chunks)
    version = F.col("version") if "version" in chunks.columns else F.col("ts")
    return chunks.withColumns({
        "version": F.coalesce(version.try_cast("decimal(16,6)"), F.lit(-1).cast("decimal(16,6)")),
        "commit": F.lit(None).cast("bigint"),
    }).select(*FIELDS)


def _one_per_id(rows: DataFrame) -> DataFrame:
    """Of several rows of an id in one write the newest version, then the least text."""
    rest = [F.col(c).asc_nulls_last() for c in DATA if c != "id"]
    newest = Window.partitionBy("id").orderBy(F.col("version").desc(), *rest)
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(*FIELDS)


def state(spark: SparkSession, path: str) -> State:
    """What the last commit says: buckets, base, late batches, merged batches, folders out of use."""
    last = commits.newest(spark, path)
    return last[1] if last else {}


def exists(spark: SparkSession, path: str) -> bool:
    return commits.newest(spark, path) is not None


def _begun(now: State) -> State:
    return {"buckets": BUCKETS, "base": {}, "late": [], "merged": {}, "unused": [], **now}


def _folders(now: State) -> list[str]:
    base = [f"{b['folder']}/bucket={k}" for k, b in now["base"].items()]
    return base + [b["folder"] for b in now["late"]]


def _is_merged(now: State, writer: str, batch: int) -> bool:
    return any(low <= batch <= high for low, high in now.get("merged", {}).get(writer, []))


def _with_merged(merged: dict, batches: list[dict]) -> dict:
    """Merged batch numbers of every writer as ranges, which are few for numbers in a row."""
    out = dict(merged)
    for writer in {b["writer"] for b in batches}:
        spans = sorted(out.get(writer, []) + [[b["batch"], b["batch"]] for b in batches if b["writer"] == writer])
        joined = [spans[0]]
        for low, high in spans[1:]:
            if low <= joined[-1][1] + 1:
                joined[-1] = [joined[-1][0], max(high, joined[-1][1])]
            else:
                joined.append([low, high])
        out[writer] = joined
    return out


def append(
    chunks: DataFrame, path: str, seq: int, writer: str = "batch", batch: int | None = None
) -> dict[str, int] | None:
    """Commit chunk rows as one batch of a writer; a batch job has its ``seq`` for the batch number.

    The same writer and batch again take the place of the first, also in the order of
    writers; one that a compaction has merged already is left out. Rows are written as
    they come; only if an id repeats within the batch, they are moved to keep one each.
    Returns the counts of the batch, taken while it was written: messages, chunks, and of
    those the embedded ones (all, unless ``chunks`` have a column reused). None if it was
    merged before.
    """
    spark = chunks.sparkSession
    batch = seq if batch is None else batch
    now = _begun(state(spark, path))
    buckets = now["buckets"]
    if _is_merged(now, writer, batch):
        return None
    if "buckets" not in chunks.columns:
        chunks = with_vectors(chunks)
    fresh = ~F.col("reused") if "reused" in chunks.columns else F.lit(True)
    seen = Observation()
    folder = f"data/batch={uuid.uuid4().hex}"
    rows = chunks.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("chunk_index") == 0).alias("messages"),
        F.count_if(fresh).alias("embedded"),
        F.collect_set(bucket_of(buckets)).alias("touched"),
    )
    spare = []
    with tidy(spark):
        as_log(rows).write.option("compression", CODEC).parquet(f"{path}/{folder}")
        facts = dict(seen.get)
        written = spark.read.schema(INDEX_ROW).parquet(f"{path}/{folder}")
        if not written.groupBy("id").count().filter("count > 1").isEmpty():
            spare, folder = [folder], f"data/batch={uuid.uuid4().hex}"
            once = Observation()
            kept = _one_per_id(written).observe(once, F.count(F.lit(1)).alias("rows"))
            kept.write.option("compression", CODEC).parquet(f"{path}/{folder}")
            facts["rows"] = once.get["rows"]
    facts["touched"] = sorted(facts["touched"])

    def change(now: State, number: int) -> State | None:
        now = _begun(now)
        if _is_merged(now, writer, batch):
            return {**now, "unused": now["unused"] + [*spare, folder]}
        same = [b for b in now["late"] if (b["writer"], b["batch"]) == (writer, batch)]
        place = same[0]["commit"] if same else number
        entry = {"folder": folder, "writer": writer, "batch": batch, "commit": place, **facts}
        if now["buckets"] != buckets:
            entry["touched"] = list(range(now["buckets"]))
        return {
            **now,
            "late": [b for b in now["late"] if b not in same] + [entry],
            "unused": now["unused"] + spare + [b["folder"] for b in same],
        }

    commits.commit(spark, path, change)
    return {"messages": facts["messages"], "chunks": facts["rows"], "embedded": facts["embedded"]}


def _read(reader: DataFrameReader, folders: list[str], placed: bool) -> DataFrame:
    """Rows of folders; ``placed`` adds the file of a row and its number there."""
    rows = reader.parquet(*folders)
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return rows.select("*", *at) if placed else rows


def _late(spark: SparkSession, path: str, batches: list[dict], placed: bool = False) -> DataFrame:
    """Rows of committed batches with the number of their commit."""
    kind = T.StructType([*INDEX_ROW.fields, T.StructField("batch", T.StringType())])
    at = ROW if placed else []
    if not batches:
        none = spark.createDataFrame([], INDEX_ROW).withColumn("late", F.lit(1))
        return none.withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("bigint")}) if placed else none
    reader = spark.read.schema(kind).option("basePath", f"{path}/data")
    rows = _read(reader, [f"{path}/{b['folder']}" for b in batches], placed)
    numbers = spark.createDataFrame(
        [(b["folder"].rpartition("=")[2], b["commit"]) for b in batches], "batch string, _commit bigint"
    )
    numbered = rows.join(F.broadcast(numbers), "batch").withColumn("commit", F.col("_commit"))
    return numbered.select(*FIELDS, F.lit(1).alias("late"), *at)


def _base(spark: SparkSession, path: str, base: dict, placed: bool = False) -> DataFrame | None:
    if not base:
        return None
    folders = sorted(_folders({"base": base, "late": []}))
    rows = _read(spark.read.schema(INDEX_ROW), [f"{path}/{f}" for f in folders], placed)
    return rows.withColumn("late", F.lit(0))


def _merged_rows(base: DataFrame | None, late: DataFrame, few: bool) -> DataFrame:
    """Newest row of every id. Winners among the late rows, and the base rows that they
    meet, are found on ids and places alone; while those are few, no text is moved."""
    send = F.broadcast if few else (lambda df: df)
    keys = late.select("id", *PLACE)
    if base is not None:
        ids = send(late.select("id").distinct())
        keys = keys.unionByName(base.select("id", *PLACE).join(ids, "id", "left_semi"))
    best = keys.groupBy("id").agg(F.max(_place()).alias("_best"))
    won = late.join(send(best), "id").filter(_place() == F.col("_best")).drop("_best")
    if base is None:
        return won
    kept = base.join(send(best), "id", "left").filter(F.col("_best").isNull() | (_place() == F.col("_best")))
    return kept.drop("_best").unionByName(won)


def _unmarked_rows(base: DataFrame | None, late: DataFrame) -> DataFrame:
    """The same of rows with their places in files, whatever the number of the late ones.

    Only ids and places are moved. They give a bit to every row, set for those that a newer
    one replaces; the bits travel to the scans, which leave these rows out where they lie.
    """
    late = late.filter(F.col("id").isNotNull())
    rows = late if base is None else base.unionByName(late)
    newest = F.max(_place()).over(Window.partitionBy("id"))
    keys = rows.filter(F.col("id").isNotNull()).select("id", *PLACE, *ROW)
    old = keys.withColumn("_best", newest).filter(_place() < F.col("_best"))
    marks = old.groupBy(F.col("_file").alias("_in"), F.expr(f"_row div {MARKS}").alias("_part")).agg(
        F.bitmap_construct_agg(F.col("_row") % MARKS).alias("_marks")
    )
    on = (F.col("_file") == F.col("_in")) & (F.expr(f"_row div {MARKS}") == F.col("_part"))
    held = F.expr(f"conv(hex(substring(_marks, cast(_row % {MARKS} div 8 as int) + 1, 1)), 16, 10)").cast("int")
    marked = held.bitwiseAND(F.expr("shiftleft(1, cast(_row % 8 as int))")) != 0
    joined = rows.join(F.broadcast(marks), on, "left").filter(F.col("_marks").isNull() | ~marked)
    return joined.select(*FIELDS, "late")


def _newest(
    spark: SparkSession, path: str, base: dict, batches: list[dict], only: Column | None = None
) -> DataFrame:
    """Newest row of every id of buckets of the base and batches; of those that ``only`` holds for."""
    late = sum(b["rows"] for b in batches)
    few = late <= MOST_SENT
    placed = not few and late + sum(b["rows"] for b in base.values()) <= MOST_MARKED
    of = lambda rows: rows if rows is None or only is None else rows.filter(only)
    if len(batches) == 1 and not base:
        # nothing to merge: a write holds every id once
        return of(_late(spark, path, batches)).filter(F.col("id").isNotNull())
    old, new = of(_base(spark, path, base, placed)), of(_late(spark, path, batches, placed))
    return _unmarked_rows(old, new) if placed else _merged_rows(old, new, few)


def _opened(spark: SparkSession, path: str, now: State, buckets: list[int] | None = None) -> DataFrame:
    now = _begun(now)
    wanted = None if buckets is None else set(buckets)
    base = {k: b for k, b in now["base"].items() if wanted is None or int(k) in wanted}
    batches = [b for b in now["late"] if wanted is None or wanted & set(b["touched"])]
    if not batches and base:
        return _base(spark, path, base)
    rows = _newest(spark, path, base, batches)
    return rows if wanted is None else rows.filter(bucket_of(now["buckets"]).isin(*wanted))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the last state, also those that a later write replaces."""
    now = _begun(state(spark, path))
    late, base = _late(spark, path, now["late"]), _base(spark, path, now["base"])
    return late if base is None else base.unionByName(late)


def latest(log: DataFrame, keep_known_permalink: bool = False) -> DataFrame:
    """Newest row per chunk id of a log, with its vector.

    ``keep_known_permalink`` carries an older permalink over a newer empty one.
    """
    rows = _merged_rows(None, log, False)
    return (_known_permalinks(rows, log) if keep_known_permalink else rows).select(*DATA, *VECTOR)


def _known_permalinks(rows: DataFrame, log: DataFrame) -> DataFrame:
    known = log.filter(F.col("permalink") != "").groupBy(F.col("id").alias("_kid")).agg(
        F.max_by("permalink", _place()).alias("_url")
    )
    joined = rows.join(known, rows["id"] == known["_kid"], "left")
    url = F.when(F.col("permalink") == "", F.coalesce("_url", F.lit(""))).otherwise(F.col("permalink"))
    return joined.withColumn("permalink", url)


def current(
    spark: SparkSession, path: str, buckets: list[int] | None = None, count: int | None = None
) -> DataFrame:
    """The index as the last commit left it: one row an id, with its vector.

    With ``buckets`` only messages of those, which reads their files of the base alone;
    if the index meanwhile has another ``count`` of them than they were taken from, all.
    What the late batches do not touch is only scanned. Nothing is written.
    """
    now = _begun(state(spark, path))
    if count not in (None, now["buckets"]):
        buckets = None
    return _opened(spark, path, now, buckets).select(*DATA, *VECTOR)


def upsert(index: DataFrame, updates: DataFrame, replace_document: bool = False) -> DataFrame:
    """Index with ``updates`` inserted or replacing rows of the same id.

    Of several updates of one id the greatest text counts. The index side keeps its
    rows by an anti join on the key alone; it is not ranked or rewritten row by row.
    ``replace_document`` also drops the old chunks of every updated message, so a
    shorter message leaves none behind.
    """
    rest = [F.col(c).desc_nulls_last() for c in ("text", *(c for c in DATA if c not in ("id", "text")))]
    one = Window.partitionBy("id").orderBy(*rest)
    updates = updates.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    if replace_document:
        changed = updates.select(message_id().alias("_doc")).distinct()
        kept = index.join(changed, message_id() == changed["_doc"], "left_anti")
    else:
        kept = index.join(updates.select("id"), "id", "left_anti")
    return kept.select(*DATA).unionByName(updates.select(*DATA))


def _fitting(now: State) -> int:
    """Buckets the index needs; they only ever double, so rewriting all is rare."""
    rows = sum(b["rows"] for b in [*now["base"].values(), *now["late"]])
    count = now["buckets"]
    while rows > count * BUCKET_ROWS:
        count *= 2
    return count


def _rounds(wanted: Iterable[int], old: dict, batches: list[dict]) -> list[list[int]]:
    """Buckets to make, those of a round together; a round moves its rows only."""
    wanted = list(wanted)
    rounds = ROUNDS if sum(b["rows"] for b in [*old.values(), *batches]) > MOST_SENT else 1
    return [part for n in range(rounds) if (part := wanted[n::rounds])]


def _made(spark: SparkSession, path: str, rows: DataFrame, count: int) -> dict:
    """Write rows by bucket to a folder of the base; the buckets that there are with their rows."""
    folder = f"data/base={uuid.uuid4().hex}"
    bucketed = rows.select(*FIELDS).withColumn("bucket", bucket_of(count)).hint("rebalance", "bucket")
    with tidy(spark):
        bucketed.write.option("compression", CODEC).partitionBy("bucket").parquet(f"{path}/{folder}")
        kind = T.StructType([*INDEX_ROW.fields, T.StructField("bucket", T.IntegerType())])
        counts = spark.read.schema(kind).parquet(f"{path}/{folder}").groupBy("bucket").count().collect()
    return {str(r.bucket): {"folder": folder, "rows": r["count"]} for r in counts}


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> bool:
    """Merge the late batches into the base, bucket by bucket, while readers and writers go on.

    Rewrites the buckets that the batches have rows of and nothing else; batches that are
    committed meanwhile stay late. With another number of ``buckets`` than the index has,
    or when it has outgrown those it has, the whole base is rewritten into the new ones.
    If another compaction or a reset came first, nothing changes and the answer is False.
    """
    now = _begun(state(spark, path))
    batches = now["late"]
    count = buckets or _fitting(now)
    anew = count != now["buckets"]
    if not batches and not anew:
        return True
    touched = {str(k) for b in batches for k in b["touched"]}
    old = {k: b for k, b in now["base"].items() if anew or k in touched}
    made = {}
    for wanted in _rounds(range(count) if anew else sorted(map(int, touched)), old, batches):
        part = old if anew else {str(k): old[str(k)] for k in wanted if str(k) in old}
        late = [b for b in batches if anew or {*wanted} & {*b["touched"]}]
        made |= _made(spark, path, _newest(spark, path, part, late, bucket_of(count).isin(*wanted)), count)
    own = {b["folder"] for b in batches}

    def change(then: State, number: int) -> State | None:
        then = _begun(then)
        names = {(b["writer"], b["batch"]) for b in then["late"]}
        if then["buckets"] != now["buckets"] or any((b["writer"], b["batch"]) not in names for b in batches):
            return None
        if {k: b for k, b in then["base"].items() if anew or k in touched} != old:
            return None
        late = [b for b in then["late"] if b["folder"] not in own]
        if anew:  # where their rows fall now is not known
            late = [{**b, "touched": list(range(count))} for b in late]
        return {
            **then,
            "buckets": count,
            "base": made if anew else {**then["base"], **made},
            "late": late,
            "merged": _with_merged(then["merged"], batches),
            "unused": then["unused"] + _folders({"base": old, "late": [b for b in then["late"] if b["folder"] in own]}),
        }

    return commits.commit(spark, path, change) is not None


def reset(spark: SparkSession, path: str) -> None:
    """Empty the index with one commit; every writer may begin anew."""

    def change(now: State, number: int) -> State:
        now = _begun(now)
        return {**now, "base": {}, "late": [], "merged": {}, "unused": now["unused"] + _folders(now)}

    commits.commit(spark, path, change)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove what no state names any more, once no reader holds an earlier one."""
    gone: list[str] = []

    def change(now: State, number: int) -> State:
        now = _begun(now)
        gone[:] = sorted(set(now["unused"]) - set(_folders(now)))
        return {**now, "unused": []}

    commits.commit(spark, path, change)
    for folder in gone:
        commits.remove(spark, f"{path}/{folder}")
    commits.trim(spark, path)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Counts of the batches that no compaction has merged yet, as their writers took them."""
    rows = [tuple(b[c] for c in _BATCH) for b in _begun(state(spark, path))["late"]]
    kinds = ", ".join(f"{c} {'string' if c == 'writer' else 'bigint'}" for c in _BATCH)
    return spark.createDataFrame(rows, kinds)


_BATCH = ("writer", "batch", "commit", "messages", "rows", "embedded")


def size(chunks: DataFrame) -> DataFrame:
    """Number of chunks in the index as ``chunks``."""
    return chunks.agg(F.count("*").alias("chunks"))


def count(spark: SparkSession, path: str) -> int:
    """Number of chunks in the index: the base's own count and the ids that late batches add to it."""
    now = _begun(state(spark, path))
    held = sum(b["rows"] for b in now["base"].values())
    if not now["late"]:
        return held
    touched = {k for b in now["late"] for k in b["touched"]}
    base = _base(spark, path, {k: b for k, b in now["base"].items() if int(k) in touched})
    new = _late(spark, path, now["late"]).select("id").distinct()
    if base is not None:
        new = new.join(base.select("id"), "id", "left_anti")
    return held + new.count()
