"""MinHash near-dedup: fast similarity sketches, banding, exact verification on full sets.

Documents with equal shingle sets form one class, so a group of copies, however
large, is one node from here on. Classes that share a band bucket and whose sketches
agree enough are put in one neighbourhood; inside each neighbourhood the full sets
are compared and only confirmed links join classes. No pair list is ever written:
a task that compares a block of classes returns one row per class it could connect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix, packed, slices, utf8
from .components import components
from .scratch import Scratch
from .shingles import distinct_sets, shingle_hashes, sketches

WORDS = 5
PERCENT = 85
BANDS, ROWS = 26, 5
#: A pair at the similarity limit agrees in fewer coordinates with a probability below 2e-7.
SLACK = 0.20
BLOCK_ROWS = 400
BLOCK_BYTES = 12 << 20
_PAIR = "a binary, b binary"


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(packed(batches, "text", 2 << 20), "text"):
            sets, bounds = distinct_sets(*shingle_hashes(data, offsets, words))
            coordinates = sketches(sets, bounds, bands * rows)
            folded = np.zeros((part.num_rows, bands), dtype=U)
            for k in range(rows):
                folded = mix(folded * U(0x2545F4914F6CDD1D) + coordinates[:, k::rows])
            sizes = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes),
                    pa.array(np.diff(offsets)),
                    pa.array(_classes(sets, bounds), pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(0, folded.size + 1, bands, dtype=np.int32),
                        folded.reshape(-1).view(np.int64),
                    ),
                    pa.array(
                        [row.tobytes() for row in _short(coordinates)], pa.binary()
                    ),
                ],
                names=["doc_id", "n", "bytes", "class", "bands", "sketch"],
            )

    return run


def _classes(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128-bit identity of each set; none for an empty one."""
    return [
        hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None
        for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]


def _short(coordinates: np.ndarray) -> np.ndarray:
    return (mix(coordinates) & U(0xFFFF)).astype(np.uint16)


def _agreement(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Number of equal coordinates of every left row with all right rows, a row at a time."""
    if len(right) <= 128:
        for a in range(0, len(left), 32):
            counts = (left[a : a + 32, None, :] == right[None]).sum(axis=2)
            yield from enumerate(counts, a)
        return
    columns = np.ascontiguousarray(right.T)
    for x in range(len(left)):
        count = np.zeros(len(right), dtype=np.uint16)
        for k in range(len(columns)):
            count += columns[k] == left[x, k]
        yield x, count


def _stars(labels: np.ndarray, names: list[bytes]) -> pa.Table:
    """One row (root, member) for every member that is not its own root."""
    away = np.flatnonzero(labels != np.arange(len(labels)))
    return pa.table(
        {
            "a": pa.array([names[i] for i in labels[away]], pa.binary()),
            "b": pa.array([names[i] for i in away], pa.binary()),
        }
    )


def _plausible(least: int):
    """Connect the classes of one bucket block whose sketches agree in ``least`` coordinates."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("class").to_pylist()
        sketch = np.frombuffer(
            b"".join(table.column("sketch").to_pylist()), dtype=np.uint16
        ).reshape(len(names), -1)
        labels = np.arange(len(names))
        for x, count in _agreement(sketch, sketch):
            near = np.unique(labels[:x][count[:x] >= least])
            if near.size:
                root = min(near[0], labels[x])
                labels[np.isin(labels, near) | (labels == labels[x])] = root
        return _stars(labels, names)

    return run


def _confirmed(words: int, width: int, percent: int, least: int):
    """Connect the classes of one neighbourhood block by comparing their full sets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        text = table.column("text").combine_chunks()
        data, offsets = utf8(text)
        sets, bounds = distinct_sets(*shingle_hashes(data, offsets, words))
        rows: dict[bytes, int] = {}
        for i, (name, own) in enumerate(
            zip(table.column("class").to_pylist(), _classes(sets, bounds), strict=True)
        ):
            if name == own:  # a repeated id may bring other texts along
                rows.setdefault(name, i)
        names, order = list(rows), list(rows.values())
        vocabulary, local = np.unique(sets, return_inverse=True)
        members = [local[bounds[i] : bounds[i + 1]] for i in order]
        sizes = np.array([len(m) for m in members], dtype=np.int64)
        sketch = _short(sketches(sets, bounds, width))[order]
        inside = np.zeros(len(vocabulary), dtype=bool)
        labels = np.arange(len(names))
        for x, count in _agreement(sketch, sketch):
            fit = (
                (count[:x] >= least)
                & (labels[:x] != labels[x])
                & (np.minimum(sizes[:x], sizes[x]) * 100 >= percent * np.maximum(sizes[:x], sizes[x]))
            )
            near = np.flatnonzero(fit)
            if not near.size:
                continue
            inside[members[x]] = True
            marks = inside[np.concatenate([members[y] for y in near])].astype(np.int64)
            inside[members[x]] = False
            both = np.add.reduceat(marks, np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            linked = near[100 * both >= percent * (sizes[near] + sizes[x] - both)]
            if linked.size:
                roots = np.unique(np.append(labels[linked], labels[x]))
                labels[np.isin(labels, roots)] = roots[0]
        return _stars(labels, names)

    return run


def _blocks(rows: DataFrame, group: list[str], size: DataFrame, count: str) -> DataFrame:
    """Give every row to the block pairs of its group: blocks 0 .. n - 1, each pair one unit.

    A group of one block stays whole; a larger one is cut by a hash of the class, so
    no task holds more than two blocks and every two rows of a group still meet.
    """
    own = F.pmod(F.xxhash64("class", F.lit(5)), F.col(count)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    return (
        rows.join(size, group)
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("first", F.least("own", "other"))
        .withColumn("second", F.greatest("own", "other"))
        .drop(count, "own", "other")
    )


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Component of every document: (doc_id, n_shingles, component_id, kept).

    ``docs`` needs doc_id and text; other columns are ignored. Documents are linked
    when their sets of lower-cased (A-Z) ``words``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more. A null, empty or white text has an
    empty set, links with nothing and is kept. Repeated rows, also under one id, are
    copies. A null id counts as larger than any other and a component without any
    id has component_id null and is kept. A text of any length is compared whole; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    width = bands * rows
    least = int(np.ceil((percent / 100 - SLACK) * width))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = scratch.write(
        source.mapInArrow(
            _sketch(words, bands, rows),
            "doc_id long, n long, bytes long, class binary, bands array<long>, sketch binary",
        ),
        "sketches",
    )
    classes = (
        table.where("class is not null")
        .groupBy("class")
        .agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id")).alias("best"))
        .select("class", F.col("best.doc_id").alias("doc_id"))
    )
    classes = scratch.write(classes, "classes")
    one = table.join(
        classes.select(F.col("doc_id").alias("rep"), F.col("class").alias("of")),
        F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("class") == F.col("of")),
        "left_semi",
    )
    placed = one.select("class", F.posexplode("bands").alias("band", "hash"))
    buckets = (
        placed.groupBy("band", "hash").count().where("count > 1")
        .select("band", "hash", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
    )
    met = scratch.write(_blocks(placed, ["band", "hash"], buckets, "blocks"), "met")
    sketch = table.select("class", "sketch").join(
        met.select("class").distinct(), "class", "left_semi"
    )
    sketch = sketch.groupBy("class").agg(F.first("sketch").alias("sketch"))
    edges = (
        met.join(sketch, "class")
        .groupBy("band", "hash", "first", "second")
        .applyInArrow(_plausible(least), _PAIR)
    )
    hoods = components(edges, scratch)
    member = hoods.select(F.col("node").alias("class"), "root").join(
        classes.select(F.col("class"), F.col("doc_id").alias("rep")), "class"
    )
    weight = (
        table.groupBy("class").agg(F.max("bytes").alias("bytes"))
        .join(member.select("class", "root"), "class")
        .groupBy("root")
        .agg(
            F.greatest(
                F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)
            ).alias("blocks")
        )
    )
    member = scratch.write(_blocks(member, ["root"], weight, "blocks"), "members")
    # merged at every size, so that small runs show the plan and the growth of large ones
    texts = source.join(
        member.select("rep", "class").distinct().hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("rep")),
    ).select("class", "text")
    links = (
        texts.join(member.drop("rep"), "class")
        .groupBy("root", "first", "second")
        .applyInArrow(_confirmed(words, width, percent, least), _PAIR)
    )
    found = components(links, scratch)
    least_id = (
        classes.join(found.select(F.col("node").alias("class"), "root"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    component = least_id.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = scratch.write(least_id.join(component, "root").select("class", "component_id"), "named")
    scratch.drop(classes, met, member, hoods, found)
    return (
        table.join(named, "class", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("class").isNull(), F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
        .withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.isnull("component_id"))
        )
    )
