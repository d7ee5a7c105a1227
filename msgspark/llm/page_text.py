"""HTML extraction: nearest-URL page differencing."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import Line, lines
from .scratch import Scratch

#: Two pages that share more of their text than this are versions of one page.
COPY_SHARE = 0.8
_URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", re.I)


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _URL.match(url or "")
    return (found[1].lower(), found[2]) if found else ("", url or "")


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``.

    The whole row of the table is one integer; a zero bit is a step by one.
    """
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(
        np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little"
    )[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` that a longest common subsequence with ``b`` uses.

    Halves ``a`` and finds where to cut ``b`` (linear memory), after common ends.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append(j)
        if i >= j or k >= m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                out.append(i)
            continue
        half = (i + j) // 2
        ahead = _lengths(a[i:half], b[k:m])
        back = _lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int(np.argmax(ahead + back))
        todo += [(i, half, k, cut), (half, j, cut, m)]
    return sorted(out)


def _open(line: Line) -> bool:
    """Whether differencing may delete the line: all but running text of the article proper."""
    return line.furniture or line.loose or not (line.main and line.prose)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, path and a short fingerprint and size of every line of a page."""
    for batch in batches:
        urls, htmls = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = [host_and_path(u) for u in urls]
        rows = []
        for html in htmls:
            own = lines(html)
            rows.append(
                np.array([zlib.crc32(x.text.encode("utf-8", "replace")) for x in own], dtype=np.uint32).tobytes()
                + np.array([len(x.text) for x in own], dtype=np.uint32).tobytes()
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([h for h, _ in found], pa.string()),
                pa.array([p for _, p in found], pa.string()),
                pa.array(rows, pa.binary()),
            ],
            names=["page_id", "tag", "host", "path", "lines"],
        )


def _nearness(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def shared_with(own: bytes, near: list[tuple[str, bytes]], path: str) -> list[int]:
    """Lines of a page shared with the nearer of its neighbours that is not a version of it."""
    codes, sizes = np.frombuffer(own, dtype=np.uint32).reshape(2, -1)
    for _, other in sorted(near, key=lambda x: -_nearness(path, x[0])):
        both = common_lines(codes.tolist(), np.frombuffer(other, dtype=np.uint32).reshape(2, -1)[0].tolist())
        if sizes[both].sum() <= COPY_SHARE * sizes.sum():
            return both
    return []


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_id, tag, host, path, own, *others = (c.to_pylist() for c in batch.columns)
        masks = []
        for i in range(batch.num_rows):
            near = [
                (others[k + 1][i], others[k + 2][i])
                for k in (0, 3)
                if others[k][i] is not None and others[k][i] == host[i]
            ]
            shared = shared_with(own[i], near, path[i])
            masks.append(np.array(shared, dtype=np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.binary())],
            names=["of", "as", "shared"],
        )


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page as its lines and marks, compressed, for the way to its shared lines."""
    for batch in batches:
        bodies = []
        for html in batch.column(3).to_pylist():
            rows = [f"{int(x.main)}{int(_open(x))}{int(x.furniture)}{x.text}" for x in lines(html)]
            bodies.append(zstandard.compress("\n".join(rows).encode("utf-8", "replace"), 3))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(bodies, pa.binary())], names=["page_id", "tag", "url", "body"]
        )


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for body, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            rows = zstandard.decompress(body).decode()
            rows = rows.split("\n") if rows else []
            gone = set(np.frombuffer(shared or b"", dtype=np.uint32).tolist())
            kept = [
                row for i, row in enumerate(rows) if row[2] == "0" and not (row[1] == "1" and i in gone)
            ]
            if any(row[0] == "1" for row in kept):  # the article's element is marked
                kept = [row for row in kept if row[0] == "1"]
            texts.append("\n".join(row[3:] for row in kept))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars).

    The pages of a host are ordered by URL path. Each is paired with the nearer of its
    two neighbours (the longer common path, then the one before), their text lines
    are aligned by a longest common subsequence, and shared lines are deleted. A
    neighbour that shares over ``COPY_SHARE`` of the text is a version of the same
    page and says nothing; then the other one is asked. Running text inside an element
    that the page itself marks as its article is not deleted for being shared; inside it,
    an aside or a part named like furniture (social, widget, notice, ...) goes where it is
    shared and stays where it is not. Lines in navigation, adverts, forms, comments and the
    like always go, and where an article element has lines left, only those stay.

    A null html gives an empty text; pages without a readable URL are neighbours of
    each other under an empty host. Repeated rows (same id, url and html) count as one
    page and get a row each. Other columns are ignored.

    The order is found by a range sort of short rows, so a host may hold any share of
    the pages; pages themselves move once, compressed.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.xxhash64("url", "html").alias("tag"),
        "url",
        "html",
    )
    order = ["host", "path", "page_id", "tag"]
    prints = own.mapInArrow(_prints, "page_id long, tag long, host string, path string, lines binary")
    ranked = scratch.write(
        prints.dropDuplicates(["page_id", "tag"])
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "pages",
    )
    part = F.shiftright("at", 33)
    counts = ranked.groupBy(part.alias("part")).count().orderBy("part").collect()  # one per partition
    offsets, total = [], 0
    for row in counts:
        offsets.append((row.part, total))
        total += row["count"]
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, start long"))
    placed = (
        ranked.withColumn("part", part).join(starts, "part")
        .withColumn("at", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("part", "start")
    )
    beside = [
        placed.select(
            (F.col("at") + step).alias("at"),
            *(F.col(c).alias(f"{c}{step}") for c in ("host", "path", "lines")),
        )
        for step in (1, -1)
    ]
    shared = scratch.write(
        placed.join(beside[0], "at", "left")
        .join(beside[1], "at", "left")
        .drop("at")
        .select("page_id", "tag", "host", "path", "lines", *(f"{c}{s}" for s in (1, -1) for c in ("host", "path", "lines")))
        .mapInArrow(_difference, "of long, as long, shared binary"),
        "shared",
    )
    scratch.drop(ranked)
    pressed = own.mapInArrow(_pressed, "page_id long, tag long, url string, body binary")
    return (
        pressed.join(
            shared, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("as")), "left"
        )
        .select("page_id", "url", "body", "shared")
        .mapInArrow(_assemble, "page_id long, url string, text string, n_chars long")
    )
