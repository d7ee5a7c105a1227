"""Approximate nearest neighbours: a forest of random-projection trees, one queue over all of them.

The trees are fitted on a bounded sample and every row is put into a leaf of each. A
query walks all trees through one priority queue and names the leaves to look into;
queries and rows meet by leaf, where exact inner products are taken.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.limits import top_n_per_key
from .scratch import Scratch

MOST = 20
TREES = 6
#: Rows that fit the trees and their budget, by number and by bytes.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
#: Rows of a leaf, as far as the sample goes: a leaf has at least LEAF_SAMPLE rows of it.
LEAF_ROWS = 128
LEAF_SAMPLE = 8
#: Share of the true neighbours that the search is meant to find, measured on the sample.
RECALL = 0.95
TRIALS = 200
#: Vectors of neighbouring leaves that meet the queries together, in bytes, and queries at once.
BUNDLE_BYTES = 8 << 20
QUERY_BLOCK = 8192
_AT_ONCE = 256
_SEED = 20240229


class Forest:
    """Trees over the unit sphere, with all inner nodes and all leaves numbered through.

    A row stands at its vector over the greatest norm of all rows, with one more
    coordinate that brings it to length 1; a query stands at its direction. The nearest
    places are then those of greatest inner product, whatever the norms are.
    ``left`` and ``right`` hold an inner node, or a leaf as its complement.
    """

    def __init__(self, sample: np.ndarray, total: int, norm: float, trees: int, bundle_rows: int):
        self.norm = norm
        places = self.place(np.unique(sample, axis=0))
        least = max(LEAF_SAMPLE, LEAF_ROWS * len(places) / max(total, 1))
        self.roots: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.share: list[float] = []  # of all rows, by leaf
        self.bundle: list[int] = []
        normals, cuts = [], []
        bundles = -1
        for k in range(trees):
            draw = np.random.default_rng((_SEED, k))
            self.roots.append(0)
            full = np.inf  # every tree begins a bundle
            todo = [(np.arange(len(places)), self.roots, k)]
            while todo:  # depth first, so that leaves of one branch follow each other
                rows, parent, at = todo.pop()
                found = self._split(places[rows], draw) if len(rows) > least else None
                if found is None:
                    if full >= bundle_rows:
                        bundles, full = bundles + 1, 0
                    full += len(rows) * total / len(places)
                    parent[at] = ~len(self.share)
                    self.share.append(len(rows) / len(places))
                    self.bundle.append(bundles)
                    continue
                normal, cut = found
                parent[at] = len(normals)
                normals.append(normal)
                cuts.append(cut)
                self.left.append(0)
                self.right.append(0)
                beyond = places[rows] @ normal > cut
                todo.append((rows[beyond], self.right, parent[at]))
                todo.append((rows[~beyond], self.left, parent[at]))
        self.normals = np.array(normals).reshape(len(normals), places.shape[1])
        self.cuts = np.array(cuts)
        self.budget = float(trees)  # of rows in visited leaves, as a share of all rows

    @staticmethod
    def _split(rows: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, float] | None:
        """A hyperplane across the line of two random rows, between the two rows in the middle; none if all are one."""
        half = len(rows) // 2
        for _ in range(4):
            a, b = rows[draw.choice(len(rows), 2, replace=False)]
            length = np.linalg.norm(a - b)
            if length > 0:
                along = rows @ ((a - b) / length)
                cut = float(np.partition(along, [half - 1, half])[half - 1 : half + 1].mean())
                beyond = int((along > cut).sum())
                if 0 < beyond < len(rows):
                    return (a - b) / length, cut
        return None

    def place(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1, keepdims=True)))
        return np.concatenate([scaled, rest], axis=1)

    @staticmethod
    def direction(vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)

    def leaves(self, places: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.empty((len(places), len(self.roots)), np.int32)
        left, right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        for k, root in enumerate(self.roots):
            at = np.full(len(places), root, np.int64)
            live = np.flatnonzero(at >= 0)
            while len(live):
                node = at[live]
                beyond = np.einsum("ij,ij->i", places[live], self.normals[node]) > self.cuts[node]
                at[live] = np.where(beyond, right[node], left[node])
                live = live[at[live] >= 0]
            out[:, k] = ~at
        return out

    def margins(self, directions: np.ndarray) -> np.ndarray:
        return directions @ self.normals.T - self.cuts

    def visit(self, margins: list[float], budget: float) -> Iterator[int]:
        """Leaves in the order of one queue over all trees, until they hold ``budget`` times all rows.

        What the queue goes by is the squared distance to the planes that a branch lies
        beyond, added up from the root; the near side of a plane costs nothing.
        """
        left, right, share = self.left, self.right, self.share
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        seen = 0.0
        while queue and seen < budget:
            cost, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                near, far = (right[node], left[node]) if margin > 0 else (left[node], right[node])
                heapq.heappush(queue, (cost + margin * margin, far))
                node = near
            seen += share[~node]
            yield ~node

    def fit_budget(self, sample: np.ndarray, total: int, most: int, recall: float) -> None:
        """The least budget that finds ``recall`` of the true neighbours of sample rows in the sample.

        Of the ``most`` nearest of all rows the sample holds its share, so that many of
        its nearest rows are asked for, one at least.
        """
        sample = np.unique(sample, axis=0)
        if len(sample) < 2 or not len(self.cuts):
            return
        near = min(max(1, round(most * len(sample) / total)), len(sample) - 1)
        tried = np.unique(np.linspace(0, len(sample) - 1, TRIALS).astype(int))
        inside = self.leaves(self.place(sample))
        margins = self.margins(self.direction(sample[tried]))
        needed = []
        for row, own in zip(tried.tolist(), margins, strict=True):
            before = np.zeros(len(self.share))
            seen = 0.0
            for leaf in self.visit(own.tolist(), np.inf):
                before[leaf] = seen
                seen += self.share[leaf]
            scores = sample @ sample[row]
            scores[row] = -np.inf
            best = np.argpartition(-scores, near - 1)[:near]
            needed.append(before[inside[best]].min(axis=1))
        self.budget = float(np.quantile(np.concatenate(needed), recall, method="higher")) + 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    return values.reshape(len(column), dim)


def _digests(matrix: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in matrix]


_PLACE = pa.struct([("bundle", pa.int32()), ("leaf", pa.int32())])


def _routed(forest: Forest, dim: int):
    """The leaf of every row in every tree, and the identity of its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = np.array(forest.bundle, np.int32)
        for batch in batches:
            matrix = _matrix(batch.column(1), dim)
            leaves = forest.leaves(forest.place(matrix)).reshape(-1)
            flat = pa.StructArray.from_arrays([pa.array(bundle[leaves]), pa.array(leaves)], fields=list(_PLACE))
            bounds = np.arange(0, len(leaves) + 1, len(forest.roots), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_digests(matrix), pa.binary()), pa.ListArray.from_arrays(bounds, flat)],
                names=["vec_id", "embedding", "digest", "places"],
            )

    return run


def _visits(forest: Forest, dim: int):
    """The leaves that every query looks into, bundle by bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(first, _AT_ONCE)
                matrix = _matrix(part.column(1), dim)
                digests = pa.array(_digests(matrix), pa.binary())
                rows, bundles, leaves = [], [], []
                for i, own in enumerate(forest.margins(forest.direction(matrix))):
                    found = defaultdict(list)
                    for leaf in forest.visit(own.tolist(), forest.budget):
                        found[forest.bundle[leaf]].append(leaf)
                    rows += [i] * len(found)
                    bundles += found.keys()
                    leaves += found.values()
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at), part.column(1).take(at), digests.take(at),
                        pa.array(bundles, pa.int32()), pa.array(leaves, pa.list_(pa.int32())),
                    ],
                    names=["query_id", "embedding", "digest", "bundle", "leaves"],
                )

    return run


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added up in the order of the coordinates."""
    out = np.zeros(len(left))
    for k in range(left.shape[1]):
        out += left[:, k] * right[:, k]
    return out


_HIT_FIELDS = [
    ("query_id", pa.int64()), ("digest", pa.binary()), ("ids", pa.list_(pa.int64())), ("score", pa.float64()),
]
_HITS = "query_id long, digest binary, ids array<long>, score double"


def _met(dim: int, most: int):
    """The best rows of one block for every query that looks into their leaves."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.schema(_HIT_FIELDS).empty_table()
        column = {c: rows.column(c).combine_chunks() for c in ("ids", "embedding", "leaf")}
        asked = {c: queries.column(c).combine_chunks() for c in ("query_id", "digest", "embedding", "leaves")}
        corpus, matrix = _matrix(column["embedding"], dim), _matrix(asked["embedding"], dim)
        names, leaf = np.unique(column["leaf"].to_numpy(), return_inverse=True)
        least = np.array([own[0].as_py() for own in column["ids"]], np.int64)
        wanted = np.zeros((len(matrix), len(names) + 1), bool)
        flat = asked["leaves"].flatten().to_numpy()
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        owner = np.repeat(np.arange(len(matrix)), asked["leaves"].value_lengths().to_numpy())
        wanted[owner, np.where(names[at] == flat, at, len(names))] = True
        who, what, how = [], [], []
        for first in range(0, len(matrix), _AT_ONCE):
            part = matrix[first : first + _AT_ONCE]
            scores = part @ corpus.T
            scores[~wanted[first : first + _AT_ONCE][:, leaf]] = -np.inf
            floor = np.full(len(part), -np.inf)
            if len(corpus) > most:
                floor = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
                floor = floor - 1e-9 * np.abs(floor)  # a matrix product may round otherwise
            q, r = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            exact = _products(part[q], corpus[r])
            order = np.lexsort((least[r], -exact, q))
            q, r, exact = q[order], r[order], exact[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            keep = nth < most
            who.append(q[keep] + first)
            what.append(r[keep])
            how.append(exact[keep])
        who, what = np.concatenate(who), np.concatenate(what)
        return pa.table({
            "query_id": asked["query_id"].take(pa.array(who)),
            "digest": asked["digest"].take(pa.array(who)),
            "ids": column["ids"].take(pa.array(what)),
            "score": pa.array(np.concatenate(how)),
        })

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part: an id, and a vector that is finite and not zero."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & finite
        & F.exists("embedding", lambda x: x != 0)
    )


_OUT = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    most: int = MOST,
    trees: int = TREES,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    bundle_bytes: int = BUNDLE_BYTES,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The rows of greatest inner product found for every query: (query_id, rank, vec_id, score).

    ``vectors`` and ``queries`` have vec_id and embedding; a query does not meet rows of its
    own id. Rows with a null id, a null or zero vector or one with a null or non-finite
    component take no part, nor do those of another length than most rows have (the
    longer, if as many). Scores are sums in double precision over the original vectors in the
    order of their coordinates; equal ones rank by vec_id. Rows that repeat id and vector
    count once, other rows of a repeated id count each, also as queries. A query gets
    fewer rows than ``most`` only where its leaves hold fewer. Empty tables give no rows;
    other columns are ignored.

    At most ``sample_rows`` rows (and SAMPLE_BYTES) fit the trees and the budget of the
    search; every row is indexed. Rows of one vector are one entry with its ``most`` + 1
    smallest ids, which is all that any query can return of them, so a vector that
    a third of the rows have is one row of a leaf. Rows and queries meet in blocks of
    bounded size: bundles of neighbouring leaves, cut further where a leaf is larger.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, asked = usable(vectors), usable(queries)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = (
        rows.groupBy(F.size("embedding").alias("dim"))
        .agg(F.count("*").alias("n"), F.max(squares).alias("norm"))
        .orderBy(F.col("n").desc(), F.col("dim").desc())
        .first()
    )
    if sizes is None:
        return spark.createDataFrame([], _OUT)
    dim, total = sizes.dim, sizes.n
    rows, asked = (frame.where(F.size("embedding") == dim) for frame in (rows, asked))
    bound = max(2, min(sample_rows, SAMPLE_BYTES // (8 * dim)))
    share = -(-(bound << 20) // total)  # in parts of 2 ** 20
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("embedding").toArrow()
    sample = _matrix(sample.column(0).combine_chunks(), dim)
    if not len(sample):  # so few rows that none was drawn
        sample = _matrix(rows.select("embedding").limit(bound).toArrow().column(0).combine_chunks(), dim)
    forest = Forest(sample, total, float(np.sqrt(sizes.norm)), trees, max(1, bundle_bytes // (8 * dim)))
    forest.fit_budget(sample, total, most, recall)

    kind = vectors.schema["embedding"].dataType.simpleString()
    routed = rows.mapInArrow(
        _routed(forest, dim),
        f"vec_id long, embedding {kind}, digest binary, places array<struct<bundle:int,leaf:int>>",
    )
    of_vector = Window.partitionBy("digest").orderBy("vec_id")
    entries = scratch.write(
        routed.withColumn("nth", F.dense_rank().over(of_vector))
        .where(F.col("nth") <= most + 1)
        .groupBy("digest")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first(F.struct("embedding", "places")).alias("v"))
        .select("digest", "ids", "v.embedding", "v.places"),
        "entries",
    )
    asked_kind = queries.schema["embedding"].dataType.simpleString()
    visits = scratch.write(
        asked.mapInArrow(
            _visits(forest, dim),
            f"query_id long, embedding {asked_kind}, digest binary, bundle int, leaves array<int>",
        ),
        "visits",
    )
    # one row for each bundle, of which the forest has no more than leaves
    held = entries.select(F.explode("places.bundle").alias("bundle")).groupBy("bundle").agg(
        F.ceil(F.count("*") / (2 * max(1, bundle_bytes // (8 * dim)))).cast("int").alias("row_blocks")
    )
    looked = visits.groupBy("bundle").agg(F.ceil(F.count("*") / query_block).cast("int").alias("query_blocks"))
    units = F.broadcast(held.join(looked, "bundle"))
    block = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        entries.select("digest", "ids", "embedding", F.explode("places").alias("place"))
        .select("digest", "ids", "embedding", "place.bundle", "place.leaf")
        .join(units, "bundle")
        .withColumn("row_block", block("row_blocks"))
        .withColumn("query_block", every("query_blocks"))
        .select("ids", "embedding", "leaf", "bundle", "row_block", "query_block")
    )
    salt = F.pmod(F.xxhash64("query_id", "digest"), F.col("query_blocks")).cast("int")
    right = (
        visits.join(units, "bundle")
        .withColumn("query_block", salt)
        .withColumn("row_block", every("row_blocks"))
        .select("query_id", "digest", "embedding", "leaves", "bundle", "row_block", "query_block")
    )
    unit = ["bundle", "row_block", "query_block"]
    hits = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(_met(dim, most + 1), _HITS)
    single = hits.distinct().select("query_id", "digest", "score", F.explode("ids").alias("vec_id"))
    best = top_n_per_key(
        single.where("vec_id <> query_id"),
        ["query_id", "digest"],
        [F.col("score").desc(), F.col("vec_id").asc()],
        most,
        "vec_id",
    )
    return best.select("query_id", "rank", "vec_id", "score")
