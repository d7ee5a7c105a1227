"""Vector columns: cosine over dense arrays and hashed term vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 1536
WORD_SPLIT = r"[^\p{L}\p{N}]+"
CJK = r"[぀-ヿ㐀-\u9fff]"
CJK_SPLIT = rf"{WORD_SPLIT}|(?<={CJK})|(?={CJK})"
NOT_LATIN = r"[^\x00-\u024f\u2000-\u206f]"
SPARSE = "struct<buckets:array<int>,weights:array<double>>"
#: Words that are counted at a time (one text may have more).
WORDS = 1 << 18


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors, 0 when one of them has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def score(distance: Column) -> Column:
    """Similarity of a cosine distance; lies in [-1, 1]."""
    return 1 - distance


def _words(text: Column) -> Column:
    """Terms of a text as the split leaves them, with the empty ones around separators."""
    lower = F.lower(text)
    return F.when(text.rlike(CJK), F.split(lower, CJK_SPLIT, -1)).otherwise(
        F.split(lower, WORD_SPLIT, -1)
    )


def _is_latin(text: Column) -> Column:
    """Texts whose letters and digits Arrow's regular expressions tell as Java's do."""
    return (F.octet_length(text) == F.length(text)) | ~text.rlike(NOT_LATIN)


def terms(text: Column) -> Column:
    """Lower-case words and single CJK characters, in order."""
    return F.filter(_words(text), lambda w: w != "")


def term_bucket(term: Column, dim: int = DIM) -> Column:
    """Bucket of a term: the first 32 bits of its md5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def _own(words: pa.Array, dim: int) -> np.ndarray:
    """``term_bucket`` of words, -1 for the empty one."""
    known = words.cast(pa.binary()).to_pylist()
    firsts = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in known]), dtype=">u4")[::4]
    out = (firsts % dim).astype(np.int64)
    out[[not w for w in known]] = -1
    return out


def weighed(words: pa.ListArray, dim: int) -> pa.StructArray:
    """Sparse vectors of rows of words, a bounded number of words at a time."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    parts, first = [], 0
    while first < len(words):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + WORDS, "right")))
        parts.append(_weighed(words.slice(first, last - first), dim))
        first = last
    return pa.concat_arrays(parts) if parts else _weighed(words, dim)


def _weighed(words: pa.ListArray, dim: int) -> pa.StructArray:
    coded = words.flatten().dictionary_encode()
    own = _own(coded.dictionary, dim)[coded.indices.to_numpy()]
    rows = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    found, counts = np.unique((rows * dim + own)[own >= 0], return_counts=True)
    rows, own = np.divmod(found, dim)
    norms = np.sqrt(np.bincount(rows, counts * counts, len(words)))
    bounds = pa.array(np.searchsorted(rows, np.arange(len(words) + 1)).astype(np.int32))
    buckets = pa.ListArray.from_arrays(bounds, pa.array(own.astype(np.int32)))
    weights = pa.ListArray.from_arrays(bounds, pa.array(counts / norms[rows]))
    return pa.StructArray.from_arrays([buckets, weights], ["buckets", "weights"])


def term_vector(text: Column, dim: int = DIM) -> Column:
    """Hashed term frequencies of a text, L2-normalised, as a sparse struct.

    Arrow cuts a Latin text into its terms, Spark any other; a task counts those of its rows
    batch by batch and hashes the different words of a batch. No term of the corpus is shuffled.
    A null text has an empty vector.
    """

    def run(lower: pa.Array, words: pa.Array) -> pa.Array:
        cut = pc.split_pattern_regex(lower, pattern=WORD_SPLIT)
        whole = words.null_count == len(words)
        return weighed(cut if whole else pc.coalesce(cut, words.cast(cut.type)), dim)

    latin = _is_latin(text)
    return F.arrow_udf(run, SPARSE)(F.when(latin, F.lower(text)), F.when(~latin, _words(text)))
