import itertools
import random

import pytest
from frames import ODD, docs
from pyspark.sql import functions as F

from msgspark.llm import pieces
from msgspark.llm.lattices import Lexicon, Segments
from msgspark.llm.pieces import decode, encode, n_best
from msgspark.llm.queries import VOCABULARY_PATH
from msgspark.llm.token_counts import count_pieces, token_counts
from msgspark.llm.vocabulary import Vocabulary, marked

ROWS = ODD + [
    (20, "Hello world, this is  a   test\twith\nlines"), (21, " leading and trailing "), (22, "日本語 and ğ 🎉"),
    (23, "x" * 3000), (24, "the quick brown fox " * 400), (24, "the quick brown fox " * 400), (25, "▁"),
]


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The vocabulary as a unigram model of the tokenizer library.

    The pieces of score -1e9 get one that 32-bit sums can hold, as the library adds
    in 32 bits and this package in 64.
    """
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(VOCABULARY_PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -32_000)
    path = str(tmp_path_factory.mktemp("model") / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=path), Vocabulary.load(path)


def apply(ids, edits):
    out = list(ids)
    for e in reversed(edits):
        out[e["at"] : e["at"] + e["size"]] = e["ids"]
    return out


def test_same_pieces_as_the_library(spark, library, sf_dir):
    model, vocabulary = library
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("text"))
    texts = [r.text[:300] for r in lines.limit(300).collect()] + [t for _, t in ROWS if t and len(t) < 200 and "▁" not in t]
    frame = docs(spark, list(enumerate(texts)))
    counts = {r.doc_id: r for r in token_counts(frame, vocabulary).collect()}
    made = {r.doc_id: r for r in encode(frame, vocabulary).collect()}
    for i, t in enumerate(texts):
        want = model.encode(t)
        assert made[i].ids == want, t
        assert counts[i].n_tokens == len(want)
        assert counts[i].score == pytest.approx(made[i].score)


def test_whole_texts_have_the_pieces_of_the_library(spark, library, sf_dir):
    model, vocabulary = library
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null")
    counts = {r.doc_id: r.n_tokens for r in token_counts(whole, vocabulary).collect()}
    for r in encode(whole, vocabulary, most=1).collect():
        want = model.encode(r.text)
        assert r.ids == want and counts[r.doc_id] == len(want), r.doc_id


def test_next_best_scores_are_those_of_the_library(library):
    model, vocabulary = library
    for text in ("hello world", "Déjà vu 123", "the rapid", "a", "internationalisation of things"):
        ids, _, total, others = pieces.encode_texts(Lexicon(vocabulary, True), [text], 4)
        mine = [ids.tolist(), *(apply(ids, a["edits"]) for a in others[0])]
        score = lambda ids: sum(vocabulary.scores[i] for i in ids)
        theirs = model.nbest_encode_as_ids(text, 4)
        assert [score(x) for x in mine] == [score(x) for x in theirs]
        assert len(set(map(tuple, mine))) == len(mine)
        assert [total[0], *(a["score"] for a in others[0])] == [score(x) for x in mine]


def test_search_finds_the_best_of_all_segmentations():
    names = ["a", "b", "ab", "ba", "aba", "bb"]
    draw = random.Random(2)
    scores = tuple(-float(draw.randrange(1, 6)) for _ in names)
    vocabulary = Vocabulary(tuple(names), scores, frozenset(range(len(names))), tuple(range(256)))
    for text in map("".join, itertools.product("abc", repeat=5)):
        found = []

        def walk(at, total, ids):
            if at == len(text):
                found.append((total, ids))
                return
            if text[at] not in names:
                walk(at + 1, total + vocabulary.unknown, [*ids, ord(text[at])])
            for i, p in enumerate(names):
                if text.startswith(p, at):
                    walk(at + len(p), total + scores[i], [*ids, i])

        walk(0, 0.0, [])
        got = n_best(vocabulary, text, 4)
        ranked = sorted((s for s, _ in found), reverse=True)
        assert [s for s, _ in got] == ranked[:4]
        whole = Segments(vocabulary, [text])
        assert whole.score[0] == ranked[0]
        assert whole.loss[0] == (ranked[0] - ranked[1] if len(ranked) > 1 else float("inf"))
        assert count_pieces(vocabulary, text)[0] == len(whole.flat)
        assert all((s, ids) in found for s, ids in got)


def test_round_trip_and_odd_rows(spark):
    vocabulary = Vocabulary.load(VOCABULARY_PATH)
    got = decode(encode(docs(spark, ROWS), vocabulary), vocabulary).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.decoded == (" " if r.text == "▁" else r.text or "")
        assert r.score <= 0 and (bool(r.ids) == bool(r.text))
    checked = encode(docs(spark, ROWS), vocabulary, most=1, keep=["doc_id"], verify=True)
    assert checked.columns == ["doc_id", "ids", "score", "alternatives", "round_trip"]
    assert sum(not r.round_trip for r in checked.collect()) == 1  # the mark itself reads as a space
    counts = token_counts(docs(spark, ROWS), vocabulary).collect()
    sizes = sorted((repr(r.doc_id), len(r.ids)) for r in got)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in counts) == sizes


def test_empty_table(spark):
    vocabulary = Vocabulary.load(VOCABULARY_PATH)
    assert token_counts(docs(spark, []), vocabulary).collect() == []
    assert encode(docs(spark, []), vocabulary).collect() == []


def test_pieces_that_cross_words_leave_the_text_whole():
    vocabulary = Vocabulary(("▁a▁b", "▁a", "▁b"), (-1.0, -1.0, -1.0), frozenset({0, 1, 2}), tuple(range(256)))
    assert vocabulary.parts(marked("a b")) == ["▁a▁b"]
    assert n_best(vocabulary, "▁a▁b", 2) == [(-1.0, [0]), (-2.0, [1, 2])]
