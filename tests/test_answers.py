import pytest

from msgspark.operators import answers

HITS = [
    (1, 1, "a", "first text", "general", "https://x/2", 0.9),
    (1, 2, "b", "second text", "", "https://x/1", 0.1),
    (1, 3, "c", "third text", "general", "https://x/2", 0.05),
    (2, 1, "d", "low one", "general", "https://x/9", 0.2),
    (2, 2, "e", "low two", "general", "", 0.15),
    (2, 3, "f", "low three", "general", "https://x/9", 0.1),
    (2, 4, "g", "low four", "general", "https://x/4", 0.05),
    (4, 1, "h", "edge", "", "", 0.25),
]


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(
        HITS,
        "query_id bigint, rank int, id string, text string, channel_name string, permalink string, score double",
    ).repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "why?"), (2, "how?"), (3, "who?"), (4, "what?")], "query_id bigint, text string")


def test_gate(questions, hits):
    rows = {r.query_id: r for r in answers.answer_route(questions, hits).collect()}
    assert {q: r.status for q, r in rows.items()} == {
        1: "answerable", 2: "low_confidence", 3: "no_hits", 4: "answerable",
    }
    # sources keep rank order and duplicates; empty ones are skipped; only three hits count
    assert rows[2].message.endswith("confidence):\n- https://x/9\n- https://x/9")
    assert rows[1].message is None and rows[3].top_score is None


def test_context_keeps_weak_hits(hits):
    rows = {r.query_id: r.context for r in answers.context_blocks(hits).collect()}
    assert rows[1] == (
        "[1] (from #general) first text\n\n[2] second text\n\n[3] (from #general) third text"
    )


def test_citations_are_distinct_and_sorted(hits):
    rows = {r.query_id: r.citations for r in answers.citations(hits).collect()}
    assert rows[1] == "\n\nSources:\n- https://x/1\n- https://x/2"
    assert rows[4] == ""


def test_prompt(questions, hits):
    rows = {r.query_id: r for r in answers.prompt_table(questions, hits, place="team").collect()}
    assert sorted(rows) == [1, 4]
    assert "context from team messages." in rows[1].prompt
    assert rows[4].prompt.endswith("Question:\nwhat?\n\nContext:\n[1] edge")


def test_preview(questions, hits):
    rows = {r.query_id: r.preview for r in answers.preview_results(questions, hits).collect()}
    assert rows[3] == "No results found."
    assert rows[4] == "1. edge...\n   Similarity: 0.2500\n"
    assert rows[1].count("   Source: ") == 3


def test_scores(hits):
    rows = {r.query_id: r.scores for r in answers.score_listing(hits).collect()}
    assert rows[4] == "  [1] score=0.2500 - "
