"""Operators that keep all columns, on columns with dots, clashing names and unusual kinds; long runs of inline tags."""

import time

import public_tokenizers
import pytest

from helixframe.llm import exact_dedup, ngram_join, quality_rules, secrets
from helixframe.llm.html_tree import parse

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars string, `a.b` int, `a b` int, row_key string, digest string, key string, row string, c1 int"


@pytest.fixture(scope="module")
def docs(spark):
    say = "The committee met on Tuesday and it was agreed that the work of the year would be shown to all who had taken part in it, and that "
    rows = [(1, say * 9, "en"), (2, say * 9, "en"), (2, say * 9, "en"), (3, None, None), (None, say * 9 + "more", "xx"), (4, "password = hunter2hunter2 " + say * 4, "en"), (5, "zq " * 60, "en"), (1, say * 9, "en")]
    return spark.createDataFrame([(i, t, lang, "s", "many", 1, 2, "k", "d", "y", "r", 3) for i, t, lang in rows], SCHEMA)


def test_all_columns_are_kept(spark, docs):
    for f in (quality_rules.keep, exact_dedup.deduplicate, ngram_join.keep_one, lambda d: secrets.redact(d, RANKS, PATTERN), lambda d: secrets.redact(d, RANKS, PATTERN, length_col="n_chars")):
        got = f(docs)
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        assert all(tuple(r)[3:] == ("s", "many", 1, 2, "k", "d", "y", "r", 3) for r in got.collect())
        assert f(docs.limit(0)).count() == 0


def test_one_of_equal_rows_stays(docs):
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=repr)
    assert ids(exact_dedup.deduplicate(docs)) == [1, 3, 4, 5, None]
    assert ids(ngram_join.keep_one(docs)) == [1, 3, 5]  # row 4 and the one without an id say what row 1 does, and two or three shingles more


def test_lengths_follow_redacted_texts(spark):
    for kind, old, new in (("long", 33, 22), ("double", 33.0, 22.0), ("int", 33, 22)):
        df = spark.createDataFrame([(1, "password = hunter2hunter2 is what", old), (2, None, old)], f"doc_id long, text string, `n.chars` {kind}")
        got = {r["doc_id"]: r["n.chars"] for r in secrets.redact(df, RANKS, PATTERN, length_col="n.chars").collect()}
        text = secrets.redact(df, RANKS, PATTERN).where("doc_id = 1").first()
        assert text["n.chars"] == old and got == {1: len(text["text"]), 2: old}


def test_runs_of_inline_tags_cost_their_length():
    for page in ("<b>x" * 250_000, "<b>" * 150_000 + "</i>" * 150_000, "<b>" * 150_000 + "</b>" * 150_000, "<i><a>x</i>" * 90_000):
        began = time.time()
        parse(page)
        assert time.time() - began < 4


def test_tables_of_threads_are_apart(spark):
    """A run deletes its own tables only, not those that another thread of the driver has in use."""
    import threading

    from helixframe.llm import common

    begun, dropped = threading.Event(), threading.Event()
    seen = {}

    def other():
        seen["table"] = common.save(spark.range(3), "other")
        begun.set()
        dropped.wait(60)
        seen["rows"] = seen["table"].count()

    before = common.written()
    thread = threading.Thread(target=other)
    thread.start()
    assert begun.wait(60)
    kept = common.save(spark.range(2), "mine")
    common.save(spark.range(2), "mine")
    common.drop_others(spark, before, kept)
    dropped.set()
    thread.join()
    assert seen["rows"] == 3 and common.written() == before + 1 and kept.count() == 2
