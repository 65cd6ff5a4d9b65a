"""What workers hold: the pipeline's stages share them, so that one stage's tables are in the next one's way."""

import gc
import tracemalloc

import pandas as pd
import pytest

llm = pytest.importorskip("readgraph.llm")
from readgraph.llm import bpe, near_dedup, quality  # noqa: E402

P = pytest.importorskip("public_tokenizers")
RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_workers_free_the_tables_of_another_operator(spark):
    def holding(frames):
        found = sum(type(x).__name__ == "BpeModel" for x in gc.get_objects())
        for frame in frames:
            yield pd.DataFrame({"n": [found] * len(frame)})

    df = spark.createDataFrame([(i, f"text {i} of some words and others") for i in range(640)], "doc_id bigint, text string").repartition(32)
    most = lambda: df.mapInPandas(holding, "n long").agg({"n": "max"}).head()[0]
    for other in (
        lambda: near_dedup.sketch(df, "doc_id", "text"),
        lambda: near_dedup.shingle_sets(df.selectExpr("cast(cast(doc_id AS string) AS binary) AS node", "text AS t")),
        lambda: quality.score(df, quality.ByteConvNet()),
    ):
        for _ in range(2):  # the tables of an earlier call of the operator itself go, too
            bpe.encode(df, RANKS, P.PATTERN).write.format("noop").mode("overwrite").save()
        assert most() == 1
        other().write.format("noop").mode("overwrite").save()
        assert most() == 0


def test_the_model_and_its_caches_are_small():
    tracemalloc.start()
    try:
        model = bpe.BpeModel(RANKS)
        assert tracemalloc.get_traced_memory()[0] < 60e6  # 45 MB; 80 MB with each token's borders as lists
    finally:
        tracemalloc.stop()
    ids = list(model.vocab)
    for k in range(bpe.CACHE_PAIRS + 10_000):
        model.may_follow(ids[k % 700], ids[k // 700])
    assert len(model._ok) <= bpe.CACHE_PAIRS <= 300_000


def test_a_word_of_one_match_is_held_once():
    words = bpe._coder(RANKS, P.PATTERN)
    text = "plain words, plain words and it's not"
    want = words.matches(text)
    words = bpe._coder(RANKS, P.PATTERN)
    assert words.text(text) == want == words.text(text)
    assert {"words", "and", "not"} <= set(words) and not {" and", " not"} & set(words.pieces)
