"""The registered queries on the smallest tables."""

import pytest

import corpus_pipeline
from check import duck, rows
from webframe.llm.oracles import ORACLES
from webframe.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck(sf).execute(ORACLES[name]).df())


def test_names_and_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1)) and len(QUERIES) >= 10
    assert len(corpus_pipeline.STAGES) == 5


def test_extra_conversation(spark, sf):
    got = QUERIES["op4_chat_format"](spark, sf).where("conv_id = -7").first()
    assert (got.n_turns, got.loss_chars) == (2, len(r"\### Assistant: </turn> ok"))
