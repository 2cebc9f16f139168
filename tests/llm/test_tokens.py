import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import tokens

PATH = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}"


def whole(text):
    return tokens._load(PATH)[0].encode_ordinary(text) if text else []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abqxzsld'Z790.,!  \n\t\r é　ß中😀_-")), max_size=60))
def test_fragments_give_the_ids_of_the_whole(text):
    assert list(next(tokens.encode_texts(pd.Series([text]), PATH, {}))) == whole(text)


def test_certain_pairs_occur_in_no_token():
    encoder, certain = tokens._load(PATH)
    for token in encoder.token_byte_values():
        assert not any(certain[a, b] for a, b in zip(token, token[1:]))


@pytest.mark.parametrize("text", ["<|endoftext|> x", "x" * 50_000, "word " * 20_000, "a\n\n  b \t c", "'s it's 't"])
def test_round_trip(text):
    ids = list(next(tokens.encode_texts(pd.Series([text]), PATH, {})))
    assert ids == whole(text) and tokens._load(PATH)[0].decode(ids) == text


def test_null_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hi there", 5), (3, "hi there", 5)], "doc_id long, text string, ids int")
    out = df.select("doc_id", tokens.token_ids(F.col("text")).alias("t"), tokens.token_count("text").alias("n")).collect()
    assert [(r["t"], r["n"]) for r in out[:2]] == [([], 0), ([], 0)]
    assert out[2]["t"] == whole("hi there") == out[3]["t"] and out[2]["n"] == len(out[2]["t"])
    assert df.limit(0).select(tokens.token_ids("text")).count() == 0
