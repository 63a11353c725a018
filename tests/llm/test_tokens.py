import random
import time

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from weft.llm import tokens

PATH = tokens.default_model()


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


ODD = ["", None, " ", "  a", "▁a b▁▁", "\x00a\x7f", "日本語 テスト", "é ﬁ ½ Ⅳ", "﻿x", "a\tb\r\n", "<s> </s> <unk> <0x41>", "x" * 5000, "ab" * 3000, "=-" * 900, "\U0001f600" * 50, "   " * 400]


def test_as_the_library(library):
    rng = random.Random(1)
    alphabet = "abcdeth éßñ\n\t ▁0123(){}=+-*/\\中文\U0001f600"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    assert tokens.token_counts(texts, PATH).tolist() == [len(library.encode(t or "")) for t in texts]


def test_chunks_of_any_size(library, monkeypatch):
    for size in (1, 3, 7):
        monkeypatch.setattr(tokens, "CHUNK", size)
        assert tokens.token_counts(ODD, PATH).tolist() == [len(library.encode(t or "")) for t in ODD]


def test_forgetting(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_TRANSITIONS", 10)
    for t in ODD:
        assert tokens.token_counts([t], PATH)[0] == len(library.encode(t or ""))


def test_frame(spark, library):
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(ODD + ODD[:3])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, size_into="n_bytes").collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(ODD + ODD[:3])}
    assert tokens.count_tokens(df.limit(0)).collect() == []


def test_pieces_with_inner_spaces_are_refused():
    with pytest.raises(ValueError):
        tokens.Transducer({"a▁b": 0.0})


def test_counts_add_up(library):
    texts = ["one two three", "", "four"]
    assert np.array_equal(tokens.token_counts(texts, PATH), [tokens.token_counts([t], PATH)[0] for t in texts])


@pytest.mark.parametrize("char", "-=_*#.a é中\n")
def test_a_megabyte_of_one_character_takes_no_time(library, char):
    assert tokens.token_counts([char * 20_000], PATH)[0] == len(library.encode(char * 20_000))
    began = time.process_time()
    tokens.token_counts([char * (1 << 20)], PATH)
    assert time.process_time() - began < 2


def test_long_words_that_dont_settle(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["-" * rng.randint(1, 200), "=" * rng.randint(1, 99), "foo"]) for _ in range(300)) for _ in range(4)]
    texts += ["".join(rng.choice("-=_ab") for _ in range(20_000)), ("-" * 500 + "x") * 50 + " tail"]
    assert tokens.token_counts(texts, PATH).tolist() == [len(library.encode(t)) for t in texts]
