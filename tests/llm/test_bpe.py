import random

import pytest
from tokenizers import Tokenizer

from corpusloom.llm.bpe import DEFAULT_VOCABULARY, Decoder, Encoder, decode
from corpusloom.llm.encoding import count_tokens, decode_ids, encode_ids


@pytest.fixture(scope="module")
def ours():
    return Encoder(DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "\n\n  x", "<|endoftext|>", "don't 'll", "éßж漢🙂" * 40, "\x00\x7f​ ", "1234567890" * 30, "a" * 3000, "ab" * 2000, "-=" * 2000, " " * 700, "x\n" * 50]


@pytest.mark.parametrize("text", ODD)
def test_as_the_public_library(ours, public, text):
    ids = ours.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert decode(ours.merges, ids) == text


@pytest.mark.parametrize("letters", ["ab", "theringsaout", "-=_*", "abcdeéßжя漢🙂 -=_0\n'", "0123456789", "ABCxyz "])
def test_random_texts(ours, public, letters):
    rng = random.Random(letters)
    for n in (1, 7, 40, 300, 4000):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert ours.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_window_stays_small(ours):
    rng = random.Random(1)
    ours._transducer.window = 0
    for n in (2_000, 20_000, 200_000):
        ours.encode("".join(rng.choice("etaoinsrhld") for _ in range(n)))
        assert ours._transducer.window <= 6 * ours.merges.longest


def test_decoder_holds_back_unfinished_characters(ours):
    ids = ours.encode("漢🙂")
    machine, out = Decoder(ours.merges), []
    for i in ids:
        out.append(machine.push(i))
        assert "�" not in out[-1]
    assert "".join(out) + machine.finish() == "漢🙂"


def test_spark(spark, ours):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "Hello world", "x"), (5, "word " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_ids(df).collect()), key=repr)
    assert got == sorted(((k, ours.encode(t)) for k, t, _ in rows), key=repr)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()) == sorted((k or 0, len(ours.encode(t))) for k, t, _ in rows)
    back = decode_ids(encode_ids(df)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((k or 0, t or "") for k, t, _ in rows)
    assert encode_ids(df.limit(0)).count() == 0
