"""The tokenizer's rarer cases: long pieces, high ranks, texts of more than a run, the registered query."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from askframe.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks():
    with open(PATH, "rb") as f:
        return bpe.load_ranks(f)


def exact(given=None):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=given or ranks(), special_tokens={})


def coded(text, encoder):
    (ids, decoded), = bpe.encode_texts([text], regex.compile(public_tokenizers.PATTERN).findall, encoder, bpe.Cache())
    return np.frombuffer(ids, "<i4").tolist(), decoded


R = random.Random(4)
LONG = ["a" * 30_000, "ab" * 900 + "a" * 777, "".join(R.choice("abcdefgh") for _ in range(2000)), "=" * 5001, "é" * 1500, "x" + "　" * 900, "the" * 400 + "ther"]


@pytest.mark.parametrize("text", LONG)
@pytest.mark.parametrize("rounds, rows", [(64, 1_000_000), (3, 5000)])
def test_long_pieces(monkeypatch, text, rounds, rows):
    monkeypatch.setattr(bpe, "ROUNDS", rounds)
    monkeypatch.setattr(bpe, "LONG_ROWS", rows)
    encoder = bpe._encoder(PATH)
    assert coded(text[: 200 * rounds], encoder) == (exact().encode_ordinary(text[: 200 * rounds]), text[: 200 * rounds].encode())


def test_both_recursions_agree(monkeypatch):
    encoder = bpe._encoder(PATH)
    pieces = [bytes(R.choice(b"abnest ") for _ in range(R.randint(1, 60))) for _ in range(400)]
    found = []
    for long in (0, 10_000):
        monkeypatch.setattr(bpe, "LONG", long)
        found.append(sorted(x for run in encoder.encode(pieces) for x in zip(*run, strict=True)))
    assert found[0] == found[1]


def test_high_ranks():
    high = {t: r if len(t) == 1 else r + 100_000 for t, r in ranks().items()}
    text = "The tokens of this text rank above sixty-five thousand." * 3
    assert coded(text, bpe.Encoder(high)) == (exact(high).encode_ordinary(text), text.encode())
    with pytest.raises(ValueError):
        bpe.Encoder({**{bytes([i]): i for i in range(256)}, b"ab": 1 << 31})


def test_registered_query_on_odd_texts(spark, tmp_path):
    words = ["".join(R.choice("abcdeß ") for _ in range(R.randint(2, 9))) for _ in range(500)]
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "it's 12345\r\n"), (3, "it's 12345\r\n"), (None, "no id"), (4, " ".join(R.choice(words) for _ in range(900_000))), (5, "漢字 ½ \u0000 end")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    own = exact()
    want = []
    for i, t in texts:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in queries.op9_bpe(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
