import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from twinbook.llm.bpe import Bpe, default_vocabulary  # noqa: E402
from twinbook.llm.encoding import count_tokens, decode_ids, encode_texts  # noqa: E402


@pytest.fixture(scope="module")
def ours():
    return Bpe(default_vocabulary())


@pytest.fixture(scope="module")
def byte_by_byte():
    return Bpe(default_vocabulary(), long_piece=0)


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


FIXED = [
    "", " ", "\n\n \t", "it's they'll 'twas", "<|endoftext|> and more", "日本語のテキスト", "é é", "👩‍👩‍👧 emoji", "\r\n\r\n", "a" * 5_000, "ab" * 2_000, " " * 3_000, "=" * 2_000,
    "é" * 1_500, "thethe" * 700, "1234567890" * 300, "​" * 700, "-" * 900 + "_" * 900, "\x00\x7f", "x y",
]


@pytest.mark.parametrize("i", range(len(FIXED)))
def test_same_ids(ours, byte_by_byte, theirs, i):
    assert ours.encode(FIXED[i]) == byte_by_byte.encode(FIXED[i]) == theirs(FIXED[i])
    assert "".join(ours.decode(ours.encode(FIXED[i]))) == FIXED[i]


def test_every_piece_is_streamed(monkeypatch, theirs):
    coder, read, stream = Bpe(default_vocabulary()), [], Bpe.stream
    monkeypatch.setattr(Bpe, "stream", lambda self, data: read.append(bytes(data)) or stream(self, data))
    text = "the unforeseeable Vetokestad the unforeseeable " + "ab" * 200
    assert coder.encode(text) == theirs(text) and b"".join(sorted(read)) == b"".join(sorted({x.encode() for x in coder.split(text)}))


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_any_text(ours, theirs, text):
    assert ours.encode(text) == theirs(text)
    assert "".join(ours.decode(ours.encode(text))) == text


def test_long_words_in_constant_memory(ours, theirs):
    rnd = random.Random(4)
    for alphabet in ("abcdeinorst", "aeiou", "xyz", "etaoin shrdlu".replace(" ", "")):
        word = "".join(rnd.choice(alphabet) for _ in range(6_000))
        assert ours.encode(word) == theirs(word)
    held = []

    def feed():
        for b in b"etaoinshrdlu" * 5_000:
            yield b

    for _ in ours.stream(feed()):
        held.append(1)
    assert len(held) > 1_000


def test_table(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (4, " "), (1, "a b")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (4, [220])]
    back = sorted((r.doc_id, r.text) for r in decode_ids(encode_texts(df)).collect())
    assert back == [(1, "a b"), (1, "a b"), (2, ""), (3, ""), (4, " ")]
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 1)]
    assert encode_texts(df.limit(0)).count() == 0 and encode_texts(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
