import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from notewright.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Codec.of(PATH, P.PATTERN).ranks, special_tokens={})


def test_codec_matches(known):
    rng = random.Random(1)
    texts = ["", " ", "a", "  two  spaces\n\n", "don't we'll 'S", "é漢字🎵", "x" * 3000, "ab" * 700, "\x00\x01 nul", "<|endoftext|>"]
    texts += ["".join(rng.choice("abcdefghij éü\n123!?") for _ in range(rng.randint(0, 400))) for _ in range(100)]
    codec = bpe.Codec.of(PATH, P.PATTERN)
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [known.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_bounds_do_not_show(known, monkeypatch):
    text = " ".join(f"word{i} and{i % 7}" for i in range(4000))
    for name, value in (("REMEMBERED", 5000), ("WORDS_AT_ONCE", 40), ("IDS_AT_ONCE", 100), ("SHORT_BYTES", 4), ("LONG_AT_ONCE", 60), ("TEXT_AT_ONCE", 90)):
        monkeypatch.setattr(bpe, name, value)
    codec = bpe.Codec(PATH, P.PATTERN)
    ids = codec.encode([text, "", text[:50]])
    assert np.frombuffer(ids[0], "<u4").tolist() == known.encode_ordinary(text)
    assert codec.decode(ids) == [text.encode(), b"", text[:50].encode()]


def test_long_words(known):
    """Words of any length contract by the recursion, as the library's do."""
    rng = random.Random(2)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(65, 700))) for letters in ("ab", "eta", "etaoinshrdlu", "é漢字xyz") for _ in range(15)]
    words += ["z" * 5001, "ab" * 3000, "".join(rng.choice("etaoinsr") for _ in range(4000))]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1025, 6000))) for letters in ("a", "ab", "eta", "the", "etaoinshrdlu", "é漢字xyz", "abcdefghijklmnopqrstuvwxyz") for _ in range(6)]
    codec = bpe.Codec.of(PATH, P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(words)] == [known.encode_ordinary(w) for w in words]


def test_words_of_millions_of_letters(known):
    """Equal to the library, in a worker's bounded memory."""
    rng = random.Random(3)
    common = "".join(rng.choices("etaoinshrdlucmfw", weights=range(16, 0, -1), k=1_000_000))
    words = [common, "a" * 1_000_000, "ab" * 500_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5_000_000))]
    codec = bpe.Codec.of(PATH, P.PATTERN)
    for word in words:
        want = known.encode_ordinary(word)
        assert np.frombuffer(codec.encode([word])[0], "<u4").tolist() == want
        codec.words.clear()


def test_operator(make, edge, known):
    out = bpe.encode_documents(make([*edge, edge[3]]), ranks_path=PATH, pattern=P.PATTERN, with_digests=True)
    texts = dict(edge)
    for r in out.collect():
        assert r.ids == known.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
    back = bpe.decode_documents(out, ranks_path=PATH, pattern=P.PATTERN)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == {d: t or "" for d, t in edge}
    assert bpe.encode_documents(make([]), ranks_path=PATH, pattern=P.PATTERN).count() == 0
