import random
import struct

import numpy as np
import pytest
import sentencepiece

from lodestream.llm.sentencepiece import BLANK, MODEL_PATH, Codec, Model, _fields, decode_documents, encode_documents


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram_twin(data):
    """The same pieces as a unigram model; scores kept small, so the library's single precision holds them."""
    out = b""
    for number, value in _fields(data):
        if number == 1:
            body = b""
            for k, x in _fields(value):
                body += varint(2 << 3 | 5) + struct.pack("<f", max(struct.unpack("<f", x)[0], -40000.0) / 64) if k == 2 else field(k, x)
            out += field(1, body)
        elif number == 2:
            out += field(2, b"".join(field(k, x) for k, x in _fields(value) if k != 3 and isinstance(x, int)) + field(3, 1) + field(35, 1))
        else:
            out += field(number, value)
    return out


def texts():
    r = random.Random(7)
    pieces = [p for p, _, k in Model.parse(DATA).pieces if k == 1]
    out = ["", " ", "\n", "a", "  two  spaces ", "emoji 😀 and\ttabs\n\nlines", "日本語のテスト", "          ten", "x" * 5000, "\x00\x7f", "née Été"]
    out += ["".join(r.choice("aeinthrsdo .,XYZ_é😀\n") for _ in range(r.randint(1, 80))) for _ in range(1500)]
    out += ["".join(r.choice(pieces).replace(BLANK, " ") for _ in range(8)) for _ in range(1500)]
    return out


with open(MODEL_PATH, "rb") as f:
    DATA = f.read()


def test_a_model_of_merges_gives_the_librarys_ids():
    codec, library = Codec(Model.parse(DATA)), sentencepiece.SentencePieceProcessor(model_proto=DATA)
    for t, ids in zip(texts(), library.encode(texts(), num_threads=1)):
        assert codec.encode(t).tolist() == ids, t


def test_a_unigram_model_gives_the_librarys_ids():
    twin = unigram_twin(DATA)
    codec, library = Codec(Model.parse(twin)), sentencepiece.SentencePieceProcessor(model_proto=twin)
    assert not codec.model.merges
    for t, ids in zip(texts(), library.encode(texts(), num_threads=1)):
        assert codec.encode(t).tolist() == ids, t


def test_round_trip():
    codec = Codec(Model.parse(DATA))
    for t in texts():
        assert codec.decode(codec.encode(t)) == t
    assert codec.decode(codec.encode("a▁b")) == "a b"


def test_forgetting_changes_nothing(monkeypatch):
    import lodestream.llm.sentencepiece as module

    want = [Codec(Model.parse(DATA)).encode(t).tolist() for t in texts()[:200]]
    monkeypatch.setattr(module, "MEMORY", 5)
    codec = Codec(Model.parse(DATA))
    assert [codec.encode(t).tolist() for t in texts()[:200]] == want


def test_documents(spark):
    rows = [(1, "Hello there", 1), (2, None, 2), (3, "", 3), (None, "naïve 😀", 4), (1, "Hello there", 5), (4, "w " * 40_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = encode_documents(df).collect()
    codec = Codec(Model.parse(DATA))
    assert len(out) == 6 and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert sorted(map(str, (r.ids for r in out))) == sorted(str(codec.encode(t or "").tolist()) for _, t, _ in rows)
    back = decode_documents(encode_documents(df)).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)
    assert encode_documents(df.limit(0)).collect() == []


def test_a_model_that_rewrites_texts_is_refused():
    with pytest.raises(NotImplementedError):
        Model.parse(field(3, field(2, b"map")))
    assert np.array_equal(Codec(Model.parse(DATA)).encode("a"), Codec(Model.parse(DATA)).encode("a"))


def test_the_best_of_the_pieces_that_merges_leave():
    """At each position the score kept is the greatest of all pieces that end there and may follow what they go on from."""
    codec = Codec(Model.parse(open(MODEL_PATH, "rb").read()))
    for text in ("▁the", "▁unbelievable", "▁queleletre", "▁aaaaab", "▁Straßenbahn", "▁été"):
        best, by = [0.0] + [float("-inf")] * len(text), [-1] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(end):
                piece = text[start:end]
                if piece in codec.score_of and best[start] > float("-inf"):
                    score, i = codec.score_of[piece]
                    if codec.merge(piece) == (i,) and (by[start] < 0 or codec._stays(by[start], i)) and best[start] + score > best[end]:
                        best[end], by[end] = best[start] + score, i
        ids, n = [], len(text)
        while n > 0:
            assert by[n] >= 0
            ids.append(by[n])
            n -= len(codec.model.pieces[by[n]][0])
        assert codec.merged(text) == tuple(reversed(ids))


def test_what_does_not_come_back_is_found(monkeypatch):
    pieces = [("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -1.0, 1), ("b", -2.0, 1), ("▁a", -0.5, 1)]
    for most in (10_000, 1):
        monkeypatch.setattr("lodestream.llm.sentencepiece.MAX_DIFFER", most)
        codec = Codec(Model(pieces))
        assert [codec.encode_checked(t)[1] for t in ("a b", "a c", "a b", "", "c", "d a", "▁a")] == [True, False, True, True, False, False, True]
