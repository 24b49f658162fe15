"""The codec against the sentencepiece library on the same model."""

import hashlib
import random
import struct

import pytest

from quarry.llm.sentencepiece_codec import MODEL, Codec, load, sentencepiece_encode

sentencepiece = pytest.importorskip("sentencepiece")
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "é", "漢", "字", "の", "日本", "ing", "er", "1", "23", "▁", "☃", "\x00", "😀", ".", "...", "==", "    ", "Привет", "ция", "<0x41>"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "a" * 5000, "日本語の文章" * 300, "=" * 300]


def test_bpe_equals_library(docs):
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec(load(open(MODEL, "rb").read()))
    texts = random_texts(1500) + [r.text or "" for r in docs.collect()]
    got = [x.tolist() for x in codec.encode(texts)]
    assert got == lib.encode(texts)
    assert [codec.decode(x) for x in got] == lib.decode(got)


def test_decode_any_ids():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec(load(open(MODEL, "rb").read()))
    rng = random.Random(5)
    ids = [[rng.randrange(259, 32000) for _ in range(rng.randrange(30))] for _ in range(300)]
    assert [codec.decode(x) for x in ids] == lib.decode(ids)


def test_unigram_equals_library(docs):
    """The same pieces as a unigram model: scores add up. Texts without pieces of score -1e9, where the library's floats round."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0) / 1000 - 0.001 * (len(p.piece) % 7)
    data = proto.SerializeToString()
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=data), Codec(load(data))
    texts = [w for r in docs.limit(200).collect() for w in (r.text or "").split()][:20_000]
    total = lambda ids: sum(proto.pieces[i].score for i in ids)
    same = 0
    for a, b in zip([x.tolist() for x in codec.encode(texts)], lib.encode(texts)):
        same += a == b
        assert a == b or abs(total(a) - total(b)) < 1e-3  # ties
    assert same > 0.95 * len(texts)


def test_operator(edge, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in sentencepiece_encode(edge, keep=("doc_id", "text")).collect():
        ids = lib.encode(r.text or "")
        assert (r.n_tokens, r.ids) == (len(ids), ids) and r.token_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}i", *ids)).hexdigest()
        assert r.round_trip == ("▁" not in (r.text or ""))
    assert sentencepiece_encode(none).count() == 0
