
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .helpers import documents, empty
from kolot.llm import packing, pieces

TEXTS = ["Hello  world ▁ and 🎉", " lead", "trail \n", "ünïcödé \x00 \t x", "a" * 300, "   "]


def test_packing_loses_nothing(spark, tmp_path):
    docs = documents(spark, [*TEXTS, *(f"document {i} " * (i % 17 + 1) for i in range(60))])
    path = P.path("byte_bpe_50k.tiktoken")
    packed = packing.pack_documents(docs, path, P.PATTERN, length=64, window_tokens=3000)
    encode = packing.encoder(open(path, "rb").read(), P.PATTERN).encode_ordinary
    want = sorted((str(r["doc_id"]), tuple(encode(r["text"]))) for r in docs.collect() if r["text"])
    parts, full = {}, 0
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], np.uint16)
        assert len(ids) == r["n_tokens"] == r["cu_seqlens"][-1] <= 64
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        full += len(ids)
        for d, at, a, b in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault((str(d), at), []).append(tuple(ids[a:b].tolist()))
    got = {}
    for (d, at), pieces_ in sorted(parts.items()):
        for k, p in enumerate(pieces_):
            got.setdefault((d, k), []).extend(p)
    assert sorted((d, tuple(ids)) for (d, _), ids in got.items()) == want
    assert full / (64 * packed.count()) > 0.9
    assert packing.pack_documents(empty(spark), path, P.PATTERN).count() == 0


def test_matrices(spark, tmp_path):
    """Rows of one length, padded, and what is read back from them is what was packed."""
    docs = documents(spark, [*TEXTS, *(f"document {i} " * (i % 17 + 1) for i in range(60))])
    packed = packing.pack_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, length=64, window_tokens=3000)
    matrices = packing.write_matrices(packed, str(tmp_path / "m"), length=64, pad_id=7, rows_per_matrix=10)
    for m in matrices.collect():
        ids = np.frombuffer(m["ids"], "<u2").reshape(m["rows"], 64)
        assert m["rows"] <= 10 and (m["length"], m["width"]) == (64, 2)
        for row, n in zip(ids, m["n_tokens"], strict=True):
            assert (row[n:] == 7).all()
    assert sorted(map(str, packing.rows_of(matrices).select(packed.columns).collect())) == sorted(map(str, packed.collect()))
    none = packing.write_matrices(packed.limit(0), str(tmp_path / "none"))
    assert none.count() == 0 and packing.rows_of(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_is_exact(lengths):
    """The tree finds what a search through all open rows finds."""
    free, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [f for f in free if f >= lengths[i]]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - lengths[i])
        else:
            free.append(30 - lengths[i])
        want.append(i)
    rows = packing.best_fit_decreasing(lengths, 30)
    assert sorted(i for r in rows for i in r) == sorted(want)
    assert sorted(30 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark):
    docs = documents(spark, TEXTS)
    rows = pieces.encode_documents(docs, P.path("piece_bpe_32k.model")).withColumn("text", pieces.decode_ids(F.col("ids"), P.path("piece_bpe_32k.model"), spark)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sp = library()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["round_trip"] and r["n_ids"] == len(r["ids"])
        assert r["text"] == texts[r["doc_id"]].replace("▁", " ")
    assert pieces.encode_documents(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    codec = pieces.codec(open(P.path("piece_bpe_32k.model"), "rb").read())
    [ids] = codec.encode([text])
    assert ids == library().encode(text)
    assert codec.decode(ids) == text.replace("▁", " ")


def test_unigram_model():
    """A unigram protobuf made by hand: the best path by scores, and bytes for what no piece holds."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, True
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", -20, 6) for b in range(256)), ("▁", -2, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3.5, 1), ("▁ab", -4, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    data = proto.SerializeToString()
    from sentencepiece import SentencePieceProcessor

    sp, codec = SentencePieceProcessor(model_proto=data), pieces.Codec(data)
    for text in ("ab ab", "abab b", "bé", "a  b"):
        assert codec.encode([text])[0] == sp.encode(text)
        assert codec.decode(sp.encode(text)) == text


def made(model_type=1, prefix=True, squeeze=False, fallback=True, **spec):
    """A small protobuf made by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = model_type, fallback
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    proto.trainer_spec.treat_whitespace_as_suffix = spec.get("suffix", False)
    proto.normalizer_spec.escape_whitespaces = spec.get("escape", True)
    if spec.get("rule"):
        from sentencepiece import SentencePieceNormalizer

        like = pb.ModelProto()
        like.ParseFromString(SentencePieceNormalizer(rule_name=spec["rule"]).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = like.normalizer_spec.precompiled_charsmap
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", -20, 6) for b in range(256 * fallback)), ("▁", -2, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3.5, 1), ("▁ab", -4, 1)]
    for piece, score, kind in [*rows, *[("<x>", 0, 4)] * spec.get("symbols", 0)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    return proto.SerializeToString()


KINDS = [dict(prefix=p, squeeze=q, fallback=f) for p in (True, False) for q in (True, False) for f in (True, False)] + [dict(squeeze=True, fallback=True, rule="nmt_nfkc")]


@pytest.mark.parametrize("kind", KINDS)
def test_every_kind_equals_the_library(kind):
    from sentencepiece import SentencePieceProcessor

    data = made(**kind)
    sp, codec = SentencePieceProcessor(model_proto=data), pieces.Codec(data)
    for text in ("ab ab", "  abab   b ", "bé éé ab", "", " ", "a b"):
        assert codec.encode([text])[0] == sp.encode(text)
    if kind["fallback"] and not kind["squeeze"]:
        assert codec.encode_slice(["bé  ab "])[1] == [True]
    if not kind["fallback"]:
        assert codec.encode_slice(["ab", "bé ab"])[1] == [True, False]


@pytest.mark.parametrize("kind", [{}, *KINDS])
def test_parity_is_checked(kind):
    """A library that answers nonsense is noticed whatever the model's normaliser does."""
    codec = pieces.Codec(made(**kind) if kind else open(P.path("piece_bpe_32k.model"), "rb").read())

    class Nonsense:
        def encode(self, texts, num_threads=1):
            return [[1]] * len(texts)

    codec.reference = Nonsense()
    for text in ("ab", " ab b", "a"):
        with pytest.raises(pieces.ParityError):
            codec.encode([text])


@pytest.mark.parametrize("spec", [{"suffix": True}, {"escape": False}, {"symbols": 1}])
def test_what_is_not_supported_is_refused(spec):
    with pytest.raises(ValueError, match="not supported"):
        pieces.Codec(made(**spec))


def test_ids_of_no_piece(spark):
    rows = spark.createDataFrame([([5, -1, 10**6, None],), ([],), (None,)], "ids array<int>")
    got = [r[0] for r in rows.select(pieces.decode_ids(F.col("ids"), P.path("piece_bpe_32k.model"), spark)).collect()]
    assert got[0].count("⁇") == 3 and got[1:] == ["", None]


def test_small_cache(monkeypatch):
    """However often the cache is emptied, ids are the same."""
    monkeypatch.setattr(pieces, "MOST_CACHED", 5)
    codec, sp = pieces.Codec(open(P.path("piece_bpe_32k.model"), "rb").read()), library()
    for texts in (["a b c d"], ["a e f g h i j k", "a b"], ["b", "zz yy"]):
        assert codec.encode(texts) == sp.encode(texts)
