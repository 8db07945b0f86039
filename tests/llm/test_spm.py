import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintel.llm import spm
from tests.llm.helpers import awkward, clashing, empty

pytestmark = pytest.mark.skipif(not os.path.exists(spm.MODEL_PATH), reason="no tokenizer")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def bpe():
    data = open(spm.MODEL_PATH, "rb").read()
    return spm.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)


SOME = ["", " ", "  a  b ", "Hello, world", "x\n\ny\tz", "日本語 😀 ​", "▁a ▁▁", "a" * 300, "\x00\x7f", "don't stop 12345", "supercalifragilisticexpialidocious unbelievable", "naïve façade — “quoted”"]


def test_bpe_like_the_library(bpe):
    t, library = bpe
    for x in SOME:
        assert t.encode(x) == library.encode(x), x
        assert t.decode(library.encode(x)) == library.decode(library.encode(x)), x
    offsets, ids = t.chunk_encoder().encode(pa.array([*SOME, None]))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [*map(library.encode, SOME), []]
    assert t.decode_many(offsets, ids).to_pylist() == [library.decode(library.encode(x)) for x in [*SOME, ""]]


@settings(max_examples=300, deadline=None)
@given(x=st.one_of(st.text(max_size=40), st.text(alphabet="abcdest ▁nrio,.é\n", max_size=60), st.text(alphabet="ab  \n", max_size=20), st.text(alphabet="ʀaḅ 日é5\x00ż", max_size=20)))
def test_bpe_on_any_text(bpe, x):
    t, library = bpe
    expected = library.encode(x)
    assert t.encode(x) == expected
    _, ids = t.chunk_encoder().encode(pa.array([x]))
    assert ids.tolist() == expected


def model(pieces, kind, fallback, squeeze=True):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    for p, score, t in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *([(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else []), *[(p, s, 1) for p, s in pieces]]:
        m.pieces.add(piece=p, score=score, type=t)
    m.trainer_spec.model_type = kind
    m.trainer_spec.byte_fallback = fallback
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = squeeze
    return m.SerializeToString()


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_like_the_library(fallback, squeeze):
    pieces = [("▁", -2.0), ("a", -3.1), ("b", -3.2), ("c", -4.3), ("ab", -4.9), ("bc", -5.05), ("abc", -8.3), ("▁ab", -5.7), ("▁a", -4.25), ("cab", -7.7), ("▁▁", -5.0)]
    data = model(pieces, 1, fallback, squeeze)
    t, library = spm.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for x in ["abc", "ab abcab", "  a  bc ", "xyz abx", "éa", "", "cabcabcab", "a x", "日a本"]:
        assert t.encode(x) == library.encode(x), x
        assert t.decode(t.encode(x)) == library.decode(library.encode(x)), x


def test_bpe_of_another_model():
    pieces = [("ab", -0.0), ("bc", -1.0), ("abc", -2.0), ("▁a", -3.0), ("aa", -4.0), ("aab", -5.0), ("xz", -5.5), *[(c, -10.0 - i) for i, c in enumerate("▁abcx")]]
    data = model(pieces, 2, True)
    t, library = spm.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    import itertools

    for n in range(1, 7):
        for x in map("".join, itertools.product("abc", repeat=n)):
            assert t.encode(x) == library.encode(x), x
    for x in ["xz", "axzb", "x za", "zzx"]:
        assert t.encode(x) == library.encode(x), x


def test_columns_with_runs_of_spaces(bpe):
    """Whatever the spaces, a column gives what its texts give one by one, squeezed or not."""
    _, library = bpe
    texts = ["a  b", " a", "a ", "  ", " ", "", None, "   a   b\n  c  ", "a b", "\n\n  x", "x  \n"]
    offsets, ids = bpe[0].chunk_encoder().encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(x or "") for x in texts]
    pieces = [("▁", -2.0), ("a", -3.1), ("b", -3.2), ("ab", -4.9), ("▁a", -4.25), ("▁▁", -5.0)]
    for kind in (1, 2):
        for squeeze in (False, True):
            data = model(pieces, kind, True, squeeze)
            t, library = spm.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
            offsets, ids = t.chunk_encoder().encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(x or "") for x in texts]


def test_double_spaces_are_not_slow(bpe):
    import time

    t, _ = bpe
    rng = __import__("random").Random(0)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    plain = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(150)]
    wide = [x.replace(" ", "  ", 1) + " " for x in plain]
    took = []
    for texts in (plain, wide):
        encoder = t.chunk_encoder()
        encoder.encode(pa.array(texts))
        began = time.process_time()
        for _ in range(5):
            encoder.encode(pa.array(texts))
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.05


def test_composed_normaliser_against_rewriting_by_hand():
    import itertools

    rules = {"a": "x", "ab": "", "abc": "y ", "ca": " ", "bb": "b"}
    for prefix, squeeze in itertools.product((False, True), (False, True)):
        machine = spm.Composed(spm.Rules(rules), spm.Spaces(prefix, squeeze, "_"))
        for n in range(7):
            for text in map("".join, itertools.product("abc ", repeat=n)) if n < 6 else ["abcabca", "ababcab", "  a  bb cab "]:
                at, expected = 0, ""
                while at < len(text):
                    k = next((k for k in (3, 2, 1) if text[at : at + k] in rules and at + k <= len(text)), 0)
                    expected, at = (expected + rules[text[at : at + k]], at + k) if k else (expected + text[at], at + 1)
                if squeeze:
                    expected = " ".join(expected.split(" ")).strip(" ")
                    while "  " in expected:
                        expected = expected.replace("  ", " ")
                expected = ((" " if prefix and expected else "") + expected).replace(" ", "_")
                out, state = "", machine.start
                for c in text:
                    more, state = machine.step(state, c)
                    out += more
                assert out + machine.end(state) == expected, text


def test_charsmap():
    """A double array by hand: A -> a, AB -> xy."""
    units = [0] * 512
    label = lambda c, offset, leaf: c | (offset << 10) | (leaf << 8)
    units[0] = 1 << 10  # the root's children are at 1 ^ label
    at_a = 1 ^ 65
    units[at_a] = label(65, at_a ^ 256, 1)
    base = 256
    units[base] = 0 | 1 << 31  # the value of A: 0
    at_b = base ^ 66
    units[at_b] = label(66, at_b ^ 400, 1)
    units[400] = 2 | 1 << 31  # the value of AB: 2
    import struct

    blob = struct.pack("<I", len(units) * 4) + struct.pack(f"<{len(units)}I", *units) + b"a\0xy\0"
    assert spm.charsmap_rules(blob) == {"A": "a", "AB": "xy"}
    assert spm.charsmap_rules(b"") == {}


def test_rows(spark, bpe):
    t, library = bpe
    source = awkward(spark)
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    got = spm.encode_pieces(source)
    for r in got.collect():
        x = texts[r["doc_id"]]
        assert (r["ids"], r["restored"], r["n_tokens"]) == ((None, None, None) if x is None else (library.encode(x), True, len(library.encode(x))))
    back = {r["doc_id"]: r["back"] for r in spm.decode_pieces(got, out="back").collect()}
    assert back == texts
    assert spm.encode_pieces(empty(spark)).count() == 0 and spm.encode_pieces(clashing(spark)).count() == 2
