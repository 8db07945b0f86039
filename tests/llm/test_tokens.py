import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintel.llm import tokens
from tests.llm.helpers import awkward, clashing, empty

needs_ranks = pytest.mark.skipif(not os.path.exists(tokens.RANKS_PATH), reason="no tokenizer")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70_000), st.integers(0, 3), st.integers(0, 2**31 - 1)), max_size=700), st.sampled_from([(10, 6), (8,), (1,), (3, 5, 7), (31,)]))
def test_round_trip_and_access(ids, widths):
    d = tokens.Dac(tokens.encode_dac(np.array(ids, np.int64), widths))
    assert len(d) == len(ids) and d.decode().tolist() == ids
    for i in {0, len(ids) // 2, len(ids) - 1, *range(0, len(ids), 37)} if ids else ():
        assert d[i] == ids[i]


def test_long_and_bad():
    ids = np.random.default_rng(0).integers(0, 50_000, 200_000)
    d = tokens.Dac(tokens.encode_dac(ids))
    assert all(d[int(i)] == ids[i] for i in (0, 511, 512, 513, 199_999, 77_777))
    for i in (-1, 200_000):
        with pytest.raises(IndexError):
            d[i]
    with pytest.raises(ValueError, match="ids"):
        tokens.encode_dac(np.array([-1]))
    with pytest.raises(ValueError, match="codes"):
        tokens.Dac(b"nope")


def bytes_of(ids):
    """What ids stand for, by the file of ranks alone."""
    by = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(tokens.RANKS_PATH, "rb").read().splitlines()) if a}
    return b"".join(by[int(i)] for i in ids)


@needs_ranks
@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(alphabet="ab é,.\n\t  1'日 　", max_size=30), st.text(max_size=20)))
def test_ids_give_the_text_again(text):
    ids = tokens.byte_bpe(open(tokens.RANKS_PATH, "rb").read())(text)
    assert bytes_of(ids) == text.encode("utf-8", "replace")


@needs_ranks
def test_rows(spark):
    source = awkward(spark)
    got = tokens.token_codes(source).collect()
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    assert len(got) == 8
    for r in got:
        if texts[r["doc_id"]] is None:
            assert r["codes"] is None and r["n_tokens"] is None
        else:
            codes = tokens.Dac(bytes(r["codes"]))
            assert bytes_of(codes.decode()) == texts[r["doc_id"]].encode() and r["n_tokens"] == len(codes)
    assert tokens.token_codes(empty(spark)).count() == 0 and tokens.token_codes(clashing(spark)).count() == 2
