"""Helpers on Arrow arrays of either offset width."""

import numpy as np
import pyarrow as pa
import pytest

from visitloom.llm import common

TEXTS = ["ab", None, "", "é" * 40, "x", "yy"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_bytes_and_blocks_of_texts(kind):
    for values in (pa.array(TEXTS, kind), pa.array(["zzz", *TEXTS, "w"], kind).slice(1, 6)):
        data, begins = common.text_bytes(values)
        assert [bytes(data[a:b]).decode() for a, b in zip(begins, begins[1:])] == [t or "" for t in TEXTS]
        assert list(common.blocks(values, 4)) == [(0, 3), (3, 4), (4, 6)]
    assert list(common.blocks(pa.array([], kind))) == [] and len(common.text_bytes(pa.array([], kind))[0]) == 0
    assert list(common.blocks(pa.array([1] * 5000))) == [(0, 4096), (4096, 5000)]


def test_bits_let_all_members_pass(spark):
    rnd = np.random.default_rng(1)
    own, other = rnd.integers(-(1 << 63), (1 << 63) - 1, 500), rnd.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bits = common.hash_bits(spark.createDataFrame([(int(h),) for h in own], "h long"), "h", 1 << 16)
    assert common.in_bits(bits, own).all() and common.in_bits(bits, other).mean() < 0.03
    assert not common.hash_bits(spark.createDataFrame([], "h long"), "h", 64).any()
