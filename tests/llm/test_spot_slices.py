"""Fingerprints are made of a slice of a batch's texts at a time."""

import hashlib

import numpy as np
import pytest

from murmur.llm import spot_signatures


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_slices_hold_a_bounded_number_of_bytes(n):
    sizes = [0, spot_signatures.SLICE_BYTES + 1, 5, 0, spot_signatures.SLICE_BYTES // 2, spot_signatures.SLICE_BYTES // 2, 0][:n]
    got = list(spot_signatures._slices(sizes))
    assert [i for a, b in got for i in range(a, b)] == list(range(n))
    assert all(sum(sizes[a:b]) <= spot_signatures.SLICE_BYTES or sum(x > 0 for x in sizes[a:b]) == 1 for a, b in got)


def test_fingerprints_by_slices(spark):
    texts = ["the old house of the river bank", "", None, "nothing here", "Das Haus ist am großen Fluss " * 60_000, "the old house of the river bank"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = spot_signatures.fingerprints(df)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    for r in made.collect():
        want = spot_signatures.spots([texts[r.doc_id] or ""], wide=True)[0]
        assert r.spots == want.view(np.int64).tolist() and bytes(r.mark) == hashlib.md5(want.tobytes()).digest()
