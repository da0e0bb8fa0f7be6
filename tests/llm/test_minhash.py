"""What the signature check loses, and links inside a cell of a bucket."""

from math import comb

import numpy as np
import pyarrow as pa

from maskloom.llm import minhash


def test_signature_check_loses_less_than_banding():
    n = minhash.BANDS * minhash.ROWS
    loss = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(minhash.least_agreement(80)))
    assert loss < 0.1 * (1 - 0.8**minhash.ROWS) ** minhash.BANDS


def test_hashes_that_agree_in_their_upper_half_are_not_equal():
    x = np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    sets = [x, x + np.uint64(1), np.append(x[:95], x[95:] + np.uint64(7))]
    sig = np.arange(minhash.BANDS * minhash.ROWS, dtype=np.uint32)
    bucket = int(minhash.band_keys(sig[None])[0, 0])
    cell = {"node": [1, 2, 3], "comp": [1, 2, 3], "block": [0, 0, 0], "i": [0] * 3, "j": [0] * 3, "bucket": [bucket] * 3, "sig": [sig.tobytes()] * 3, "hashes": [np.sort(s).tobytes() for s in sets]}
    assert minhash._across(80)(pa.table(cell)).to_pylist() == [{"a": 3, "b": 1}]
