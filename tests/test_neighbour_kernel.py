"""Products of matrices choose candidates only: distances, ties and exclusions are exact, also far from the origin."""

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import neighbours


@pytest.mark.parametrize("bound", [False, True])
@pytest.mark.parametrize("far", [0.0, 1e7, 1e200])
def test_kernel_is_exact(bound, far):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 4, (60, 6)) / 8, 3, axis=0) + far
    ids, apart = rng.permutation(180), rng.integers(0, 3, 180)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d[apart[:, None] == apart[None]] = np.inf
    want = {}
    for i in range(180):
        for j in np.lexsort((ids, d[i]))[:4]:
            want[ids[i], ids[j]] = d[i, j]
    top = [max(v for (i, _), v in want.items() if i == q) if bound else None for q in ids]
    table = pa.table({"id": pa.array(ids), "v": pa.array(x.tolist(), pa.list_(pa.float64())), "_a": [f"={a}" for a in apart], "_top": pa.array(top, pa.float64())})
    got = neighbours._best(4)(table, table.drop(["_top"]))
    assert dict(zip(zip(*(got[c].to_pylist() for c in ("id", "ref")), strict=True), got["d2"].to_pylist(), strict=True)) == want
