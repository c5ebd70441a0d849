import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm.jaccard import _may_link, _sketch


@pytest.mark.parametrize("seed", [1, 2])
def test_sketches_lose_no_link(spark, seed):
    """Of sets around the threshold, of sizes on both sides of a sketch's length, no link is ruled out, and far ones are."""
    rng, rows = np.random.default_rng(seed), []
    for n in (1, 2, 5, 20, 33, 64, 65, 250, 257, 1030, 5000):
        for share in (0.0, 0.5, 0.78, 0.8, 0.85, 1.0):
            base = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
            common = int(np.ceil(share * n))
            for a, b in ((base[:n], base[:common]), (base[:n], np.concatenate([base[:common], base[n : 2 * n - common]]))):
                if len(b):
                    both = len(np.intersect1d(a, b))
                    rows.append((_sketch(a), _sketch(b), len(a) + len(b), 100 * both >= 80 * (len(a) + len(b) - both), share, n))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, n int, links boolean, share double, size int")
    got = df.select("links", "share", "size", *(_may_link(F.col(x), F.col(y), F.col("n")).alias(k) for k, x, y in (("there", "a", "b"), ("back", "b", "a")))).collect()
    assert all(r["there"] and r["back"] for r in got if r["links"])
    assert not any(r["there"] or r["back"] for r in got if r["share"] <= 0.5 and r["size"] >= 250)
