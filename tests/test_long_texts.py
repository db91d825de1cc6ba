"""Image queries over texts that are longer than any prefix."""

import numpy as np
import pytest

from quillspark.functions import kernels as K
from quillspark.plans.media_queries import as_image
from quillspark.plans.queries import QUERIES


def test_whole_texts_are_measured(spark, tmp_path):
    start = "plain words of a text " * 300
    texts = [start, start + "~" * 9000, start + "~}|zZ {" * 2000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: {r["doc_id"]: tuple(r[1:]) for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("X4", "X5", "X9")}
    for i, t in enumerate(texts):
        x = as_image((t or "").encode())
        rng = np.random.Generator(np.random.PCG64(int(x.sum())))
        assert got["X4"][i] == pytest.approx([K.local_contrast(x, m).mean() for m in ("lab", "green", "hsv")])
        assert got["X5"][i] == pytest.approx([K.even_light(x).mean()])
        assert got["X9"][i] == pytest.approx([K.augment(x, n, rng).mean() for _, n, _ in K.POLICY])
