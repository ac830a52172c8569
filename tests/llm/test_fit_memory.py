"""The quality fit holds one table of its sample on the driver."""
import tracemalloc

import numpy as np

from caseloom.llm import quality_knn
from caseloom.llm.tables import in_fit


def test_the_driver_holds_one_table_of_the_sample(spark, docs):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 3000, 60))) for i in range(1500)]
    df = docs(rows)
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    n = labels.where(in_fit()).count()
    tracemalloc.start()
    model = quality_knn.fit(df, labels, "quality")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.labels) == n
    assert peak < 2 * n * (quality_knn.WORDS + quality_knn.SHAPES) * 4
