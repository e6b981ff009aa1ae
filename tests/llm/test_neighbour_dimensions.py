import numpy as np
from test_neighbours import collected, exact

from loomscan.llm import neighbours


def test_each_dimension_is_searched(spark):
    """A table of three dimensions gives what each dimension gives alone."""
    rng = np.random.default_rng(6)
    groups = [[(i, rng.normal(size=dim).tolist()) for i in range(start, start + n)] for dim, start, n in ((8, 0, 300), (5, 1000, 120), (3, 2000, 60))]
    df = spark.createDataFrame([r for g in groups for r in g] + [(3000, [1.0])], "vec_id bigint, embedding array<double>").repartition(3)
    got = collected(neighbours.nearest(df, bound=6.0))
    want = {q: v for g in groups for q, v in exact(g).items()}
    assert got.keys() == want.keys() and len(got) == 24
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
