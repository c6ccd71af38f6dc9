import random

from alertsift.llm import graph


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(40)] + [(7, 7), (300, 299)]
    edges += [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(90)] + edges[:5]
    part = {v: v for e in edges for v in e}
    for _ in range(len(part)):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    want = {v: p for v, p in part.items() if any(v in e and e[0] != e[1] for e in edges)}
    got = graph.components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0
