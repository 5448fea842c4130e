import numpy as np

from pyspark.sql import functions as F

from spanloom.llm import embeddings
from spanloom.llm.common import Staged


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 64))
    near = base[:5].repeat(30, axis=0) + rng.normal(size=(150, 64)) * 0.2
    x = np.concatenate([base, near, base[:3], 7 * base[3:5]]).astype(np.float32)
    rows = [(i * 2, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(9001, None, 0), (9003, [0.0] * 64, 0), (9005, [float("nan")] * 64, 0), (9007, [float("inf")] + [1.0] * 63, 0), (9009, [None] + [1.0] * 63, 0), (9011, [1.0, 2.0], 0), (9013, [2.0, 4.0], 0), (9015, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    least = np.arange(len(x))
    for _ in range(20):
        least = np.minimum(least, np.where(link, least[None, :], len(x)).min(axis=1))
    for i in range(len(x)):
        assert got[2 * i] == (int(link[i].sum()), 2 * int(least[i]), int(least[i]) == i)
    assert got[9011] == (1, 9011, True) and got[9013] == (1, 9011, False)
    assert all(got[k] == (0, k, True) for k in (9001, 9003, 9005, 9007, 9009, 9015))
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_many_copies_and_a_cluster_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    x = base + rng.normal(size=(150, 64)) * 0.1
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    many = spark.range(1000, 41_000).select(F.col("id").alias("vec_id"), F.lit(0).alias("k")).join(few.limit(1).select("embedding"))
    got = {r.vec_id: r for r in embeddings.near_embeddings(few.unionByName(many.select("vec_id", "embedding"))).collect()}
    assert len(got) == 40_150 and all(r.component_id == 0 and r.n_links == 40_149 for r in got.values())


def test_blocks_of_a_full_cell_are_bounded_on_both_sides(spark):
    asked = spark.range(2000).selectExpr("id as row", "2 as dims", "7L as cell", "id % 2 = 0 as home", "1L as copies", "array(1f, 2f) as v")
    dealt = embeddings.dealt(asked, Staged(spark), 100)
    assert dealt.groupBy("part", "door", "home").count().agg(F.max("count")).first()[0] < 200
    asks, lives = dealt.where("not home").select("row", "part", "door"), dealt.where("home").select(F.col("row").alias("other"), "part", "door")
    met = asks.join(lives, ["part", "door"]).groupBy("row", "other").count()
    assert met.count() == 2000 * 1000 and met.where("count > 1").count() == 0


def test_a_vector_stands_in_few_cells(spark, monkeypatch):
    held, real = [], embeddings.dealt
    monkeypatch.setattr(embeddings, "dealt", lambda asked, staged, most: held.append(asked.count()) or real(asked, staged, most))
    x = np.random.default_rng(3).normal(size=(500, 64)).astype(np.float32)
    assert embeddings.near_embeddings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).count() == 500
    assert held[0] < 6 * 500
