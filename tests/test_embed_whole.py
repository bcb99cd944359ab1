import pytest
from pyspark.sql import functions as F

from nearfold.operators import embed, knn, weights
from nearfold.operators.embed import BATCH, project, resolve_batches
from nearfold.plans import registry
from nearfold.scratch import written
from nearfold.sources import vectors as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["embed_coords", "embed_momentum", "layout_keeps_blobs_apart", "layout_pipeline"])
def test_queries_take_all_samples_of_the_formula(spark, name, monkeypatch):
    asked, drawn = [], []
    whole = embed.resolve_batches
    monkeypatch.setattr(embed, "resolve_batches", lambda n, nnz, x: asked.append(whole(n, nnz, None)) or whole(n, nnz, x))
    monkeypatch.setattr(embed, "_descend", lambda *a: drawn.append(a[6]))  # one shard descends in the driver
    registry.QUERIES[name](spark, SF).count()
    assert len(asked) == 1 and asked[0] >= 1e6 and asked[0] - BATCH - 40 < sum(drawn) <= asked[0]


def test_shards_are_averaged_in_tasks(spark, monkeypatch):
    """Moves come to the driver as one row a range of vertices, whatever the number of shards; the result depends on the seed alone."""
    v = S.dense(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    w = written(weights.edge_weights(knn.exact_knn(v, 5)), "w")
    rows, arrow = [], type(w).toArrow
    monkeypatch.setattr(type(w), "toArrow", lambda df: rows.append(t.num_rows) or t if (t := arrow(df)) is not None else t)
    made = [sorted((r.id, r.coords) for r in project(x, sgd_batches=20 * BATCH, shards=3, epochs=4, momentum=0.5).collect()) for x in (w, w.repartition(5))]
    assert made[0] == made[1] and len(made[0]) == 500 and rows == [500, *[embed.RANGES] * 4] * 2
    start = {r.id: r.coords for r in embed.starting_coords(w.select(F.col("src").alias("id")).distinct()).collect()}
    assert all(c != start[i] for i, c in made[0]) and resolve_batches(10, 10, None) == 10_000
