import random

from sonarium.plans import evidence


def _unit(v):
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def test_zero_shot_against_all_centroids(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i // 3 if i % 7 else None) for i in range(180)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]
    means = {}
    for x in {r[2] for r in rows if r[2] is not None}:
        own = [r[1] for r in rows if r[2] == x]
        means[x] = _unit([sum(c) / len(own) for c in zip(*own)])
    want = set()
    for i, v, _ in rows:
        best = sorted(means, key=lambda x: (-sum(a * b for a, b in zip(_unit(v), means[x])), x))[:3]
        want |= {(i, x, k) for k, x in enumerate(best, 1)}
    assert {(r.item, r.label, r.rank) for r in evidence.zero_shot_top3(spark, str(tmp_path)).collect()} == want


def test_taken_names_of_all_rows(spark, tmp_path):
    for name, row in (("smoke_final_completed", 1), ("smoke_final_no_blanks", 3)):
        spark.createDataFrame([(row, "a.mp3")], "row_id bigint, filename string").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert evidence.free_names(spark, str(tmp_path)).first().target != "a.mp3"
