from cuemill.operators import tqa
from cuemill.plans import tqa_queries


def test_every_dimension_counts(spark):
    n = 1200
    scores = spark.range(n).selectExpr("'c' AS candidate_id", "'s' AS sample_id", "concat('d', id) AS dimension", "IF(id = 0, 1.0D, 3.0D) AS median", "array() AS hard", "false AS refused")
    for first in (True, False):
        weights = spark.range(n).selectExpr("concat('d', id) AS dimension", "1.0D AS weight").orderBy("dimension", ascending=first)
        assert tqa.episodes(scores, weights).first().failed == n
        row = tqa.sample_display(scores, weights).first()
        assert (row.lowest, row.weighted) == (1.0, round((3 * n - 2) / n, 4))


def test_every_alias_gets_its_cases(spark, tmp_path):
    n = 1100
    spark.range(n).selectExpr("concat('m', lpad(id, 4, '0')) AS model_alias").unionByName(spark.sql("SELECT * FROM VALUES (''), (NULL) AS t(model_alias)")).write.parquet(f"{tmp_path}/translate_results.parquet")
    spark.createDataFrame([("e1",), ("e2",)], "episode_id string").write.parquet(f"{tmp_path}/episodes.parquet")
    rows = {r.case_number: r.case_id for r in tqa_queries.case_grid(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(1, n * 3 * 2 + 1))
    assert rows[1] == "001__e1__m0000__temperature-OMIT__topP-OMIT" and rows[n * 6] == "6600__e2__m1099__temperature-0.7__topP-0.9"
