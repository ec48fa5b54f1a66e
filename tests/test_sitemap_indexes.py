"""Sitemap pages beyond what one index may list."""

from pyspark.sql import functions as F

from tallymart.sources import files


def test_more_pages_than_an_index_may_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "INDEX", 3)
    df = spark.range(1, 96).select("id", F.concat(F.lit("https://a/"), F.col("id")).alias("loc"), F.lit("2020-01-02").cast("date").alias("lastmod"))
    assert files.write_sitemap_pages(df, str(tmp_path), "id", 10) == 10
    assert files.read_sitemap_index(spark, f"{tmp_path}/index").count() == 4
    found = sorted((int(r["loc"][10:]), r["page"]) for r in files.read_sitemap_pages(spark, str(tmp_path)).collect())
    assert found == [(n, (n - 1) // 10 + 1) for n in range(1, 96)]
    assert {r["loc"] for r in files.read_sitemaps(spark, f"{tmp_path}/index").collect()} == {f"https://a/{n}" for n in range(1, 96)}
