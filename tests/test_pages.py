import random

from codewarden.operators import pages as G


def store(spark, values, folder, range_rows):
    G.store_pages(spark.createDataFrame([(v, "x") for v in values], "id long, place string"), "id", str(folder), range_rows)


def read(spark, folder, *span):
    return [r.id for r in sorted(G.read_page(spark, str(folder), "id", *span).collect(), key=lambda r: r.place)]


def test_pages_are_slices_of_the_sorted_list(spark, tmp_path):
    rng = random.Random(3)
    values = [rng.randrange(400) for _ in range(600)] + [7] * 300 + [None, None]
    store(spark, values, tmp_path, 50)
    want = sorted(values, key=lambda v: (v is not None, v or 0))
    assert G.page_total(spark, str(tmp_path)) == len(want)
    for offset, limit in ((0, 0), (0, 1), (100, 250), (899, 10), (902, 5), (5_000, 0)):
        assert read(spark, tmp_path, offset, limit) == want[offset:offset + limit if limit else None]


def test_a_page_reads_only_its_ranges(spark, tmp_path):
    store(spark, range(1_000), tmp_path, 50)
    page = G.read_page(spark, str(tmp_path), "id", 930, 20)
    ranges = spark.read.parquet(f"{tmp_path}/keys").select("_range").distinct().count()
    read_ranges = {r.f.split("_range=")[1].split("/")[0] for r in spark.read.parquet(f"{tmp_path}/keys").where("id BETWEEN 930 AND 949").selectExpr("_metadata.file_path f").collect()}
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert ranges >= 15 and len(read_ranges) <= 2
    assert "PartitionFilters: [isnotnull(_range" in plan and f">= {min(map(int, read_ranges))})" in plan and f"<= {max(map(int, read_ranges))})" in plan
    assert [r.id for r in page.orderBy("place").collect()] == list(range(930, 950))


def test_an_empty_list(spark, tmp_path):
    store(spark, [], tmp_path, 50)
    assert G.page_total(spark, str(tmp_path)) == 0 and read(spark, tmp_path, 0, 5) == []
