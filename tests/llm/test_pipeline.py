import corpus_pipeline as C


def test_stages_over_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out = out.cache()
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.6 * len(ids)
        assert out.where("n_chars <> char_length(text)").count() == 0
        docs, ids = out, kept
    packed = C.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0 and [n for n, _ in C.STAGES][0] == "toxicity" and len(C.STAGES) == 5


def test_stages_take_an_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_take_odd_rows_and_clashing_columns(spark, odd):
    from pyspark.sql import functions as F

    docs = odd.withColumns({c: F.lit(1) for c in ("spans", "items", "removed", "text_hash", "held_out", "predicted", "contaminated", "component_id", "class")})
    docs = docs.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert {r.text for r in out.collect()} <= {r.text for r in docs.collect()}
    assert C.pack_documents(spark, docs, "/root/testdata/sf0.001").count() >= docs.count()


def test_rows_of_one_doc_id_are_judged_by_their_text(spark):
    """A near copy goes; another row of its doc_id, with a text of its own, stays."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text + " z", "b"), (2, "a text that nobody else has written so far", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = C.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns and sorted(r.source for r in left.collect()) == ["a", "c"]


def test_only_the_last_table_stays(spark):
    import glob

    from codewarden.session import shared_folder

    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*/*"))
    C.run(spark, "/root/testdata/sf0.001")
    new = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*/*")) - before
    assert [p.rsplit("-", 1)[1] for p in new] == ["packing"]
