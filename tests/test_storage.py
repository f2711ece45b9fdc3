"""Files: CSV edge rows, landing, append and resume, cached vectors, streams."""

import pytest
from pyspark.sql import functions as F

from themescope.operators import embedding
from themescope.schemas import RAW_COMPLAINTS
from themescope.session import shared_dir
from themescope.sources import readers, writers
from themescope.streaming.incremental import run_available, stream_table

HEADER = ",".join(f'"{n}"' for n in [*RAW_COMPLAINTS.names, "Unused"])


@pytest.fixture()
def raw(spark, tmp_path):
    lines = [
        HEADER,
        '2023-01-02,Mortgage,,"He said ""no"",\nthen left",ACME,NA,Web,10298545.0,Late,None,x',
        '2022-05-01T01:02:03Z,Mortgage,Sub,text,ACME,TX,Web,7,Late,,x',
        'junk,Mortgage,Sub,,ACME,TX,Web,8,Late,,x',
    ]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_csv(spark, raw):
    rows = {r["Complaint ID"]: r for r in readers.read_raw_csv(spark, raw).collect()}
    assert len(rows) == 3
    assert rows["10298545.0"]["Consumer complaint narrative"] == 'He said "no",\nthen left'
    assert rows["10298545.0"]["State"] == "NA" and rows["10298545.0"]["Sub-product"] is None
    assert rows["8"]["Consumer complaint narrative"] is None


def test_csv_missing_spellings(spark, raw):
    read = readers.read_raw_csv(spark, raw, missing=["NA", "None"], columns=["Sub-issue"])
    row = read.filter("`Complaint ID` like '10298545%'").first()
    assert row["State"] == "NA" and row["Sub-issue"] is None


def test_csv_contract(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Product,Issue\na,b\n")
    with pytest.raises(ValueError, match="Complaint ID"):
        readers.read_raw_csv(spark, str(path))


def test_landing_prunes_months_and_pushes_days(spark, raw, tmp_path, plan):
    landed = readers.land_raw(readers.read_raw_csv(spark, raw), str(tmp_path / "landed"))
    recent = readers.since_partition(landed).select("Complaint ID")
    assert [r["Complaint ID"] for r in recent.collect()] == [10298545]
    text = plan(recent)
    assert "PartitionFilters: [isnotnull(month" in text
    assert "GreaterThanOrEqual(`Date received`,2023-01-01)" in text
    assert "narrative" not in text.split("ReadSchema")[1]


def test_append_and_fresh_start(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert readers.try_read(spark, path) is None
    assert writers.append_missing(rows.filter("k < 4"), path, ["k"]).count() == 4
    assert writers.append_missing(rows, path, ["k"]).count() == 10
    assert writers.append_missing(rows, path, ["k"]).count() == 10
    assert writers.append_run(rows.filter("k < 3"), path, resume=False).count() == 3


def test_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.createDataFrame([(1, " a\n\"b\" ", ["x", "y"])], "id int, t string, l array<string>")
    writers.export_csv(rows, path, single_file=True)
    back = readers.read_raw_csv(spark, path, rows.select("id", "t", F.lit("").alias("l")).schema).first()
    assert (back.t, back.l) == (" a\n\"b\" ", '["x","y"]')


@pytest.mark.parametrize("text,items", [
    ("['a', 'b c']", ["a", "b c"]), ("[\"it's\", 'x']", ["it's", "x"]), (r"['it\'s \"q\"']", ["it's \"q\""]),
    (r"['back\\slash']", ["back\\slash"]), ("['é à']", ["é à"]), ("[]", []), (r"['a\xa0b']", ["a\u00a0b"]), (r"['a\\xa0']", [r"a\xa0"]),
    ("['a', None, 'b']", ["a", None, "b"]), ("[None]", [None]), ("['a, None']", ["a, None"]), ("nonsense", None), (None, None),
])
def test_legacy_lists(spark, text, items):
    row = spark.createDataFrame([(text,)], "t string").select(readers.decode_list(F.col("t")).alias("l")).first()
    assert row.l == items


def test_stored_vectors(spark, tmp_path):
    path = str(tmp_path / "features")
    with pytest.raises(FileNotFoundError):
        readers.read_features(spark, path)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "complaint_id long, narrative string")
    keyed = embedding.with_feature_key(docs, "m")
    stored = keyed.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    writers.append_run(stored.drop("narrative"), path)
    changed = embedding.with_feature_key(
        spark.createDataFrame([(1, "a"), (2, "edited"), (3, "c")], "complaint_id long, narrative string"), "m"
    )
    missing = embedding.missing_vectors(changed, readers.read_features(spark, path))
    assert sorted(r.complaint_id for r in missing.collect()) == [2, 3]
    assert embedding.cache_split(changed, readers.read_features(spark, path)).first()[:] == (1, 2)
    other = embedding.with_feature_key(docs, "another-model")
    assert embedding.missing_vectors(other, readers.read_features(spark, path)).count() == 2


def test_stream_resumes(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.range(0, 50).repartition(5).write.parquet(source)
    schema = spark.range(1).schema

    def run():
        stream = stream_table(spark, source, schema, files_per_batch=2)
        return run_available(stream, lambda d: d.filter("id % 2 = 0"), sink, progress)

    assert run() == 50
    assert run() == 0
    spark.range(50, 60).write.mode("append").parquet(source)
    assert run() == 10
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(0, 60, 2))


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == folder or folder is None


def test_upload_ids_follow_files(spark, tmp_path):
    """Two files of unlike size, the larger one first by name or last."""
    for sizes in ((1500, 40), (40, 1500)):
        base = tmp_path / f"up{sizes[0]}"
        names = []
        for part, rows in enumerate(sizes):
            names += [f"{part}-{i}" for i in range(rows)]
            spark.range(rows).selectExpr(f"concat('{part}-', id) AS narrative").coalesce(1).write.parquet(f"{base}/part={part}")
        table = spark.read.parquet(str(base)).select("narrative")
        got = {r.complaint_id: r.narrative for r in readers.read_upload(table).collect()}
        assert [got[i] for i in range(len(names))] == names
        some = table.filter("narrative NOT LIKE '%7'")
        left = [n for n in names if not n.endswith("7")]
        got = {r.complaint_id: r.narrative for r in readers.read_upload(some).collect()}
        assert [got[i] for i in range(len(left))] == left
    made = spark.createDataFrame([("a",), ("b",)], "narrative string")
    assert sorted(r.complaint_id for r in readers.read_upload(made).collect()) == [0, 1]


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path, plan):
    from themescope.operators.joins import with_truth

    left = writers.write_bucketed(spark.range(500).selectExpr("id AS complaint_id", "id % 7 AS cluster_id"), str(tmp_path / "l"), "complaint_id", 4)
    right = writers.write_bucketed(spark.range(0, 900, 2).selectExpr("id AS complaint_id", "id % 3 AS Issue"), str(tmp_path / "r"), "complaint_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_truth(left, right, "Issue")
        assert "Exchange" not in plan(joined) and joined.count() == 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_streamed_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = spark.range(40)
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "t.parquet"))
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "other.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "t.parquet")
    for kind in ("one", "many"):
        sink, progress = str(tmp_path / f"{kind}-sink"), str(tmp_path / f"{kind}-progress")
        for expected in (40, 0):
            source = stream_table(spark, str(tmp_path / kind), rows.schema, pattern="t.parquet")
            assert run_available(source, lambda d: d, sink, progress) == expected
        assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(40))


def test_stage_tables_are_packed_closer(spark, tmp_path):
    from themescope.sources.writers import write_stage

    rows = spark.range(20).selectExpr("id", "concat('a text that says much of ', id) AS narrative")
    stored = write_stage(rows, str(tmp_path / "stage"))
    assert stored.orderBy("id").collect() == rows.collect()
    files = list((tmp_path / "stage").glob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
