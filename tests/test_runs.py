import pytest
from pyspark.sql import functions as F

from cohortlens.plans.profile_run import profile_tables, run_profile
from cohortlens.plans.queries import part_dataset
from cohortlens.plans.training_run import load_dataset, output_folder, run_training
from cohortlens.sources.dataset import write_dataset
from cohortlens.storage import stage


def test_profile_tables(spark, tmp_path):
    dataset = stage(part_dataset(spark, "/root/testdata/sf0.001"))
    write_dataset(dataset, str(tmp_path / "data.parquet"))
    names = run_profile(spark, str(tmp_path / "data.parquet"), str(tmp_path / "tables"))
    assert len(names) == 13 and "success_by_language" in names
    summary = spark.read.parquet(str(tmp_path / "tables" / "summary"))
    assert summary.count() == 33 and summary.filter("n != 168").isEmpty()
    # without any language the activity levels take over
    bare = dataset.withColumn("primary_language", F.lit(None).cast("string"))
    tables = profile_tables(bare)
    assert "languages" not in tables
    assert tables["success_by_activity"].agg(F.sum("total_repos")).first()[0] == 168


def test_checker_sees_differences(spark):
    import duckdb
    from check import difference

    df, db = spark.sql("SELECT 1 AS a, 2.5D AS b UNION ALL SELECT 3, NULL"), duckdb.connect()
    same = "SELECT 1 AS a, 2.5::DOUBLE AS b UNION ALL SELECT 3, NULL"
    assert difference(df, same, db) == (2, None)
    for other in (same.replace("2.5", "2.6"), same + " UNION ALL SELECT 3, NULL", same.replace("AS b", "AS c")):
        assert difference(df, other, db)[1]


@pytest.mark.parametrize(
    "source, output",
    [
        ("/data/processed", "/data"),
        ("/data/model/part.csv", "/data"),
        ("/data", "/data"),
        ("/data/in.csv", "/data/in.csv"),
        ("file:///data/reports", "/data/"),
        ("/data/processed/x/y", "/data"),
    ],
)
def test_output_never_touches_the_input(source, output):
    with pytest.raises(ValueError, match="input"):
        output_folder(source, output, ("model", "processed", "reports"))


def test_output_is_fresh_or_as_given():
    assert output_folder("/data/in.csv", "/out/", ("model",)) == "/out"
    first, second = (output_folder("/data/processed", None, ("model", "processed")) for _ in range(2))
    assert first != second and first.startswith("/data/processed-run-")


def test_a_folder_named_processed_stays(spark, tmp_path):
    source = tmp_path / "processed"
    write_dataset(stage(part_dataset(spark, "/root/testdata/sf0.001")), str(source), "csv")
    before = {p.name: p.stat().st_mtime_ns for p in source.iterdir()}
    with pytest.raises(ValueError):
        run_training(spark, str(source), str(tmp_path))
    with pytest.raises(ValueError):
        run_profile(spark, str(source), str(source / "tables"))
    assert {p.name: p.stat().st_mtime_ns for p in source.iterdir()} == before


def test_format_is_found_or_given(spark, tmp_path):
    dataset = stage(part_dataset(spark, "/root/testdata/sf0.001"))
    write_dataset(dataset, str(tmp_path / "as_parquet"))
    write_dataset(dataset, str(tmp_path / "as_csv"), "csv")
    for name, fmt in (("as_parquet", "auto"), ("as_parquet", "parquet"), ("as_csv", "auto"), ("as_csv", "csv")):
        got = load_dataset(spark, str(tmp_path / name), fmt)
        assert got.count() == 168 and got.columns == dataset.columns
    with pytest.raises(ValueError):
        load_dataset(spark, str(tmp_path / "as_csv"), "orc")
