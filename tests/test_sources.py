import pytest

from triagekit import errors
from triagekit.operators.profile import label_list
from triagekit.sources import labelled, store


def put(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv_with_quotes_commas_and_line_ends(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'extra,category,ticket_text\r\n1,a,"x, ""y""\nz"\r\n2,b?,plain\r\n3,NA,gone\r\n4,a,null\r\n')
    got = sorted(map(tuple, labelled.load_labelled(spark, p).collect()))
    assert got == [("plain", "b?"), ('x, "y"\nz', "a")]
    kept = labelled.load_labelled(spark, p, null_tokens=())
    assert kept.count() == 4


@pytest.mark.parametrize(
    "text, error",
    [
        ("", errors.SourceEmpty), ("text,category\na,b\n", errors.MissingColumns),
        ("ticket_text,category\n", errors.NoUsableRows), ("ticket_text,category\n ,a\nx,\n", errors.NoUsableRows),
    ],
)
def test_unusable_inputs(spark, tmp_path, text, error):
    with pytest.raises(error):
        labelled.load_labelled(spark, put(tmp_path / "a.csv", text))


def test_missing_file(spark, tmp_path):
    with pytest.raises(errors.SourceMissing):
        labelled.load_labelled(spark, str(tmp_path / "none.csv"))


def test_one_class_is_not_enough(spark):
    with pytest.raises(errors.TooFewClasses):
        label_list(spark.createDataFrame([("a",)], "category string"), least=2)


def test_write_and_read_back(spark, tmp_path):
    rows = [('say "hi", now', "a"), ("two\nlines", "b")]
    df = spark.createDataFrame(rows, "ticket_text string, category string")
    labelled.write_labelled(df, str(tmp_path / "out"))
    assert sorted(map(tuple, labelled.load_labelled(spark, str(tmp_path / "out")).collect())) == sorted(rows)


def test_cache_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return labelled.with_row_id(spark.range(5).selectExpr("cast(id as string) AS ticket_text"))

    path = str(tmp_path / "cache")
    first = store.load_or_build(spark, path, build).collect()
    assert sorted(first) == sorted(store.load_or_build(spark, path, build).collect()) and len(calls) == 1


def test_append_fills_missing_columns(spark):
    a = spark.createDataFrame([("x", 1)], "text string, n int")
    b = spark.createDataFrame([("y",), ("y",)], "text string")
    assert sorted(map(tuple, labelled.append_by_name(a, b).fillna(0).collect())) == [("x", 1), ("y", 0), ("y", 0)]


def test_metric_report(spark, tmp_path):
    df = spark.createDataFrame([("f1", 0.5), ("size", None)], "metric string, value double")
    store.write_metrics(df, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["f1=0.5"]


def test_stored_size(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.bin").write_bytes(b"x" * 1024 * 1024)
    (tmp_path / "d" / "e" / "b.bin").write_bytes(b"x" * 512 * 1024)
    assert store.stored_megabytes(spark, str(tmp_path / "d")) == 1.5
    with pytest.raises(errors.ModelNotFound):
        store.stored_megabytes(spark, str(tmp_path / "none"))


def test_linked_files_count_once(spark, tmp_path):
    """A store of files under their digests, with names that link to them."""
    blobs, names = tmp_path / "s p" / "blobs", tmp_path / "s p" / "names"
    blobs.mkdir(parents=True), names.mkdir()
    for name in ("a", "b"):
        (blobs / name).write_bytes(b"x" * 1024 * 1024)
        (names / f"{name}.bin").symlink_to(blobs / name)
    assert store.stored_megabytes(spark, str(tmp_path / "s p")) == 2.0
    assert store.stored_megabytes(spark, str(names)) == 2.0


def test_intermediate_tables_go_to_the_folder_of_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    path = store.new_path(spark, "x")
    assert path.startswith(folder or store.shared_folder(spark))
