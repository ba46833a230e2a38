import pytest

from groundwell.sources import documents
from groundwell.sources.documents import list_documents, listing_count, read_documents, spread
from tests.conftest import plan_of

FILES = {
    "a.txt": b"one\r\ntwo",
    "B.MD": b"upper",
    "bom.txt": b"\xef\xbb\xbfmarked",
    "bad.md": b"a\xffb",
    "sp ace%20+\xc3\xa9.txt": b"odd name",
    "blank.txt": b" \n",
    "empty.txt": b"",
    ".hid.txt": b"hidden",
    "c.exe": b"binary",
    "large.txt": b"x" * 101,
}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "nested").mkdir(parents=True)
    (root / "nested" / "d.txt").write_bytes(b"deep")
    (tmp_path / "docs-evil").mkdir()
    (tmp_path / "docs-evil" / "x.txt").write_bytes(b"x")
    for name, data in FILES.items():
        (root / name.encode("latin-1").decode()).write_bytes(data)
    return str(root)


def test_listing(spark, folder):
    listing = list_documents(spark, folder)
    names = [r["file_name"] for r in listing.collect()]
    assert names == ["a.txt", "B.MD", "bad.md", "blank.txt", "bom.txt", "large.txt", "sp ace%20+é.txt"]
    assert listing.columns == ["file_name", "size_bytes", "last_modified"]
    assert listing.first()["size_bytes"] == 8
    assert "content" not in plan_of(listing)
    assert listing_count(listing).first()[0] == 7


def test_listing_with_other_extensions(spark, folder):
    assert [r["file_name"] for r in list_documents(spark, folder, ["EXE"]).collect()] == ["c.exe"]


def test_reading_the_whole_folder(spark, folder):
    documents, rejects = read_documents(spark, folder, max_bytes=100)
    texts = {r["file_name"]: r["text"] for r in documents.collect()}
    assert texts == {
        "a.txt": "one\r\ntwo",
        "B.MD": "upper",
        "bom.txt": "marked",
        "bad.md": "a�b",
        "blank.txt": " \n",
        "sp ace%20+é.txt": "odd name",
    }
    assert [tuple(r) for r in rejects.collect()] == [("read", "large.txt", "document.too_large")]


def test_requested_files(spark, folder):
    asked = spark.createDataFrame(
        [("a.txt", "mine"), ("a.txt", "mine"), ("a.txt", "ours"), ("gone.txt", None), ("../docs-evil/x.txt", None), ("nested/d.txt", None),
         ("c.exe", None), ("large.txt", None)],
        "file_name string, category string",
    )
    documents, rejects = read_documents(spark, folder, asked, max_bytes=100)
    found = sorted((r["file_name"], r["category"]) for r in documents.collect())
    assert found == [("a.txt", "mine"), ("a.txt", "ours")]
    assert {r["row_key"]: r["error_code"] for r in rejects.collect()} == {
        "gone.txt": "document.not_found",
        "../docs-evil/x.txt": "file_name.not_a_bare_name",
        "nested/d.txt": "file_name.not_a_bare_name",
        "c.exe": "file_name.extension_not_allowed",
        "large.txt": "document.too_large",
    }


def test_root_containment(spark):
    from groundwell.sources.documents import in_root
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(
        [("file:///data/docs/a.txt",), ("file:/data/docs-evil/a.txt",), ("file:/data/docs/a.txt",)],
        "path string",
    )
    got = [r[0] for r in frame.select(in_root(F.col("path"), "/data/docs/")).collect()]
    assert got == [True, False, True]
    cloud = spark.createDataFrame([("hdfs://n1/docs/a.txt",)], "path string")
    assert cloud.select(in_root(F.col("path"), "hdfs://n1/docs")).first()[0]


def test_spread_leaves_large_tables_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores + 3)
    assert spread(many, "id") is many


def test_many_files_take_few_tasks(spark, folder, monkeypatch):
    listed = documents.folder(spark, folder)
    found = spark.read.format("binaryFile").load(folder).rdd.getNumPartitions()
    assert listed.rdd.getNumPartitions() == found > 1
    monkeypatch.setattr(documents, "FOLDER_TASKS_PER_CORE", 0)
    few = documents.folder(spark, folder)
    assert few.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, listed.collect()))


def test_a_file_per_row(spark, tmp_path):
    """What Spark's writer leaves with one record a file, without a checksum file beside each."""
    from checks.frames import write_files

    texts = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, None), (3, ""), (4, "é")], "doc_id long, text string")
    path = tmp_path / "files"
    write_files(texts.repartition(3), str(path))
    assert sorted(f.read_bytes() for f in path.iterdir()) == sorted(t.encode() for t in ("a\nb\n", "a\nb\n", "\n", "\n", "é\n"))
