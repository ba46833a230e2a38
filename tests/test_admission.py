from groundwell.operators.admission import (
    assign_category,
    check_documents,
    check_file_names,
    check_requests,
    rejects_by_code,
    split_admitted,
)

NAMES = {
    None: "file_name.missing",
    "": "file_name.missing",
    " \t　": "file_name.missing",
    "../settings.json": "file_name.not_a_bare_name",
    "..\\up\\notes.txt": "file_name.not_a_bare_name",
    "nested/inner.txt": "file_name.not_a_bare_name",
    "C:x.md": "file_name.not_a_bare_name",
    ".": "file_name.not_a_bare_name",
    "..": "file_name.not_a_bare_name",
    "a?.md": "file_name.invalid_characters",
    "a\x07.md": "file_name.invalid_characters",
    "a.md\n": "file_name.invalid_characters",
    "..?": "file_name.invalid_characters",
    ".md": "file_name.stem_missing",
    "minutes.pdf": "file_name.extension_not_allowed",
    "noext": "file_name.extension_not_allowed",
    "doc.md ": "file_name.extension_not_allowed",
    "doc.": "file_name.extension_not_allowed",
    "a.b.md": None,
    "UPPER.TXT": None,
}


def test_file_names(spark):
    frame = spark.createDataFrame([(n,) for n in NAMES], "file_name string")
    got = {r["file_name"]: r["error_code"] for r in check_file_names(frame).collect()}
    assert got == NAMES


def test_allowed_extensions_get_their_dot(spark):
    frame = spark.createDataFrame([("a.LOG",), ("a.md",)], "file_name string")
    got = [r["error_code"] for r in check_file_names(frame, allowed=["log"]).collect()]
    assert got == [None, "file_name.extension_not_allowed"]


def test_documents(spark):
    frame = spark.createDataFrame(
        [("é" * 6,), ("\n  ",), (None,), ("fine",)], "text string"
    )
    got = [r["error_code"] for r in check_documents(frame, max_bytes=10).collect()]
    assert got == ["document.too_large", "document.empty", "document.empty", None]


def test_category(spark):
    frame = spark.createDataFrame(
        [("a.b.md", None), ("a.md", " \t"), ("a.md", " plans "), (".md", None)],
        "file_name string, category string",
    )
    rows = assign_category(frame).collect()
    assert [r["category"] for r in rows] == ["a.b", "a", "plans", ""]
    assert [r["error_code"] for r in rows] == [None, None, None, "category.missing"]


def test_requests(spark):
    frame = spark.createDataFrame(
        [
            (1, " \tq　", None, "  ", None),
            (2, "\t", 0, None, 5.0),
            (3, "x" * 2000 + " ", 50, " c ", 1.0),
            (4, "x" * 2001, None, None, None),
            (5, "q", 51, None, float("nan")),
            (6, "q", 1, None, float("nan")),
            (7, "q", 1, None, -0.1),
        ],
        "query_id int, query string, top_k int, category string, min_similarity double",
    )
    accepted, rejects = split_admitted(check_requests(frame))
    rows = {r["query_id"]: r for r in accepted.collect()}
    assert rows[1][1:] == ("q", 5, None, 0.0)
    assert rows[3]["category"] == "c" and rows[3]["top_k"] == 50
    assert {r["query_id"]: r["error_code"] for r in rejects.collect()} == {
        2: "query.missing",
        4: "query.too_long",
        5: "top_k.out_of_range",
        6: "min_similarity.out_of_range",
        7: "min_similarity.out_of_range",
    }


def test_rejects_by_code(spark):
    codes = ["document.not_found", "query.missing", "query.missing", "answer.no_context", "new.code"]
    frame = spark.createDataFrame([(c,) for c in codes], "error_code string")
    assert sorted(map(tuple, rejects_by_code(frame).collect())) == [
        ("not_found", "document.not_found", 1),
        ("upstream", "answer.no_context", 1),
        ("upstream", "new.code", 1),
        ("validation", "query.missing", 2),
    ]
