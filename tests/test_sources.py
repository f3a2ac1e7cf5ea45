import io
import json
import zipfile

import pytest

from loomwright.sources import readers, sinks


def test_records_keep_line_numbers_and_reasons(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n\nnot json\n[1]\n{"id": "y", "id": "z"}\n')
    rows = readers.read_records(spark, str(tmp_path / "a.jsonl"), "id string").orderBy("line").collect()
    assert [(r.line, r.record.id if r.record else None, r.reason) for r in rows] == [
        (1, "x", None),
        (3, None, "invalid JSON or repeated key"),
        (4, None, "not an object"),
        (5, None, "invalid JSON or repeated key"),
    ]


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long").count() == 2


def test_csv_cells_may_hold_lines_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), ["id", "text"]).collect()] == [
        ("1", 'two\nlines, "quoted"')
    ]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, count in (("a.jsonl", 400), ("b.jsonl", 90)):
        (tmp_path / name).write_text("".join('{"id": "%s%d"}\n' % (name, n) if n % 5 else "\n" for n in range(1, count + 1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.read_records(spark, str(tmp_path), "id string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == 392 and all(r.record.id == f"{r.file}{r.line}" and r.reason is None for r in rows)


def test_folders_are_listed_in_order(spark):
    df = spark.createDataFrame([("kb/b.md",), ("kb/a/x.md",), ("kb/a/y.md",), ("other",)], "p string")
    assert [r.entry for r in readers.list_dir(df, "p", "kb").collect()] == ["a/", "b.md"]
    assert [r.entry for r in readers.list_dir(df, "p", "").collect()] == ["kb/", "other"] and [r.entry for r in readers.list_dir(df, "p", "", 1).collect()] == ["kb/"]


def test_positional_csv_keeps_commas_of_the_title(spark, tmp_path):
    (tmp_path / "a.csv").write_text("7,One, two, three,http://x,1999\nbroken\n")
    assert [tuple(r) for r in readers.read_positional_csv(spark, str(tmp_path / "a.csv")).collect()] == [
        ("7", "One, two, three", "http://x", "1999", None), (None, "broken", None, None, "fewer than four fields")
    ]


def test_text_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.txt").write_text("böse")
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "a.md").write_text("no")
    rows = readers.read_text_tree(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", "x"), ("b", "böse")]


def test_html_hides_scripts_and_parts_blocks(spark):
    page = "<nav>menu<script>x</script></nav><p>One &amp; two</p><script>var x = '</p>'</script><p>three<br>four</p><!-- no -->"
    assert readers.html_to_text(page) == "One & two\n\nthree\n\nfour"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    assert {r.key: r.text for r in readers.html_text(df, "id", "html").collect()} == {
        1: "One & two\n\nthree\n\nfour",
        2: None,
        3: "",
    }


def test_stories_in_four_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfplain")
    (tmp_path / "b.html").write_text("<p>page</p>")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr(
            "o/p.opf",
            '<package><manifest><item id="1" href="1.html"/><item id="2" href="2.html"/><item id="3" href="3.html"/></manifest>'
            '<spine><itemref idref="2"/><itemref idref="1"/><itemref idref="3" linear="no"/></spine></package>',
        )
        for n in "123":
            z.writestr(f"o/{n}.html", f"<p>chapter {n}</p>")
    (tmp_path / "c.epub").write_bytes(book.getvalue())
    (tmp_path / "d.epub").write_bytes(b"broken")
    rows = {r.id: r for r in readers.read_stories(spark, str(tmp_path)).collect()}
    assert (rows["a"].text, rows["b"].text, rows["c"].text) == ("plain", "page", "chapter 2\n\nchapter 1")
    assert rows["d"].text is None and rows["d"].reason


def test_prefix_ends_at_the_first_bad_line(spark):
    df = spark.createDataFrame(
        [("t", 1, "{}"), ("t", 2, '{"a"'), ("t", 3, "{}"), ("u", 1, "{}")], "trace string, n int, raw string"
    )
    rows = readers.valid_prefix(df, "trace", "n", "raw").collect()
    assert sorted((r.trace, r.n) for r in rows) == [("t", 1), ("u", 1)]


def test_latest_attempt_and_history(spark):
    df = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "ok"), ("b", 1, "started")], "id string, n int, status string")
    rows = {r.id: (r.status, list(r.history)) for r in readers.latest_attempts(df, "id", ["n"]).collect()}
    assert rows == {"a": ("ok", ["failed", "ok"]), "b": ("started", ["started"])}


def test_checked_join_tells_the_rest(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, sha string")
    b = spark.createDataFrame([(1, "x"), (2, "changed")], "id int, sha string")
    met, rest = readers.checked_join(a, b, ["id", "sha"])
    assert met.count() == 1 and [r.id for r in rest.collect()] == [2]


def test_requests_resume_anywhere(spark):
    whole = readers.requests(spark, 0, 100, 6, 5, 2).collect()
    part = readers.requests(spark, 40, 20, 6, 5, 2).collect()
    assert sorted(map(tuple, whole))[40:60] == sorted(map(tuple, part))


def test_sinks_refuse_and_append_once(spark, tmp_path):
    df = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "hash string, body string")
    path = str(tmp_path / "artifacts")
    assert sinks.put_artifacts(df, path) == 2
    assert sinks.put_artifacts(df, path) == 0
    sinks.save_json(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.save_json(df, str(tmp_path / "out"))


def test_reviews_keep_human_fields_of_equal_content(spark):
    old = spark.createDataFrame([(1, "same", "good"), (2, "old", "bad"), (3, "gone", "ok")], "id int, text string, human string")
    new = spark.createDataFrame([(1, "same"), (2, "new"), (4, "added")], "id int, text string")
    rows = {r.id: r for r in sinks.merged_reviews(old, new, "id", "text", ["human"]).collect()}
    assert {k: (r.text, r.human) for k, r in rows.items()} == {
        1: ("same", "good"),
        2: ("new", None),
        3: ("gone", "ok"),
        4: ("added", None),
    }
    assert json.loads(rows[2].archived) == {"id": 2, "text": "old", "human": "bad"}


def test_two_commits_on_one_head(spark):
    df = spark.createDataFrame(
        [("l", None, "a"), ("l", "a", "b"), ("l", "a", "c"), ("l", "a", "c")], "lineage string, parent string, commit string"
    )
    assert [tuple(r) for r in sinks.commit_conflicts(df).collect()] == [("l", "a", 2)]


def test_markdown_report(spark):
    df = spark.createDataFrame([("b", 2), ("a", None)], "g string, n int")
    assert sinks.markdown_report(df, ["g"]) == "| g | n |\n|-|-|\n| a |  |\n| b | 2 |"
