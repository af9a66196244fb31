"""CSV batches in many files and folders."""

import gzip

import pytest

from alertsieve.sources import alerts as A

HEADER = "problemId,displayId,title,severityLevel,impactLevel,startTime,endTime,status"


def line(i):
    return f'P{i},D,"t, {i}",ERROR,SERVICES,1700000060000,1700000120000,CLOSED\n'


def test_sub_folders_are_read(spark, tmp_path):
    (tmp_path / "2024" / "01").mkdir(parents=True)
    (tmp_path / "2025").mkdir()
    (tmp_path / "top.csv").write_text(f"{HEADER}\n{line(1)}")
    (tmp_path / "2024" / "01" / "a.csv").write_text(f"{HEADER}\n{line(2)}{line(3)}")
    (tmp_path / "2025" / "b.csv").write_text("title,problemId,note\nreordered,P4,x\n")
    (tmp_path / "2025" / "c.csv.gz").write_bytes(gzip.compress(f"{HEADER}\n{line(5)}".encode()))
    (tmp_path / "2025" / "empty.csv").write_text("")
    (tmp_path / "2025" / "_hidden.csv").write_text("problemId\nP9\n")
    rows = {r.problemId: r for r in A.read_alerts_csv(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["P1", "P2", "P3", "P4", "P5"]
    assert rows["P4"].title == "reordered" and rows["P4"].note == "x" and rows["P4"].severityLevel is None
    assert rows["P5"].title == "t, 5" and rows["P5"].startTime is not None
    one = A.read_alerts_csv(spark, str(tmp_path / "2024"))
    assert sorted(r.problemId for r in one.collect()) == ["P2", "P3"]


def test_nothing_found_raises(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for path in (tmp_path / "deep", tmp_path / "none", f"{tmp_path}/*.csv"):
        with pytest.raises(FileNotFoundError):
            A.read_alerts_csv(spark, str(path))


def test_headers_cost_no_job_a_file(spark, tmp_path):
    """Spark jobs grow with the number of different headers, not of files."""
    for i in range(300):
        folder = tmp_path / f"d{i % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.csv").write_text(f"{HEADER}\n{line(i)}")
    tracker = spark.sparkContext.statusTracker()

    def jobs(path):
        spark.sparkContext.setJobGroup("csv-headers", "", False)
        before = set(tracker.getJobIdsForGroup("csv-headers"))
        groups = A._csv_headers(spark, str(path), False)
        after = set(tracker.getJobIdsForGroup("csv-headers")) - before
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(after), groups

    n, groups = jobs(tmp_path)
    assert [len(f) for f in groups.values()] == [300] and n <= 6
    assert A.read_alerts_csv(spark, str(tmp_path)).select("problemId").distinct().count() == 300


def test_header_records():
    assert A._header_text(b"a,b\r\n1,2") == b"a,b"
    assert A._header_text(b'"a\nx",b\n1,2') == b'"a\nx",b'
    assert A._header_text(b"a,b") == b"a,b"
    assert A._header_text(b"x" * A.HEADER_BYTES) is None


def test_quoted_line_breaks_and_same_first_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('problemId,"ti\ntle"\nP1,"one\ntwo"\n')
    (tmp_path / "b.csv").write_text('problemId,"ti\nmes"\nP2,x\n')
    groups = A._csv_headers(spark, str(tmp_path), True)
    assert sorted(groups) == [("problemId", "ti\nmes"), ("problemId", "ti\ntle")]
