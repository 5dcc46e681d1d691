import pytest

from depuse.operators.quality import DuplicatePathError, assert_unique_paths, duplicate_paths
from depuse.sources.text import (
    read_rejected_records,
    dependency_record_rejects,
    parse_adjacency,
    parse_dependency_records,
    parse_repository_logs,
    read_dependency_records,
    read_repository_logs,
    repository_log_rejects,
)
from tests.conftest import rows


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


# Cases from the line format: four fields parted by single spaces.
GOOD_LOGS = {
    "0 0 a b": (0, 0, "a", "b"),
    "2147483647 9223372036854775807 gradle/8.1 x": (2147483647, 9223372036854775807, "gradle/8.1", "x"),
    "007 1700000000123 curl é/ü.jar": (7, 1700000000123, "curl", "é/ü.jar"),
    "5 6 tab\there no".replace("\t", "~"): (5, 6, "tab~here", "no"),
}
BAD_LOGS = ["1 2 a", "1  2 a b", "1\t2 a b", " 1 2 a b", "1 2 a b ", "1 2 a b\r", "-1 2 a b", "1 2.5 a b", "x 2 a b", "1 2 a b c"]
GOOD_RECORDS = {
    "12 a/b.pom g:a:1 g:x,g:y": ("a/b.pom", "g:a:1", ["g:x", "g:y"]),
    "99999999999999999999 long g:count NO_DEPS": ("long", "g:count", ["NO_DEPS"]),
    "0 p g ü": ("p", "g", ["ü"]),
}
BAD_RECORDS = ["1 p g", "1 p g d e", "one p g d", "1 p g d\r", "1 p  g d", "1 p g d "]


def test_log_files(spark, tmp_dir):
    path = f"{tmp_dir}/logs.txt"
    with open(path, "w", newline="") as fh:
        fh.write("\n".join([*GOOD_LOGS, *(x for x in BAD_LOGS if "\r" not in x)]) + "\n")
    logs = read_repository_logs(spark, path)
    assert logs.schema.simpleString() == "struct<clientId:int,timestamp:bigint,agent:string,path:string>"
    assert rows(logs) == sorted(GOOD_LOGS.values())


def test_every_malformed_line_is_rejected(spark):
    assert parse_repository_logs(lines(spark, BAD_LOGS)).count() == 0
    assert sorted(r.line for r in repository_log_rejects(lines(spark, [*BAD_LOGS, *GOOD_LOGS])).collect()) == sorted(BAD_LOGS)
    assert parse_dependency_records(lines(spark, BAD_RECORDS)).count() == 0
    assert dependency_record_rejects(lines(spark, [*BAD_RECORDS, *GOOD_RECORDS])).count() == len(BAD_RECORDS)


def test_log_rejects_null_empty_malformed(spark):
    df = lines(spark, [None, "", "client 2 a b", "1 2 a b"])
    assert rows(parse_repository_logs(df)) == [(1, 2, "a", "b")]
    assert repository_log_rejects(df).count() == 3


def test_log_overflow_fails_or_rejects(spark):
    df = lines(spark, ["99999999999 1 a b", "1 2 a b"])
    with pytest.raises(Exception, match="out of range"):
        parse_repository_logs(df).collect()
    assert rows(parse_repository_logs(df, on_overflow="reject")) == [(1, 2, "a", "b")]


def test_record_files(spark, tmp_dir):
    path = f"{tmp_dir}/deps.txt"
    with open(path, "w") as fh:
        fh.write("\n".join(GOOD_RECORDS) + "\n")
    assert rows(read_dependency_records(spark, path)) == sorted(GOOD_RECORDS.values())


def test_adjacency_line_without_dependencies(spark):
    nodes, edges = parse_adjacency(lines(spark, ["a b,c", "lone", "", "  ", "c ,", None]))
    assert rows(nodes) == [("a",), ("b",), ("c",), ("lone",)]
    assert rows(edges) == [("a", "b"), ("a", "c")]


def test_record_extra_field_null_empty_rejected(spark):
    df = lines(spark, [None, "", "1 p g a,b more words", "1 p g a,b"])
    assert rows(parse_dependency_records(df)) == [("p", "g", ["a", "b"])]
    assert dependency_record_rejects(df).count() == 3


def test_dependency_list_split(spark):
    df = lines(spark, ["1 p1 g a,b,,", "1 p2 g ,a", "1 p3 g ,,", "1 p4 g a,,b,a", "1 p5 g b,a,b"])
    got = {r["path"]: r["dependencies"] for r in parse_dependency_records(df).collect()}
    assert got == {"p1": ["a", "b"], "p2": ["", "a"], "p3": [], "p4": ["a", "", "b"], "p5": ["b", "a"]}


def test_duplicated_path_raises(spark, tmp_dir):
    path = f"{tmp_dir}/dup.txt"
    with open(path, "w") as fh:
        fh.write("1 a/b.pom g:a x\n2 a/b.pom g:b y\n3 c/d.pom g:c z\n")
    with pytest.raises(DuplicatePathError, match="a/b.pom"):
        read_dependency_records(spark, path)
    recs = read_dependency_records(spark, path, require_unique_path=False)
    assert rows(duplicate_paths(recs)) == [("a/b.pom", 2)]


def test_unique_paths_pass(spark):
    recs = parse_dependency_records(lines(spark, ["1 a g x", "1 b g y"]))
    assert_unique_paths(recs)


def test_line_numbers_of_rejects_over_many_splits(spark, tmp_dir):
    """Files cut into splits of 200 bytes, several of them read by one task."""
    want = set()
    for name, n, every in (("a", 300, 7), ("b", 1, 1), ("c", 95, 96), ("d", 0, 1), ("e", 120, 1)):
        lines = []
        for k in range(1, n + 1):
            bad = k % every == 0
            lines.append(f"{k} p{k} g{k} d{k}" + " extra" * bad if k % 13 else "")
            if bad or k % 13 == 0:
                want.add((name, k, lines[-1]))
        with open(f"{tmp_dir}/{name}.txt", "w") as fh:
            fh.write("\n".join(lines) + ("\n" if name == "a" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = read_rejected_records(spark, f"{tmp_dir}/*.txt")
        assert spark.read.text(f"{tmp_dir}/*.txt").rdd.getNumPartitions() > 20
        found = {(r.file.rsplit("/", 1)[1][:-4], r.line_number, r.line) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == want
