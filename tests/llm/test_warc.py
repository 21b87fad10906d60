import base64
import hashlib

import pytest

from framelake.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.fixture(params=["2000", "128m"])
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip_with_version_lines_in_payloads(spark, splits, tmp_path):
    rows = [(1, "u", "x"), (2, None, None), (3, " a b\n", "x"), (4, "u", FAKE + "tail"), (5, "u", FAKE * 3), (None, "u", "n"), (7, "u", "é" * 50 + FAKE), (8, "u", FAKE + "tail"), (9, "u", ""), (10, "u", "WARC/1.1\r\n"), (11, "u", "\r\n\r\n"), (12, "", "q" * 9000)]
    rows += [(100 + i, "u", "q" * i + FAKE * (i % 3)) for i in range(1, 60)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    text = {i: h or "" for i, _, h in rows}
    for i, h in text.items():
        last = max(j or 0 for j, other in text.items() if other == h)
        if i == last or i is None:
            assert (got[i].record_type, got[i].payload, got[i].refers_to) == ("response", h, None)
        else:
            assert (got[i].record_type, got[i].refers_to) == ("revisit", last)
        assert got[i].digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert got[3].target_uri == "a%20b" and got[2].target_uri is None


def test_a_broken_chain_ends_the_file(spark, tmp_path):
    good = FAKE.replace("abc", "one")
    (tmp_path / "a.warc").write_bytes((good + "WARC/1.1\r\nno length\r\n\r\n" + good).encode())
    assert [r.offset for r in warc.read_warc(spark, str(tmp_path)).collect()] == [0]


def test_broken_chains_are_named_with_their_offsets(spark, tmp_path):
    """A chain that breaks in the middle, one that never starts, one cut off in its last record, whole files and an empty one."""
    good = FAKE.replace("abc", "one")
    middle = good + "WARC/1.1\r\nno length\r\n\r\n" + good
    for name, text in (("middle", middle), ("never", "junk " + good), ("short", good + good[:-9]), ("whole", good * 3), ("empty", "")):
        (tmp_path / f"{name}.warc").write_bytes(text.encode())
    records, errors = warc.read_archives(spark, str(tmp_path))
    found = {r.file.rsplit("/", 1)[1]: (r.offset, r.left) for r in errors.collect()}
    n, m = len(good.encode()), len(middle.encode())
    assert found["middle.warc"] == (n, m - n) and found["never.warc"] == (0, n + 5) and "whole.warc" not in found and "empty.warc" not in found
    assert found["short.warc"][0] in (n, 2 * n) and len(found) == 3
    assert sum(r.file.endswith("whole.warc") for r in records.select("file").collect()) == 3


def test_an_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string, _id int"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_query_of_repeated_ids_and_payloads(spark, tmp_path):
    """Two rows of one payload share the largest id: both are responses, and the others refer to it."""
    rows = [(9, "u", "same"), (9, "v", "same"), (3, "u", "same"), (None, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", "own")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.op2_warc(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(9, 4, "response", None), (9, 4, "response", None), (3, 4, "revisit", 9), (None, 4, "revisit", 9), (4, 0, "revisit", 5), (5, 0, "response", None), (6, 3, "response", None)], key=repr)
