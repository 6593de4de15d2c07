import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from hopboard.llm.warc import list_files, member, page_facts, page_records, read_warc, record_bytes, write_warc

PAGES = [
    (1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, None, "x" * 999), (4, "http://c/\r\nEvil: 1", "x" * 999),
    (5, "http://d/", None), (6, "http://e/", ""), (7, "http://f/é", "é" * 500), (8, "", "é" * 500), (8, "", "é" * 500),
    (None, "http://g/", "x" * 1000), (None, "http://h/", "z" * 2000), (None, "http://h/", "z" * 2000), (9, "http://i/", "y" * 3_000_000),
]


@pytest.fixture
def archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    frame = spark.createDataFrame([(*page, "clash") for page in PAGES], "page_id long, url string, html string, payload string")
    write_warc(page_records(frame.repartition(3)), path)
    return path


def test_pages_come_back(spark, archive):
    got = sorted((tuple(row) for row in page_facts(read_warc(spark, archive)).collect()), key=str)
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [other for other, _, text in PAGES if (text or "") == (html or "") and other is not None] if len(data) >= 1000 else []
        revisit = bool(same) and page_id != max(same)
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_payloads_and_headers_are_whole(spark, archive):
    rows = {(row["record_id"], row["record_type"]): row for row in read_warc(spark, archive).collect()}
    assert bytes(rows["<urn:page:9>", "response"]["payload"]) == b"y" * 3_000_000
    assert rows["<urn:page:4>", "response"]["target_uri"] == "http://c/%0D%0AEvil: 1"
    assert rows["<urn:page:3>", "response"]["target_uri"] is None
    revisit = rows["<urn:page:1>", "revisit"]
    assert revisit["payload"] is None and revisit["payload_length"] == 1000 and revisit["refers_to"] == "<urn:page:2>"


@pytest.mark.parametrize("condition", [
    "record_type = 'revisit'", "record_type IN ('response', 'warcinfo')", "target_uri IS NULL", "target_uri LIKE 'http://%'",
    "content_length > 1000", "record_type <> 'response'", "target_uri IS NOT NULL AND content_length <= 1200", "NOT (target_uri LIKE '%a/')",
    "record_type NOT IN ('revisit')", "payload_length = 1000 OR record_type = 'warcinfo'", "target_uri <=> NULL",
])
def test_pushed_filters_select_as_spark_does(spark, archive, condition):
    read = lambda: read_warc(spark, archive, payload=False)
    every = spark.createDataFrame(read().collect(), read().schema)
    key = lambda frame: sorted(map(str, frame.select("record_id", "offset", "file").collect()))
    assert key(read().where(condition)) == key(every.where(condition))


def test_filters_reach_the_source(spark, archive):
    plan = read_warc(spark, archive).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_unwanted_payloads_are_not_decoded(spark, archive):
    assert read_warc(spark, archive, payload=False).where(F.col("payload").isNotNull()).count() == 0


def test_only_listed_files_count(spark, archive, tmp_path):
    before = read_warc(spark, archive).count()
    (tmp_path / "archive" / "part-left-over.warc.gz").write_bytes(b"not finished")
    assert read_warc(spark, archive).count() == before
    write_warc(page_records(spark.createDataFrame([(77, "u", "h")], "page_id long, url string, html string")), archive)
    assert read_warc(spark, archive).where("record_id = '<urn:page:77>'").count() == 1
    assert read_warc(spark, archive).count() > before


def records(n=5):
    return [record_bytes({"record_type": "response", "record_id": f"<r{i}>", "payload": bytes([65 + i]) * (i * 40_000), "date": "d"}) for i in range(n)]


@pytest.mark.parametrize("name, data", [
    ("plain.warc", b"".join(records())),
    ("foreign.warc.gz", b"".join(gzip.compress(record) for record in records())),
    ("own.warc.gz", b"".join(member(record, 6) for record in records())),
])
@pytest.mark.parametrize("payload", [True, False])
def test_other_archives(spark, tmp_path, name, data, payload):
    path = tmp_path / name
    path.write_bytes(data)
    rows = read_warc(spark, str(path), payload).orderBy("offset").collect()
    assert [row["record_id"] for row in rows] == [f"<r{i}>" for i in range(5)]
    assert [len(row["payload"]) if payload else row["payload"] for row in rows] == [i * 40_000 if payload else None for i in range(5)]
    assert read_warc(spark, str(path)).where("record_id = '<r3>'").collect()[0]["payload"] == b"D" * 120_000


@pytest.mark.parametrize("data", [
    gzip.compress(b"".join(records())),
    gzip.compress(b"".join(records()[:2])) + gzip.compress(b"".join(records()[2:])),
    member(b"".join(records()), 6),
    member(records()[0], 6) + gzip.compress(b"".join(records()[1:4])) + member(records()[4], 6) + gzip.compress(b""),
    gzip.compress(b"\r\n" + b"\r\n".join(records()).rstrip(b"\r\n")),
])
@pytest.mark.parametrize("payload", [True, False])
def test_members_of_several_records(spark, tmp_path, data, payload):
    path = tmp_path / "several.warc.gz"
    path.write_bytes(data)
    read = lambda: read_warc(spark, str(path), payload)
    rows = sorted(read().collect(), key=lambda row: row["record_id"])
    assert [row["record_id"] for row in rows] == [f"<r{i}>" for i in range(5)]
    assert [row["payload"] for row in rows] == [bytes([65 + i]) * (i * 40_000) if payload else None for i in range(5)]
    assert [row["record_id"] for row in read().where("record_id IN ('<r1>', '<r4>')").orderBy("record_id").collect()] == ["<r1>", "<r4>"]
    assert read().where("record_type = 'request'").count() == 0


@pytest.mark.parametrize("data", [
    gzip.compress(records()[0] + b"left over"), gzip.compress(b"".join(records()))[:-30], member(records()[3], 6)[:-9] + b"123456789",
])
def test_left_over_bytes_raise(spark, tmp_path, data):
    (tmp_path / "bad.warc.gz").write_bytes(data)
    with pytest.raises(Exception, match="bad.warc.gz at 0"):
        read_warc(spark, str(tmp_path / "bad.warc.gz")).collect()


def test_cut_off_plain_record_raises(spark, tmp_path):
    (tmp_path / "bad.warc").write_bytes(records()[1][:-1000])
    with pytest.raises(Exception, match="truncated record"):
        read_warc(spark, str(tmp_path / "bad.warc")).collect()


@pytest.mark.parametrize("block, payload", [
    (b"HTTP/1.1 200 OK\r\nA: b", b"HTTP/1.1 200 OK\r\nA: b"), (b"HTTP/1.1 200 OK\r\n\r\n", b""), (b"HTTP/1.1 200 OK\r\n\r\nx\r\n\r\ny", b"x\r\n\r\ny"), (b"", b""),
])
def test_payload_of_odd_responses(spark, tmp_path, block, payload):
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block)
    (tmp_path / "odd.warc").write_bytes(head + block + b"\r\n\r\n")
    assert read_warc(spark, str(tmp_path / "odd.warc")).first()["payload"] == payload


def test_a_payload_of_many_pages_is_not_brought_to_one_task(spark):
    """Pages of a payload that is frequent among repeated ones are joined where they are."""
    rows = [(i, "u", ("x" if i % 3 else f"{i // 6}") * 1200) for i in range(90)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    found = page_records(frame)
    assert found.where("record_type = 'revisit'").count() == sum(1 for i, _, html in rows if i != max(j for j, _, other in rows if other == html))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


@pytest.mark.parametrize("data", [b"\x1f\x8b\x08broken", b"HTTP/1.1 200 OK\r\n\r\n", member(records(2)[1], 6)[:-20]])
def test_broken_records_raise(spark, tmp_path, data):
    (tmp_path / "bad.warc.gz").write_bytes(data)
    with pytest.raises(Exception, match="bad.warc.gz at 0"):
        read_warc(spark, str(tmp_path / "bad.warc.gz")).collect()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_warc(page_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert page_facts(read_warc(spark, path)).count() == 0


def test_files_share_partitions(tmp_path):
    from hopboard.llm.warc import WarcReader

    for i in range(6):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * 100)
    assert [len(p.files) for p in WarcReader(str(tmp_path), True, 250).partitions()] == [2, 2, 2]
    assert [len(p.files) for p in WarcReader(str(tmp_path), True, 50).partitions()] == [1] * 6
    assert len(list_files(str(tmp_path))) == 6


def test_partitions_shrink_where_there_are_cores(tmp_path, monkeypatch):
    from hopboard.llm import warc

    monkeypatch.setattr(warc, "SMALLEST_PARTITION", 150)
    for i in range(8):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * 100)
    sizes = lambda cores: [len(p.files) for p in warc.WarcReader(str(tmp_path), True, 10_000, cores).partitions()]
    assert sizes(1) == [8] and sizes(4) == [2, 2, 2, 2] and sizes(1000) == [1] * 8
