"""Answers that are asked for once, mail that waits for its tenant, names in any case, ids of any key."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import documents as docfn
from millrace.operators.mutations import numbered
from millrace.sources import extraction, files, invoices
from millrace.streaming import mailroom

T0 = datetime(2024, 1, 1)


def call_log(folder):
    """A call that leaves a file behind for each time it is asked; contents with `bad` fail, with `slow` fail once with a transient error."""

    def call(content: bytes) -> str:
        import os
        import uuid

        seen = [n for n in os.listdir(folder) if n.startswith(content.decode())]
        open(f"{folder}/{content.decode()}-{uuid.uuid4().hex}", "w").close()
        if b"bad" in content or (b"slow" in content and not seen):
            raise (OSError if b"slow" in content else ValueError)("no")
        return f'{{"document": {{"number": "{content.decode()}"}}}}'

    return call


def test_each_content_is_asked_once_and_failures_again_later(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    rows = [("/a", b"one"), ("/b", b"one"), ("/c", b"two"), ("/d", b"bad"), ("/e", b"slow"), ("/f", None)]
    given = spark.createDataFrame(rows, "path string, content binary")
    kept = extraction.answers_table(spark, str(tmp_path / "answers"), 4)
    provider = extraction.asking(call_log(str(asked)), retries=2, first_delay=0.0)
    count = lambda: sorted(p.name.split("-")[0] for p in asked.iterdir())
    run = lambda now, df=given: {r.path: r for r in extraction.ask(df, provider, kept, now, attempts=3, first_delay=60.0).collect()}
    first = run(T0)
    assert count() == ["bad", "one", "slow", "slow", "two"] and len(first) == 6
    assert first["/a"].answer == first["/b"].answer and first["/e"].answer and first["/d"].answer is None and first["/d"].error == "ValueError: no" and first["/f"].digest is None
    before = kept.latest()
    run(T0 + timedelta(seconds=30))  # too early for another try
    assert count() == ["bad", "one", "slow", "slow", "two"] and kept.latest() == before
    run(T0 + timedelta(seconds=61))
    run(T0 + timedelta(seconds=61 + 119))
    assert count().count("bad") == 2
    run(T0 + timedelta(seconds=61 + 121))
    last = run(T0 + timedelta(days=99))
    assert count().count("bad") == 3 and last["/d"].attempts == 3 and last["/a"].attempts == 1
    more = run(T0 + timedelta(days=100), given.union(spark.createDataFrame([("/g", b"two"), ("/h", b"new")], given.schema)))
    assert more["/g"].answer == last["/c"].answer and more["/h"].answer and count().count("two") == 1


def test_transient_failures_are_repeated_with_growing_delays():
    calls, waits = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 4:
            raise OSError("busy")
        return x

    assert files.with_retry(call, 3, 2.0, sleep=waits.append)(7) == 7 and len(calls) == 4
    assert all(1.6 * 2**k <= w <= 2.4 * 2**k for k, w in enumerate(waits))
    with pytest.raises(OSError):
        files.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0, sleep=waits.append)()
    with pytest.raises(ValueError):
        files.with_retry(lambda: (_ for _ in ()).throw(ValueError()), 2, 0.0, sleep=waits.append)()


def test_mail_of_unknown_senders_is_delivered_once_when_they_are_known(spark, tmp_path):
    room = mailroom.mailroom(spark, str(tmp_path / "room"), 4)
    mail = spark.createDataFrame([(k, f"S{k % 4}@m", f"body {k}") for k in range(20)] + [(99, None, "x"), (3, "S3@m", "body 3")], "message_id long, sender string, body string")
    tenants = spark.createDataFrame([(1, "t0", "s0@M"), (2, "t1", "s1@m"), (3, "t2", "s2@m")], "id long, code string, mail_from string")
    assert mailroom.receive(room, mail.where("message_id < 10"), tenants.where("id = 1"), 0) == 0
    assert mailroom.receive(room, mail, tenants.where("id = 1"), 1) == 1
    assert mailroom.receive(room, mail, tenants, 1) is None
    assert mailroom.reroute(room, tenants.where("id <= 2")) == 2 and mailroom.reroute(room, tenants.where("id <= 2")) is None
    assert mailroom.reroute(room, tenants) == 3
    got = {r.message_id: (r.tenant, r.delivered_in, r.body) for r in room.read(room.latest()).collect()}
    assert len(got) == room.read(room.latest()).count() == 21
    assert all(got[k] == (f"t{k % 4}" if k % 4 < 3 else None, {0: 0 if k < 10 else 1, 1: 2, 2: 3, 3: None}[k % 4], f"body {k}") for k in range(20)) and got[99][0] is None
    assert {r.message_id for r in mailroom.delivered(room, 2).collect()} == {k for k in range(20) if k % 4 == 2}


def test_names_in_any_case_and_colons_in_texts(spark):
    text = '{"Document": {"ID": "9", "LINES": [{"Line_Id" : "1", "QUANTITY": 1.5, "description": "\\"id\\": \\"Sender\\":"}], "sender": "Number: x"}, "other": 1}'
    got = spark.createDataFrame([(text,), ("broken {",), (None,)], "t string").select(docfn.parse(F.col("t"), any_case=True).alias("c"), docfn.parse(F.col("t")).alias("d")).collect()
    doc = got[0].c.document
    assert doc.id == "9" and doc.sender == "Number: x" and doc.lines[0].line_id == "1" and float(doc.lines[0].quantity) == 1.5 and doc.lines[0].description == '"id": "Sender":'
    assert got[0].d.document is None and got[2].c is None


def test_ids_tell_all_keys_apart(spark):
    rows = [(None, "5"), ("5", None), ("5|6", None), ("5", "6"), (None, None), ("", None), (None, ""), ("1:a", ""), ("1", ":a"), ("-", None), (None, "-")]
    got = [r.i for r in spark.createDataFrame(rows, "a string, b string").select(invoices.key_digest(F.col("a"), F.col("b")).alias("i")).collect()]
    assert len(set(got)) == len(rows) and None not in got


def test_numbers_follow_a_known_top(spark):
    assert sorted(r.id for r in numbered(spark.range(5).selectExpr("id as v"), ["v"], 41).collect()) == [42, 43, 44, 45, 46]


def test_a_drop_is_listed_by_tasks_and_holds_every_document(spark, tmp_path):
    from millrace.plans import services

    texts = [(k, f"né {k % 50}") for k in range(400)] + [(7, "né 7"), (401, None), (402, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    drop = services._dropped_files(spark, str(tmp_path)).removeprefix("file://")
    found = [p for p in Path(drop).rglob("*") if p.is_file()]
    assert sorted(p.read_bytes() for p in found) == sorted((t + "\n").encode() for _, t in texts if t is not None)
    assert len(list(Path(drop).iterdir())) > int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.threshold"))
    got = services.file_uploads(spark, str(tmp_path))
    assert got.count() == 402 and {r.name for r in got.select("name").distinct().collect()} == set(services._NAMES_OF)


def test_files_are_opened_once(spark, tmp_path, monkeypatch):
    from millrace.plans import services

    spark.createDataFrame([(k, "x" * (k % 9)) for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    opened = spark.sparkContext.accumulator(0)
    plain = services.files.uploads

    def counted(*args):
        def count(batches):
            for batch in batches:
                opened.add(batch.num_rows)
                yield batch

        found = plain(*args)
        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(services.files, "uploads", counted)
    out = services.extracted_documents(spark, str(tmp_path)).collect()
    assert sum(r.files for r in out) == 24 and opened.value == 40


def test_the_driver_holds_no_list_of_dropped_files(spark, tmp_path):
    drop = tmp_path / "a drop"
    for place in ("one.PDF", "b/two.xml", "b/c d/thrée%20.Xml", "b/c d/four", "b/_no/five.xml", "_k=1/six.txt", ".seven.pdf", "b/_eight.pdf", "nine._COPYING_", "b/empty.pdf", "b/_metadata.xml"):
        (drop / place).parent.mkdir(parents=True, exist_ok=True)
        (drop / place).write_bytes(b"" if "empty" in place else place.encode())
    (drop / "nothing").mkdir()
    for k in range(300):
        (drop / f"b/{k}.txt").write_bytes(b"%d" % k)
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(drop))
    got = files.uploads(spark, str(drop))
    rows = lambda df: sorted((r.path, r.length, bytes(r.content)) for r in df.select("path", "length", "content").collect())
    assert rows(got) == rows(plain) and got.count() == 305
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in got.where("kind is not null").collect()} == {"one.PDF": "pdf", "two.xml": "xml", "thrée%20.Xml": "xml"}
    # neither a file nor a part for every few of them is the driver's
    assert plain.inputFiles() and not any("drop" in p for p in got.inputFiles())
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < plain.rdd.getNumPartitions()


def test_paths_that_are_no_folder_are_read_as_before(spark, tmp_path):
    from pyspark.errors import AnalysisException

    for name in ("a.pdf", "b.pdf", "c.xml"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "none").mkdir()
    read = lambda path: sorted(bytes(r.content) for r in files.uploads(spark, str(path)).collect())
    assert read(tmp_path / "a.pdf") == [b"a.pdf"] and read(tmp_path / "*.pdf") == [b"a.pdf", b"b.pdf"] and read(tmp_path / "none") == []
    with pytest.raises(AnalysisException):
        read(tmp_path / "missing")


def test_files_to_extract_are_listed_by_tasks_and_opened_in_few(spark, tmp_path, monkeypatch):
    from millrace.plans import services

    spark.createDataFrame([(k, f"text {k % 90}") for k in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given = []
    plain = services.files.uploads
    monkeypatch.setattr(services.files, "uploads", lambda *args: given.append(plain(*args)) or given[-1])
    out = services.extracted_documents(spark, str(tmp_path)).collect()
    assert sum(r.files for r in out) == 120 and len(given) == 1
    assert not any("/drop/" in p for p in given[0].inputFiles()) and given[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
