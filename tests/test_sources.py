import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import documents as docfn
from millrace.operators.mutations import keyed_replace, numbered
from millrace.sources import files, invoices
from millrace.api import Workspace
from millrace.sources.tables import Conflict, Versions, scope, shared_dir
from millrace.streaming import ingest

LINE = "<DettaglioLinee><NumeroLinea>{n}</NumeroLinea>{codes}<Descrizione>d</Descrizione>{quantity}<PrezzoTotale>3.5</PrezzoTotale><AliquotaIVA>22.00</AliquotaIVA></DettaglioLinee>"
CODE = "<CodiceArticolo><CodiceTipo>T</CodiceTipo><CodiceValore>{}</CodiceValore></CodiceArticolo>"
BODY = "<FatturaElettronicaBody><DatiGenerali><DatiGeneraliDocumento><Data>2024-03-01</Data><Numero>{number}</Numero>{total}</DatiGeneraliDocumento></DatiGenerali><DatiBeniServizi>{lines}</DatiBeniServizi></FatturaElettronicaBody>"
HEAD = "<FatturaElettronicaHeader><CedentePrestatore><DatiAnagrafici><Anagrafica><Denominazione>Acme</Denominazione></Anagrafica></DatiAnagrafici></CedentePrestatore></FatturaElettronicaHeader>"


def invoice(*bodies):
    return f'<?xml version="1.0"?><p:FatturaElettronica xmlns:p="urn:x">{HEAD}{"".join(bodies)}</p:FatturaElettronica>'


def test_xml_invoices(spark):
    two = LINE.format(n=1, codes=CODE.format("A") + CODE.format("B"), quantity="<Quantita>2.50</Quantita>") + LINE.format(n=2, codes="", quantity="")
    text = invoice(BODY.format(number="7", total="<ImportoTotaleDocumento>9.5</ImportoTotaleDocumento>", lines=two), BODY.format(number="8", total="", lines=LINE.format(n=1, codes="", quantity="")))
    df = spark.createDataFrame([("f.xml", text)], "source string, xml string")
    first = invoices.documents(df).collect()
    assert len(first) == 1
    doc = first[0]
    assert (doc.sender, doc.number, doc.date, doc.type, doc.total) == ("Acme", "7", "2024-03-01", "4", 9.5)
    assert [(x.line_id, x.code, x.quantity and float(x.quantity), float(x.taxable), x.master_id == doc.id) for x in doc.lines] == [("1", "A", 2.5, 0.0, True), ("2", "", None, 0.0, True)]
    both = invoices.documents(df, all_bodies=True).orderBy("number").collect()
    assert [(d.number, d.total) for d in both] == [("7", 9.5), ("8", 0.0)]


def test_xml_invoice_lines_are_made_once(spark, tmp_path):
    """Rows are shuffled as the tables have them, and an id's digest is made once for a document; explode would count the lines of a list that it makes twice."""
    from millrace.plans.catalog import QUERIES

    spark.sql("SELECT cast(1 as long) o_orderkey, cast(2 as long) o_custkey, 'O' o_orderstatus, 7.5D o_totalprice, timestamp_ntz'1995-01-02' o_orderdate, '1-URGENT' o_orderpriority UNION ALL SELECT 2, 2, 'O', 0.0D, timestamp_ntz'1995-01-03', '1-URGENT'").write.parquet(str(tmp_path / "orders.parquet"))
    line = "SELECT cast({} as long) l_orderkey, cast({} as long) l_partkey, cast(4 as long) l_suppkey, {} l_linenumber, {}D l_quantity, 2.0D l_extendedprice, 0.0D l_discount, 0.0D l_tax, 'N' l_returnflag, 'O' l_linestatus, timestamp_ntz'1995-02-02' l_shipdate"
    # order 2 has no line, and the lines of order 3 have no order
    spark.sql(" UNION ALL ".join(line.format(*x) for x in ((1, 30, 2, 5.0), (1, 31, 1, 6.0), (1, 29, 2, 5.0), (3, 30, 1, 5.0)))).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["xml_invoice_lines"](spark, str(tmp_path))
    assert sorted((r.number, r.line_id, r.code, r.quantity, r.sender, r.total) for r in out.collect()) == [("1", "1", "31", 6.0, "2", 7.5), ("1", "2", "29", 5.0, "2", 7.5), ("1", "3", "30", 5.0, "2", 7.5)]
    plan = QUERIES["xml_invoice_lines"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    shuffled = plan[plan.rindex("Exchange hashpartitioning(l_orderkey") :]
    assert plan.count("sha2(") == 1 and "collect_list" not in shuffled and "concat_ws" not in shuffled


def test_files_by_extension(spark, tmp_path):
    for name in ("a.PDF", "b.xml", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, bytes(r.content)) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": ("pdf", b"x"), "b.xml": ("xml", b"x"), "c.txt": (None, b"x")}


def test_json_content_drops_unknown_keys(spark):
    text = json.dumps({"tipo": 1, "document": {"id": "9", "sender": None, "lines": [{"line_id": "1", "quantity": 1.5}]}})
    df = spark.createDataFrame([(text,), ("not json",)], "t string")
    got = df.select(docfn.parse(F.col("t")).alias("c"), docfn.path(F.col("t"), "document", "id").alias("id"), docfn.path(F.col("t"), "document", "sender").alias("s")).collect()
    assert got[0].id == "9" and got[0].s is None and float(got[0].c.document.lines[0].quantity) == 1.5


def test_a_tenant_reads_its_own_buckets(spark, tmp_path):
    rows = spark.range(400).selectExpr("id", "concat('t', id % 40) as tenant", "'x' as description")
    versions = Versions(spark, str(tmp_path / "t"), ["tenant", "id"], (8, 2))
    versions.append(rows, None)
    every, own = versions.read(0), versions.read(0, versions.group_of("t7"))
    assert len(own.inputFiles()) <= 2 < 8 < len(every.inputFiles()) and own.where("tenant = 't7'").count() == 10 and every.count() == 400
    one = versions.read(0, versions.buckets_of(spark.createDataFrame([("t7", 47)], "tenant string, id long")))
    assert len(one.inputFiles()) == 1 and one.where("id = 47").count() == 1
    w = Workspace(spark, str(tmp_path / "w"), "a", (8, 2))
    for tenant in "abcdefgh":
        Workspace(spark, w.folder, tenant, (8, 2)).add("suppliers", rows.select("description").limit(20), ["description"])
    assert len(w.rows("suppliers").inputFiles()) < len(w.table("suppliers").inputFiles()) and w.rows("suppliers").count() == 20


def test_a_change_writes_only_the_buckets_it_touches(spark, tmp_path):
    schema = STATE
    state = spark.createDataFrame([(k, f"t{k % 9}", f"s{k}", "1", "d", "4", 0, 1.0) for k in range(2000)], schema)
    versions = ingest.keyed_versions(spark, str(tmp_path / "state"), (16, 16))
    versions.append(state, None)
    batch = spark.createDataFrame([(f"t{k % 9}", f"s{k}", "1", "d", "4", 0, 9.0, k) for k in range(10)], schema.replace("id long, ", "") + ", arrival int")
    ingest.merge_batch(versions, batch, 0, state.limit(0), "s")
    before, after = (versions.manifest(v)["buckets"] for v in (0, 1))
    assert 1 <= sum(before[b] != after[b] for b in before) <= 10 and len(before) > 100
    final = versions.read(1)
    assert final.count() == 2000 and final.where("total = 9").count() == 10 and versions.top(1) == 2009


def test_added_rows_join_buckets_until_these_are_many_pieces(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "log"), ["id"], (2, 1))
    base = versions.append(spark.range(4), None)
    for k in range(1, 13):
        base = versions.append(spark.range(4 * k, 4 * k + 4), base, add=True)
    assert sorted(r.id for r in versions.read(base).collect()) == list(range(52)) and versions.top(base) == 51
    assert max(len(p) for p in versions.manifest(base)["buckets"].values()) <= Versions.PIECES


STATE = "id long, tenant string, sender string, number string, date string, type string, state int, total double"


def test_stream_equals_batch(spark, tmp_path):
    incoming = spark.createDataFrame([("t", f"s{k % 7}", "1", "d", "4", 0, float(k), k) for k in range(50)], STATE.replace("id long, ", "") + ", arrival int")
    source, empty = str(tmp_path / "drop"), spark.createDataFrame([], STATE)

    def run():
        ingest.ingest(spark, source, incoming.schema, lambda df: df, empty, str(tmp_path / "state"), str(tmp_path / "checkpoint"), every=None, files=1).awaitTermination()

    incoming.where("arrival < 30").coalesce(1).write.mode("append").parquet(source)
    run()
    incoming.where("arrival >= 30").coalesce(1).write.mode("append").parquet(source)
    run()
    versions = Versions(spark, str(tmp_path / "state"))
    content = lambda df: sorted((r.sender, r.total) for r in df.collect())
    final = versions.read(versions.latest())
    assert content(final) == content(keyed_replace(empty, incoming).state)
    before, name = versions.latest(), str(tmp_path / "checkpoint")
    assert ingest.merged_batch(versions, name) == 1
    ingest.merge_batch(versions, incoming.where("arrival >= 30"), 1, empty, name)  # delivered again
    assert versions.latest() == before and content(versions.read(before)) == content(keyed_replace(empty, incoming).state)
    # a new checkpoint begins again at batch 0, upon the state that is there
    ingest.merge_batch(versions, incoming.where("arrival = 3").withColumn("sender", F.lit("other")), 0, empty, "another")
    assert content(versions.read(versions.latest())) == sorted([*content(keyed_replace(empty, incoming).state), ("other", 3.0)])


def test_retention_is_not_undone_by_the_next_batch(spark, tmp_path):
    schema = STATE + ", created timestamp_ntz"
    versions, empty = Versions(spark, str(tmp_path / "state")), spark.createDataFrame([], schema)
    incoming = spark.createDataFrame([("t", s, "1", "d", "4", 1, 1.0, datetime(2020, 1, 1), k) for k, s in enumerate("ab")], schema.replace("id long, ", "") + ", arrival int")
    ingest.merge_batch(versions, incoming.where("sender = 'a'"), 0, empty, "s")
    ingest.retention_job(versions, F.lit("2021-01-01").cast("timestamp_ntz"))
    ingest.merge_batch(versions, incoming.where("sender = 'b'"), 1, empty, "s")
    assert [r.sender for r in versions.read(versions.latest()).collect()] == ["b"]


def test_of_two_writers_one_fails(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "state"))
    one = spark.range(1)
    assert versions.latest() is None and versions.append(one, None, "a") == 0
    for owner in ("a", "b"):
        with pytest.raises(Conflict):
            versions.append(spark.range(5), None, owner)
    assert versions.read(0).count() == 1 and versions.owner(0) == "a"
    assert versions.append(one, 0, "b") == 1
    with pytest.raises(Exception):  # noqa: B017
        versions.append(one.selectExpr("raise_error('no')"), 1, "c")
    assert versions.append(one, 1, "d") == 2


def test_dead_and_late_writers_block_nothing(spark, tmp_path, monkeypatch):
    folder = tmp_path / "state"
    versions = Versions(spark, str(folder))
    versions.append(spark.range(3), None, "first")
    # one dies after its rows and before its version; another leaves a torn file
    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            versions.append(spark.range(9), 0, "dead")
    (folder / "data" / "orphan").mkdir()
    (folder / "_versions" / ".torn").write_text('{"owner"')
    again = Versions(spark, str(folder))  # after a restart
    assert again.latest() == 0 and again.append(spark.range(5), 0, "second") == 1
    # a writer that read version 0 comes back late
    with pytest.raises(Conflict, match="second"):
        versions.append(spark.range(7), 0, "late")
    assert versions.latest() == 1 and versions.read(1).count() == 5
    assert again.vacuum(keep=2) == [] and again.vacuum(keep=2, idle_seconds=0) == ["orphan"]
    again.append(spark.range(6), 1)
    assert len(again.vacuum(keep=1, idle_seconds=0)) == 2 and again.read(again.latest()).count() == 6
    assert sorted(p.name for p in (folder / "_versions").iterdir() if not p.name.startswith(".")) == ["2"]


def test_of_two_retention_jobs_one_counts(spark, tmp_path):
    schema = STATE + ", created timestamp_ntz"
    rows = [(k, "t", f"s{k}", "1", "d", "4", k % 2, 1.0, datetime(2020, 1, 1)) for k in range(40)]
    versions = ingest.keyed_versions(spark, str(tmp_path / "state"))
    versions.append(spark.createDataFrame(rows, schema), None)
    other = ingest.keyed_versions(spark, str(tmp_path / "state"))
    as_of = F.lit("2021-01-01").cast("timestamp_ntz")
    other.latest = lambda: 0  # it read the same version and writes later
    assert ingest.retention_job(versions, as_of) == 1
    with pytest.raises(Conflict):
        ingest.retention_job(other, as_of)
    assert versions.latest() == 1 and versions.read(1).count() == 20


def test_recorded_answers(spark):
    got = files.contents(files.extract(spark.createDataFrame([("/x/a.pdf", b"1"), ("/x/b.pdf", b"2")], "path string, content binary"), files.recorded({"a.pdf": '{"document": {"number": "7"}}'}), files.EXTRACTED))
    assert [(r.path, r.content.document.number) for r in got.collect()] == [("/x/a.pdf", "7")]


def test_a_scope_deletes_the_tables_made_in_it(spark):
    with scope():
        one = numbered(spark.range(9).selectExpr("id as v"), ["v"], 0)
        kept = one.count()
        left = [f.removeprefix("file:") for f in one.inputFiles()]
        assert left and all(os.path.exists(f.removeprefix("//")) for f in left)
    assert kept == 9 and not any(os.path.exists(f.removeprefix("//")) for f in left)


def test_a_shared_folder_is_asked_for(spark):
    assert shared_dir(spark).startswith("file:")
