from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_sources import BODY, CODE, LINE, invoice

from millrace.api import Workspace, health
from millrace.sources.tables import Conflict, Versions

NOW = datetime(2024, 3, 2)


def test_workspace_from_import_to_clean(spark, tmp_path):
    assert health(spark)
    with pytest.raises(ValueError):
        Workspace(spark, str(tmp_path), " ")
    w = Workspace(spark, str(tmp_path / "w"), "t")
    assert "docs" in w.initialise() and w.initialise() == []
    created = F.lit(NOW).cast("timestamp_ntz")
    lines = LINE.format(n=1, codes=CODE.format("A1"), quantity="<Quantita>2</Quantita>")
    files = spark.createDataFrame([(f"{k}.xml", invoice(BODY.format(number=str(k), total="", lines=lines))) for k in (1, 2)], "source string, xml string")
    assert w.import_invoices(files, created).rejected.count() == 0
    docs = w.documents().orderBy("id").collect()
    assert [(d.id, d.content.document.number) for d in docs] == [(1, "1"), (2, "2")]
    w.import_invoices(files.limit(1), created)
    assert w.documents().count() == 2
    first = w.documents(number="2").first().content.document.id
    w.append_line(first, {"line_id": "9", "code": "Z"})
    w.replace_line(first, {"line_id": "1", "code": "B"})
    assert sorted(r.code for r in w.document_lines(number="2").collect()) == ["B", "Z"]
    w.remove_line(first, "9")
    assert [r.code for r in w.document_lines(number="2").collect()] == ["B"]
    w.update_master_data(created)
    assert [r.description for r in w.rows("suppliers").collect()] == ["Acme"]
    assert [r.code for r in w.articles_of("ACME").orderBy("code").collect()] == ["A1", "B"]
    w.toggle_state(first, "Open")
    assert w.documents().count() == 1 and w.documents(state=1).count() == 1
    w.set_type(first, 5)
    assert w.documents(state=-1, kind=5).count() == 1
    refused = w.import_invoices(files, created).rejected
    assert refused.count() == 0  # the key holds the type, which was changed
    w.clean(F.lit(datetime(2024, 9, 1)).cast("timestamp_ntz"))
    assert w.documents(state=1).count() == 0 and Workspace(spark, str(tmp_path / "w"), "u").documents(state=-1).count() == 0
    w.remove_document(number="1")
    assert w.documents(state=-1, number="1").count() == 0


def test_a_workspace_notices_another_writer(spark, tmp_path):
    one, two = (Workspace(spark, str(tmp_path / "w"), t) for t in "ab")
    one.initialise()
    rows = spark.createDataFrame([("x",)], "description string")
    base = one.table("suppliers"), two.table("suppliers")
    two.commit("suppliers", base[1])
    with pytest.raises(Conflict):
        one.commit("suppliers", base[0])
    one.add("suppliers", rows, ["description"])
    two.add("suppliers", rows, ["description"])
    assert sorted((r.id, r.tenant) for r in one.table("suppliers").collect()) == [(1, "a"), (2, "b")]


def test_unique_keys_are_kept_on_write(spark, tmp_path):
    w, other = (Workspace(spark, str(tmp_path / "w"), t) for t in "ab")
    people = lambda *emails: spark.createDataFrame([(e,) for e in emails], "email string")
    w.add("users", people("x@m", "y@m", None, None), ["email"])
    for emails in (("x@m",), ("z@m", "z@m")):
        with pytest.raises(ValueError, match="email"):
            other.add("users", people(*emails), ["email"])
    other.add("users", people("z@m"), ["email"])
    mine = w.rows("users")
    with pytest.raises(ValueError, match="z@m"):
        w.edit("users", mine.where("email = 'x@m'").withColumn("email", F.lit("z@m")))
    w.edit("users", mine.where("email = 'x@m'").withColumn("email", F.lit("w@m")))
    w.edit("users", w.rows("users").where("email = 'w@m'"))
    assert sorted(str(r.email) for r in w.rows("users").collect()) == ["None", "None", "w@m", "y@m"]


def test_changes_of_rows_leave_them_in_place(spark, tmp_path, monkeypatch):
    """A change of some rows, line edits too, is written by the tasks that read them: nothing is shuffled but the edit."""
    doc = "named_struct('id', cast(id as string), 'type', '1', 'number', cast(id as string), 'date', '2024-01-01', 'sender', 's', 'lines', array({}), 'taxable', cast(null as double), 'discount', cast(null as string), 'vat', cast(null as string), 'total', 1.0D)"
    line = "named_struct('line_id', 'L', 'master_id', cast(id as string), 'code', 'c', 'description', '', 'quantity', cast(1 as decimal(28,10)), 'unit', '', 'taxable', cast(1 as decimal(28,10)), 'vat', '', 'total', cast(1 as decimal(28,10)))"
    content = f"named_struct('model_name', 'm', 'file_name', 'f', 'document', {doc.format(line)})"
    docs = spark.range(200).selectExpr("id", "'f' file_name", "timestamp_ntz'2024-01-01' created", f"{content} content", "cast(null as binary) attachment", "concat('t', id % 4) tenant", "0 state")
    w = Workspace(spark, str(tmp_path / "w"), "t1")
    w.commit("docs", docs)
    plans, append = [], Versions.append

    def watched(self, df, *args, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return append(self, df, *args, **how)

    monkeypatch.setattr(Versions, "append", watched)
    monkeypatch.setattr(type(docs), "hint", lambda self, name, *columns: pytest.fail(f"{name} of rows that stay where they are"))
    w.set_state("1", 1)
    w.append_line("5", {"line_id": "new", "code": "Z"})
    w.replace_line("9", {"line_id": "l", "code": "R"})
    w.remove_line("13", "L")
    w.remove_document(state=-1, number="17")
    assert len(plans) == 5 and not any("SortMergeJoin" in p for p in plans)
    got = {r["id"]: (r["state"], [x["code"] for x in r["content"]["document"]["lines"]]) for r in w.table("docs").collect()}
    assert got == {k: (int(k == 1), {5: ["c", "Z"], 9: ["R"], 13: []}.get(k, ["c"])) for k in range(200) if k != 17}
