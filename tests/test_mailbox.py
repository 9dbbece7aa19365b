from email.message import EmailMessage

import pytest

from millrace.sources import mailbox
from millrace.sources.files import with_retry


def message(path, sender, *names):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = f"Someone <{sender}>", "in@here", "s"
    m.set_content("body")
    for name in names:
        m.add_attachment(name.encode(), maintype="application", subtype="pdf", filename=name)
    path.write_bytes(m.as_bytes())


def test_poll_delivers_once_and_quarantines(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    message(drop / "1.eml", "A@x.test", "one.pdf", "two.xml")
    message(drop / "2.eml", "who@x.test", "three.pdf")
    (drop / "3.eml").write_bytes(b"not a message")
    (drop / "note.txt").write_bytes(b"no")
    tenants = spark.createDataFrame([(1, "T", "a@X.test")], "id long, code string, mail_from string")
    got, odd = [], []

    def run():
        take = lambda to: lambda df: to.extend((r.tenant, r.file_name, bytes(r.content)) for r in df.collect())
        mailbox.poll(spark, str(drop), tenants, take(got), take(odd), str(tmp_path / "c"), every=None).awaitTermination()

    run()
    assert sorted(got) == [("T", "one.pdf", b"one.pdf"), ("T", "two.xml", b"two.xml")] and [x[1] for x in odd] == ["three.pdf"]
    message(drop / "4.eml", "a@x.test", "four.pdf")
    run()
    assert [x[1] for x in got[2:]] == ["four.pdf"] and len(odd) == 1


def test_retry_gives_up_after_its_repeats():
    waits, calls = [], []

    def fails(n):
        calls.append(1)
        if len(calls) <= n:
            raise OSError

    with_retry(fails, sleep=waits.append)(3)
    assert len(calls) == 4 and len(waits) == 3 and waits[0] < waits[1] < waits[2]
    calls.clear()
    with pytest.raises(OSError):
        with_retry(fails, retries=1, sleep=waits.append)(9)
