"""Electronic invoices in XML, parsed by Spark's own reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element names of the public invoice format.
_LINE = "struct<NumeroLinea: int, CodiceArticolo: array<struct<CodiceTipo: string, CodiceValore: string>>, Descrizione: string, Quantita: decimal(28,10), UnitaMisura: string, PrezzoTotale: decimal(28,10), AliquotaIVA: decimal(28,10)>"
_BODY = f"struct<DatiGenerali: struct<DatiGeneraliDocumento: struct<Data: date, Numero: string, ImportoTotaleDocumento: decimal(28,10)>>, DatiBeniServizi: struct<DettaglioLinee: array<{_LINE}>>>"
_HEADER = "struct<CedentePrestatore: struct<DatiAnagrafici: struct<Anagrafica: struct<Denominazione: string>>>>"
SCHEMA = f"FatturaElettronicaHeader {_HEADER}, FatturaElettronicaBody array<{_BODY}>"


def parse(xml: Column) -> Column:
    """SC14: the invoice of an XML text; null fields where elements lack."""
    return F.from_xml(xml, SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def key_digest(*parts: Column) -> Column:
    """SHA-256 of texts that may be null or hold anything."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]), 256)


def documents(invoices: DataFrame, all_bodies: bool = False) -> DataFrame:
    """PJ4, PJ5, L5: of (source, xml) a document for the first body, or for each.

    Type '4'; total 0 where there is none; a line's code is its first article
    code or ''. Ids are digests of the key fields, each with its length before
    it and nulls marked, so different keys never make one text.
    """
    parsed = invoices.select("source", parse(F.col("xml")).alias("x"))
    bodies = F.posexplode("x.FatturaElettronicaBody").alias("body_no", "body")
    rows = parsed.select("source", F.col("x.FatturaElettronicaHeader.CedentePrestatore.DatiAnagrafici.Anagrafica.Denominazione").alias("sender"), bodies)
    if not all_bodies:
        rows = rows.where("body_no = 0")
    head = F.col("body.DatiGenerali.DatiGeneraliDocumento")
    rows = rows.select("source", "body_no", "sender", head["Numero"].alias("number"), F.date_format(head["Data"], "yyyy-MM-dd").alias("date"), head["ImportoTotaleDocumento"].cast("double").alias("total"), F.col("body.DatiBeniServizi.DettaglioLinee").alias("raw"))
    doc_id = key_digest(F.col("sender"), F.col("number"), F.col("date"), F.col("body_no").cast("string"))
    rows = rows.withColumn("id", doc_id)

    def line(x: Column, master: Column) -> Column:
        code = F.coalesce(F.get(x["CodiceArticolo"], F.lit(0))["CodiceValore"], F.lit(""))
        return F.struct(
            x["NumeroLinea"].cast("string").alias("line_id"), master.alias("master_id"), code.alias("code"), x["Descrizione"].alias("description"),
            x["Quantita"].alias("quantity"), x["UnitaMisura"].alias("unit"), F.lit(0).cast("decimal(28,10)").alias("taxable"),
            x["AliquotaIVA"].cast("string").alias("vat"), x["PrezzoTotale"].alias("total"),
        )

    # a list of the one id, so that its digest is made once for a document and not for each line
    lines = F.get(F.transform(F.array("id"), lambda master: F.transform(F.coalesce("raw", F.array()), lambda x: line(x, master))), F.lit(0))
    return rows.select("source", "id", F.lit("4").alias("type"), "number", "date", "sender", lines.alias("lines"), F.coalesce("total", F.lit(0.0)).alias("total"))
