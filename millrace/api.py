"""A tenant's workspace: the operators over versioned tables in one folder.

Reading methods return DataFrames of the latest versions; changing methods
write the next version of the one table they change and return its number.
Tables are in buckets, a tenant's rows in a few of them: reading a tenant reads
those, and a change reads and writes only the buckets of the rows it is about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import documents as docfn
from .operators import housekeeping, matching, mutations, reconcile, scans
from .sources import invoices
from .sources.tables import Versions


def health(spark: SparkSession) -> bool:
    """SC12: whether the session answers."""
    return spark.range(1).count() == 1


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, tenant: str, buckets: tuple[int, int] = (4, 4)):
        """buckets: groups of tenants and buckets of each; the same for all who use the folder."""
        if not tenant or not tenant.strip():
            raise ValueError("a tenant is needed")
        self.spark, self.folder, self.tenant, self.buckets = spark, folder.rstrip("/"), tenant, buckets
        self._seen: dict[str, int | None] = {}

    # tables

    def _versions(self, name: str) -> Versions:
        if name not in schemas.TABLES:
            raise KeyError(name)
        return Versions(self.spark, f"{self.folder}/{name}", schemas.BUCKET_KEYS[name], self.buckets, schemas.BLOOM_COLUMNS.get(name, ()))

    def initialise(self) -> list[str]:
        """A first, empty version of each table that has none."""
        made = [n for n in schemas.TABLES if self._versions(n).latest() is None]
        for name in made:
            self._versions(name).append(schemas.empty(self.spark, name), None)
        return made

    def _base(self, name: str) -> tuple[Versions, int]:
        """The table and its latest version, on which the next commit builds."""
        versions = self._versions(name)
        latest = versions.latest()
        if latest is None:
            latest = versions.append(schemas.empty(self.spark, name), None)
        self._seen[name] = latest
        return versions, latest

    def table(self, name: str) -> DataFrame:
        """SC1: all tenants' rows of the latest version."""
        versions, latest = self._base(name)
        return versions.read(latest)

    def commit(self, name: str, df: DataFrame, **how) -> int:
        """Write the version after the one that was read; Conflict if another writer did so meanwhile.

        df: all rows, or as `how` says to Versions.append.
        """
        versions = self._versions(name)
        base = self._seen[name] if name in self._seen else versions.latest()
        return versions.append(df.select(*schemas.TABLES[name][0].names), base, **how)

    def _unique(self, name: str, rows: DataFrame, versions: Versions, base: int) -> None:
        if len(schemas.TABLES[name][1]) > 1 and name != "reconciled_lines":  # whose rows replace those of their key
            found = schemas.refused(rows, versions.read(base), name).limit(5).collect()
            if found:
                raise ValueError("not unique: " + ", ".join(f"{r.key} {r.value}" for r in found))

    def _change(self, name: str, change, touched: list[int], in_place: bool = False) -> int:
        """Write what `change` makes of the rows of some buckets, of the version that was read last."""
        base = self._seen[name]
        return self.commit(name, change(self._versions(name).read(base, touched)), touched=touched, in_place=in_place)

    def _change_where(self, name: str, hit, change, everyone: bool = False) -> int:
        """_change of the buckets that have a row that is hit, row by row."""
        versions, base = self._base(name)
        rows = versions.read(base, None if everyone else versions.group_of(self.tenant))
        return self._change(name, change, versions.buckets_of(rows.where(hit)), in_place=True)

    # reading

    def rows(self, name: str) -> DataFrame:
        """SC2."""
        versions, latest = self._base(name)
        own = versions.group_of(self.tenant) if schemas.BUCKET_KEYS[name][0] == "tenant" else None
        return scans.of_tenant(versions.read(latest, own), self.tenant)

    def get(self, name: str, key: int) -> DataFrame:
        """SC3."""
        return scans.by_id(self.rows(name), key, self.tenant)

    def documents(self, **filters) -> DataFrame:
        """Open ones unless `state` says otherwise."""
        return scans.documents(self.rows("docs"), tenant=self.tenant, **filters)

    def document_lines(self, **filters) -> DataFrame:
        docs = self.documents(**filters)
        return docs.select("id", F.posexplode("content.document.lines").alias("position", "line")).select("id", "position", "line.*")

    def articles_of(self, supplier: str) -> DataFrame:
        return scans.articles_of_named(self.rows("articles"), self.rows("suppliers"), self.tenant, supplier)

    def log(self, rows: int = 1000) -> DataFrame:
        return scans.recent_log(self.rows("log"), self.tenant, rows)

    # changing

    def add(self, name: str, rows: DataFrame, order: list[str]) -> int:
        """Rows join the buckets of the ids they get; a taken unique key is refused (ValueError)."""
        versions, base = self._base(name)
        new = mutations.guarded_insert(schemas.empty(self.spark, name), rows, self.tenant, order, versions.top(base))
        self._unique(name, new, versions, base)
        return self.commit(name, new, add=True)

    def _by_id(self, name: str, rows: DataFrame, change) -> int:
        versions, base = self._base(name)
        return self._change(name, change, versions.buckets_of(rows.select("id"), {"tenant": F.lit(self.tenant)}))

    def edit(self, name: str, rows: DataFrame) -> int:
        """A taken unique key is refused (ValueError)."""
        versions, base = self._base(name)
        self._unique(name, rows, versions, base)
        return self._by_id(name, rows, lambda state: mutations.update(state, rows, self.tenant))

    def remove(self, name: str, ids: DataFrame) -> int:
        """M3, M20."""
        return self._by_id(name, ids, lambda state: mutations.delete(state, ids, self.tenant))

    def _change_document(self, document: str, change) -> int:
        hit = (F.col("tenant") == self.tenant) & (F.col("content.document.id") == document)
        return self._change_where("docs", hit, change)

    def set_state(self, document: str, state: int) -> int:
        return self._change_document(document, lambda docs: mutations.set_state(docs, self.tenant, document, state))

    def toggle_state(self, document: str, label: str) -> int:
        """PJ9: what is shown as open is closed, the rest opened."""
        return self.set_state(document, 1 if label.lower() == "open" else 0)

    def set_type(self, document: str, kind: int) -> int:
        return self._change_document(document, lambda docs: mutations.set_type(docs, self.tenant, document, int(kind)))

    def _line_edit(self, change, document: str, line: dict) -> int:
        schema = "tenant string, doc_id string, line " + schemas.LINE.simpleString()
        row = (self.tenant, document, tuple(line.get(n) for n in schemas.LINE.names))
        # the one edit goes to the documents, which stay where they are
        return self._change_document(document, lambda docs: change(docs, F.broadcast(self.spark.createDataFrame([row], schema))))

    def append_line(self, document: str, line: dict) -> int:
        return self._line_edit(mutations.append_lines, document, line)

    def replace_line(self, document: str, line: dict) -> int:
        return self._line_edit(mutations.replace_lines, document, line)

    def remove_line(self, document: str, line_id: str) -> int:
        return self._line_edit(mutations.remove_lines, document, {"line_id": line_id})

    def remove_document(self, **filters) -> int:
        """The first that passes."""
        first = self.documents(**filters).agg(F.min("id")).first()[0]
        hit = (F.col("tenant") == self.tenant) & (F.col("id") == F.lit(first))
        return self._change_where("docs", hit, lambda docs: docs.where(~F.coalesce(hit, F.lit(False))))

    def clean(self, as_of, days: int = 90) -> int:
        """M9: expired documents of all tenants go."""
        return self._change_where("docs", mutations.expired(as_of, days), lambda docs: mutations.retain(docs, as_of, days), everyone=True)

    # imports

    def import_documents(self, arriving: DataFrame) -> mutations.Replaced:
        """Documents (content, file_name, attachment, created, arrival) replace open ones of their key.

        The next version of docs is written; the result tells what was refused.
        """
        doc = F.col("content.document")
        keys = [doc[k].alias(k) for k in ("sender", "number", "date", "type")]
        versions, base = self._base("docs")
        new = arriving.select("*", *keys).withColumn("tenant", F.lit(self.tenant)).withColumn("state", F.lit(0))
        touched = versions.buckets_of(new)
        out = mutations.keyed_replace(versions.read(base, touched).select("*", *keys), new, top=versions.top(base))
        self.commit("docs", out.state, touched=touched)
        return out

    def import_invoices(self, files: DataFrame, created) -> mutations.Replaced:
        """SC14: XML invoices of (source, xml), in the order of their sources."""
        docs = invoices.documents(files)
        document = F.struct(
            "id", "type", "number", "date", "sender", "lines", F.lit(None).cast("double").alias("taxable"), F.lit(None).cast("string").alias("discount"), F.lit(None).cast("string").alias("vat"), "total"
        )
        text = F.to_json(F.struct(F.col("source").alias("file_name"), document.alias("document")))
        return self.import_documents(docs.select(F.col("source").alias("file_name"), docfn.parse(text).alias("content"), F.lit(None).cast("binary").alias("attachment"), created.alias("created"), F.col("source").alias("arrival")))

    def update_master_data(self, created) -> dict[str, int]:
        """Suppliers and articles that the tenant's documents name and the tables lack are added."""
        docs = self.rows("docs").select("tenant", F.col("content.document.sender").alias("name"), F.col("content.document.lines").alias("lines"))
        suppliers = self.rows("suppliers")
        entries = matching.supplier_entries(docs.select("tenant", "name"), suppliers).where("action != 'known'")
        new = entries.select(F.col("name").alias("description"), "reference", "score", created.alias("created"))
        first = self.add("suppliers", new, ["description"])
        named = matching.resolve_supplier(docs, self.rows("suppliers")).select("tenant", "supplier_id", F.explode("lines").alias("x"))
        lines = named.select("tenant", "supplier_id", F.col("x.code").alias("code"), F.col("x.description").alias("description"))
        found = matching.article_entries(lines, self.rows("articles")).where("action != 'known'")
        new = found.select("supplier_id", "code", "description", "ref_code", "ref_description", "code_score", "description_score", created.alias("created"))
        return {"suppliers": first, "articles": self.add("articles", new, ["supplier_id", "code", "description"])}

    def log_calls(self, calls: DataFrame) -> int:
        """M16."""
        versions, base = self._base("log")
        return self.commit("log", mutations.insert(schemas.empty(self.spark, "log"), housekeeping.log_rows(calls), housekeeping.ORDER, versions.top(base)), add=True)

    # reconciliation

    @staticmethod
    def reconcile(deliveries: DataFrame, invoice_lines: DataFrame, least: int = 90) -> dict[str, DataFrame]:
        """J1-J3, J8, S3 over all suppliers at once."""
        return reconcile.reconcile(deliveries, invoice_lines, least)

    def save_reconciliation(self, deliveries: DataFrame, invoice_lines: DataFrame) -> int:
        """Lines with quantity, reconciled, selected and ordinal."""
        sides = [mutations.reconciled_rows(df.withColumn("tenant", F.lit(self.tenant)), s) for df, s in ((deliveries, "delivery"), (invoice_lines, "invoice"))]
        versions, base = self._base("reconciled_lines")
        touched = versions.buckets_of(sides[0].select("tenant", "line_id").union(sides[1].select("tenant", "line_id")))
        return self._change("reconciled_lines", lambda state: mutations.save_reconciliation(state, *sides, top=versions.top(base)), touched)

    def delete_reconciled(self, line_id: str) -> int:
        """M14."""
        hit = (F.col("tenant") == self.tenant) & (F.col("line_id") == line_id)
        return self._change_where("reconciled_lines", hit, lambda state: mutations.delete_reconciled(state, self.tenant, line_id))
