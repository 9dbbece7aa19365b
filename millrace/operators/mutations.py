"""Mutations as functions of a table's state and a change set.

Plain Parquet tables know no update or delete, so each operator returns the
next state (and what was refused), to be written as a new version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import documents as docfn
from ..functions.text import is_blank, older_than
from ..sources.tables import settle
from .scans import document_predicate, first_per


def numbered(df: DataFrame, order: list[str], start: int, column: str = "id") -> DataFrame:
    """df with consecutive ids after `start` in a total order.

    Rows are dealt by range, numbered within each range and settled, so that
    a row's range and number are data: no later job can deal them otherwise.
    Of the ranges only their sizes meet, a row for each.
    """
    m = F.monotonically_increasing_id()
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", m)
    spread = settle(spread.withColumn("_part", F.shiftright("_m", 33)).withColumn("_row", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"), "numbered")
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))  # a row for each task's range
    out = spread.join(F.broadcast(bases), "_part")
    return out.withColumn(column, (F.lit(start) + F.col("_base") + F.col("_row") + 1).cast("long")).drop("_part", "_row", "_base")


def largest_id(state: DataFrame) -> int:
    return state.agg(F.max("id")).first()[0] or 0


def insert(state: DataFrame, rows: DataFrame, order: list[str], top: int | None = None) -> DataFrame:
    """Rows without ids join the state with the ids after its largest (`top`, where that is known)."""
    top = largest_id(state) if top is None else top
    return state.unionByName(numbered(rows.drop("id"), order, top), allowMissingColumns=True)


def update(state: DataFrame, changes: DataFrame, tenant: str | None = None) -> DataFrame:
    """M2: rows of changed ids get every column of the change but `created` (and keep the tenant's guard).

    Of changes that repeat an id the last by `ordinal` counts, where there is
    one, else the greatest by its columns.
    """
    writable = [c for c in state.columns if c not in ("id", "created")]
    last = ["ordinal"] if "ordinal" in changes.columns else writable
    new = first_per(changes, ["id"], [F.desc(c) for c in last]).select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in writable])
    joined = state.join(new, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if tenant is not None:
        hit = hit & (F.col("tenant") == tenant)
    return joined.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in writable else F.col(c) for c in state.columns])


def delete(state: DataFrame, ids: DataFrame, tenant: str | None = None) -> DataFrame:
    """M3: the state without the rows of the ids, in the tenant only if one is given."""
    if tenant is None:
        return state.join(ids.select("id"), "id", "left_anti").select(*state.columns)
    marked = ids.select("id").withColumn("tenant", F.lit(tenant))
    return state.join(marked, ["id", "tenant"], "left_anti").select(*state.columns)


def guarded_insert(state: DataFrame, rows: DataFrame, tenant: str, order: list[str], top: int | None = None) -> DataFrame:
    """The caller's tenant is forced; article rows of supplier 0 or none are refused."""
    if "supplier_id" in rows.columns:
        rows = rows.where(F.coalesce(F.col("supplier_id"), F.lit(0)) != 0)
    return insert(state, rows.withColumn("tenant", F.lit(tenant)), order, top)


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """CH1: rows of `new` with an id over 0 that differ from the old row of that id in any column."""
    columns = [c for c in new.columns if c != "id"]
    before = old.select("id", F.struct(*columns).alias("_old"))
    joined = new.where("id > 0").join(before, "id")
    return joined.where(~F.struct(*columns).eqNullSafe(F.col("_old"))).select(*new.columns)


def set_state(docs: DataFrame, tenant: str, doc_id: str | Column, state: int) -> DataFrame:
    """M4."""
    hit = (F.col("tenant") == tenant) & (F.col("content.document.id") == doc_id)
    return docs.withColumn("state", F.when(hit, F.lit(state)).otherwise(F.col("state")))


def set_type(docs: DataFrame, tenant: str, doc_id: str | Column, kind: int) -> DataFrame:
    """M5: the nested type becomes the code as text; nothing else of the content changes."""
    hit = (F.col("tenant") == tenant) & (F.col("content.document.id") == doc_id)
    changed = docfn.set_path(F.col("content"), "document.type", F.lit(str(kind)))
    return docs.withColumn("content", F.when(hit, changed).otherwise(F.col("content")))


def _edit_lines(docs: DataFrame, edits: DataFrame, change) -> DataFrame:
    """Apply one edit to each document that has one; attachments and other columns stay."""
    joined = docs.join(edits, (docs["tenant"] == edits["_tenant"]) & (docs["content"]["document"]["id"] == edits["_doc"]), "left")
    lines = change(F.col("content.document.lines"), F.col("_edit"))
    changed = docfn.set_path(F.col("content"), "document.lines", lines)
    hit = F.col("_edit").isNotNull() & F.col("content.document").isNotNull()
    return joined.withColumn("content", F.when(hit, changed).otherwise(F.col("content"))).select(*docs.columns)


def _edits(edits: DataFrame) -> DataFrame:
    """Of (tenant, doc_id, line) one for each document: the last by `ordinal`, where there is one, else the greatest line."""
    edits = first_per(edits, ["tenant", "doc_id"], [F.desc("ordinal" if "ordinal" in edits.columns else "line")])
    return edits.select(F.col("tenant").alias("_tenant"), F.col("doc_id").alias("_doc"), F.col("line").alias("_edit"))


def append_lines(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """M6: a line is added at the end, whatever lines there are."""
    return _edit_lines(docs, _edits(edits), docfn.append_line)


def replace_lines(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """M7: the first line of the id, without regard to case, is replaced; no such line, no change."""
    return _edit_lines(docs, _edits(edits), lambda lines, e: docfn.replace_line(lines, e["line_id"], e))


def remove_lines(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """M8: the first line of the id goes; no such line, no change."""
    return _edit_lines(docs, _edits(edits), lambda lines, e: docfn.remove_line(lines, e["line_id"]))


def expired(as_of: Column, days: int = 90) -> Column:
    """Closed and created more than `days` before `as_of`."""
    return (F.col("state") == 1) & older_than(F.col("created"), as_of, days)


def retain(docs: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """M9: the documents of all tenants that stay."""
    return docs.where(~F.coalesce(expired(as_of, days), F.lit(False)))


@dataclass
class Replaced:
    state: DataFrame
    rejected: DataFrame
    quarantined: DataFrame


KEY = ["tenant", "sender", "number", "date", "type"]


def keyed_replace(state: DataFrame, incoming: DataFrame, reject_closed: bool = True, top: int | None = None) -> Replaced:
    """Replace an open document by its key, insert a new one, reject what would replace a closed one.

    Both have KEY as columns, state also id and state, incoming `arrival` (a
    total order). Of incoming documents of one key the last by arrival stays.
    Of several in the state the one of the least id is met. Incoming rows with
    a blank key part are quarantined. reject_closed=False replaces closed ones
    too (M11). New ids follow the largest (`top`, where the state is a part of
    its table), in the order of arrival.
    """
    blank = F.lit(False)
    for c in KEY:
        blank = blank | is_blank(F.col(c))
    quarantined = incoming.where(blank)
    solid = incoming.where(~blank)
    met = first_per(state, KEY, [F.col("id")]).select(*KEY, F.col("id").alias("_met"), F.col("state").alias("_met_state"))
    marked = solid.join(met, KEY, "left")
    closed = F.col("_met_state") == 1 if reject_closed else F.lit(False)
    refused = F.coalesce(closed, F.lit(False))
    rejected = marked.where(refused).select(*incoming.columns)
    accepted = first_per(marked.where(~refused), KEY, [F.desc("arrival")])
    top = largest_id(state) if top is None else top
    # what replaces is settled as it is numbered, and what it replaces is read from there
    added = numbered(accepted.drop("_met_state"), ["arrival"], top)
    kept = state.join(added.where("_met is not null").select(F.col("_met").alias("id")), "id", "left_anti").select(*state.columns)
    return Replaced(kept.unionByName(added.select(*[F.col(c) for c in state.columns if c in added.columns]), allowMissingColumns=True), rejected, quarantined)


def delete_first(docs: DataFrame, **filters) -> DataFrame:
    """Without the first document (least id) that passes P1; none passes, none goes."""
    first = docs.where(document_predicate(**filters)).agg(F.min("id").alias("id")).where("id is not null")
    return docs.join(first, "id", "left_anti").select(*docs.columns)


def save_reconciliation(state: DataFrame, deliveries: DataFrame, invoices: DataFrame, top: int | None = None) -> DataFrame:
    """Rows of both lists replace those of their (tenant, line_id); the last wins, invoices after deliveries.

    The lists have the state's columns but id, and `ordinal`. New ids follow
    the largest (`top`, where the state is a part of its table).
    """
    both = deliveries.withColumn("_side", F.lit(0)).unionByName(invoices.withColumn("_side", F.lit(1)))
    last = first_per(both, ["tenant", "line_id"], [F.desc("_side"), F.desc("ordinal")])
    top = largest_id(state) if top is None else top
    # the last rows are settled as they are numbered, and what they replace is read from there
    added = numbered(last, ["_side", "ordinal"], top).drop("_side", "ordinal")
    kept = state.join(added.select("tenant", "line_id"), ["tenant", "line_id"], "left_anti").select(*state.columns)
    return kept.unionByName(added.select(*state.columns))


def reconciled_rows(lines: DataFrame, side: str) -> DataFrame:
    """PJ3: lines (quantity, reconciled, selected, texts) as rows to save: delta, flag, the compatible type 3, the side."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("master_id", "line_id", "code", "state", "note", "supplier_id")]
    amount = "decimal(28,10)"
    return lines.select(
        *text, "tenant", "created", "ordinal", F.lit(3).alias("doc_type"), F.col("quantity").cast(amount).alias("quantity"),
        F.col("reconciled").cast(amount).alias("reconciled"), (F.col("quantity") - F.col("reconciled")).cast(amount).alias("delta"),
        F.coalesce(F.col("selected"), F.lit(False)).cast("int").alias("flag"), F.lit(side).alias("side"),
    )


def delete_reconciled(state: DataFrame, tenant: str, line_id: str) -> DataFrame:
    """M14."""
    return state.where(~((F.col("tenant") == tenant) & (F.col("line_id") == line_id)))


def shred(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A header row and a row for each line."""
    doc = F.col("content.document")
    header = docs.select("id", doc["sender"].alias("sender"), doc["number"].alias("number"), doc["date"].alias("date"), doc["type"].try_cast("int").alias("type"), doc["taxable"].alias("taxable"), doc["total"].alias("total"))
    lines = docs.select(F.col("id").alias("doc_id"), F.posexplode("content.document.lines").alias("position", "line"))
    return header, lines.select("doc_id", "position", "line.*")


def display_state(state: Column) -> Column:
    """PJ8: what the button that leaves a state says."""
    return F.when(state == "Open", "Close").when(state == "", "Add").otherwise(state)


def toggled_state(label: Column) -> Column:
    """PJ9: closing what is open, opening the rest."""
    return F.when(F.lower(label) == "open", 1).otherwise(0)

