"""Scans and lookups over tables that several tenants share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_blank, same_text


def of_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """SC2: a tenant's rows; prunes partitions where the table is partitioned by tenant."""
    return df.where(F.col("tenant") == F.lit(tenant))


def by_id(df: DataFrame, key: int, tenant: str | None = None, column: str = "id") -> DataFrame:
    """SC3: the row of a key, in the tenant if one is given."""
    out = df.where(F.col(column) == F.lit(key))
    return (out if tenant is None else of_tenant(out, tenant)).limit(1)


def articles_of(articles: DataFrame, tenant: str, supplier_id: int) -> DataFrame:
    """SC4."""
    return of_tenant(articles, tenant).where(F.col("supplier_id") == F.lit(supplier_id))


def articles_of_named(articles: DataFrame, suppliers: DataFrame, tenant: str, description: str) -> DataFrame:
    """SC2, J5, P10, L3: articles of the first supplier of that name, in the order of their descriptions; none if unknown."""
    known = of_tenant(suppliers, tenant).where(same_text(F.col("description"), F.lit(description)))
    one = known.orderBy("id").limit(1).select(F.col("id").alias("supplier_id"))
    return of_tenant(articles, tenant).join(one, "supplier_id", "left_semi").orderBy("description", "id")


def users_of_email(users: DataFrame, email: str) -> DataFrame:
    """SC5: the first user of an address, which is lowered."""
    return users.where(F.col("email") == F.lit(email.lower())).orderBy("id").limit(1)


def user_by_email(users: DataFrame, email: str) -> dict:
    """SC5: the user of an address; LookupError if there is none."""
    row = users_of_email(users, email).first()
    if row is None:
        raise LookupError(email)
    return row.asDict()


def document_predicate(tenant: str, state: int = 0, sender: str = "", number: str = "", date: str = "", kind: int = 0) -> Column:
    """A conjunction in which blank texts, kind 0 and a negative state say nothing."""
    doc = F.col("content.document")
    parts = [F.col("tenant") == F.lit(tenant)]
    if state > -1:
        parts.append(F.col("state") == F.lit(state))
    for name, value in (("sender", sender), ("number", number), ("date", date)):
        if value and value.strip():
            parts.append(doc[name] == F.lit(value))
    if kind:
        parts.append(doc["type"] == F.lit(str(kind)))
    return reduce(lambda a, b: a & b, parts)


def documents(docs: DataFrame, attachment: bool = False, **filters) -> DataFrame:
    """P1, PJ1: documents that pass, without their attachments unless wanted."""
    out = docs.where(document_predicate(**filters))
    return out if attachment else out.drop("attachment")


def legacy_by_sender(docs: DataFrame, sender: str, one_sided: bool = False) -> DataFrame:
    """SC8, P3: by sender without regard to case; one_sided lowers the argument only."""
    column = F.col("content.document.sender")
    return docs.where((column if one_sided else F.lower(column)) == F.lit(sender.lower()))


def rows_of_master(lines: DataFrame, master_id: str) -> DataFrame:
    """SC10: a document's lines by the id that they name."""
    return lines.where(F.col("master_id") == F.lit(master_id))


def legacy_one(docs: DataFrame, sender: str, number: str, date: str, one_sided: bool = False) -> DataFrame:
    """SC9: the first of those of this number and date."""
    doc = F.col("content.document")
    low = (lambda c: c) if one_sided else F.lower
    out = legacy_by_sender(docs, sender, one_sided).where((low(doc["number"]) == number.lower()) & (doc["date"] == date))
    return out.orderBy("id").limit(1)


def exactly_one(df: DataFrame) -> dict:
    """L4: the only row; LookupError if there is none or more than one."""
    rows = df.take(2)
    if len(rows) != 1:
        raise LookupError(f"{'no' if not rows else 'more than one'} row")
    return rows[0].asDict()


def first_per(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """L4: of rows of equal keys the first in a total order; nulls are equal."""
    spot = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(spot)).where("_n = 1").drop("_n")


def recent_log(log: DataFrame, tenant: str | None = None, rows: int = 1000) -> DataFrame:
    """L1, L2: the latest entries first, ids break ties."""
    out = log if tenant is None else of_tenant(log, tenant)
    return out.orderBy(F.desc("created"), F.desc("id")).limit(rows)
