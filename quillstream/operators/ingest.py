"""Acquisition: unwrapping payloads, normalising and validating raw records, keeping each key once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..store import written

# The accepted dates and the keys under which an answer may list its records.
FIRST_DAY, LAST_DAY = "2021-01-01", "2026-12-31"
LISTS, WRAPPERS = ["decisions", "results", "items", "documents"], ["data", "response"]
DOCUMENT_URL = "https://documents.invalid/%s"
REASON_DATE, REASON_ORGANIZATION, REASON_KEY = "invalid_or_out_of_range_date", "wrong_organization", "missing_ada"


def unwrap(payloads: DataFrame, column: str = "payload", depth: int = 2) -> DataFrame:
    """A row for each record of JSON answers: payloads' columns but the JSON, `pos`, and `record` as JSON text.

    An answer is a list, or an object with a list under the first of LISTS that holds one (even an empty one), or an object
    that is not empty under one of WRAPPERS, which is unwrapped in turn, to `depth` levels. Items that are not objects are left out.
    """
    fields = ", ".join(f"{k} string" for k in [*LISTS, *WRAPPERS])
    begins = lambda c, x: F.substring(F.ltrim(c), 1, 1) == x
    d, found, now = payloads, [], [column]
    # Each object is parsed once, into the texts of the fields that count; the first list in order of search is parsed at the end.
    for level in range(depth + 1):
        objects = {f"__{level}_{i}": F.from_json(F.when(begins(F.col(c), "{"), F.col(c)), fields) for i, c in enumerate(now)}
        d = d.withColumns(objects)
        found.append([[F.col(c), *(F.col(o)[k] for k in LISTS)] for c, o in zip(now, objects, strict=True)])
        inner = {f"{o}_{k}": F.col(o)[k] for o in objects for k in WRAPPERS}
        if level < depth:
            d = d.withColumns({n: F.when(begins(c, "{") & ~c.rlike(r"^\s*\{\s*\}"), c) for n, c in inner.items()})
            now = list(inner)

    def search(level: int, i: int) -> list[Column]:
        mine = [F.when(begins(c, "["), c) for c in found[level][i]]
        for j in range(len(WRAPPERS) if level < depth else 0):
            mine += search(level + 1, i * len(WRAPPERS) + j)
        return mine

    items = F.from_json(F.coalesce(*search(0, 0)), "array<string>")
    rest = [c for c in payloads.columns if c != column]
    d = d.select(*rest, F.posexplode(items).alias("pos", "record"))
    return d.filter(F.substring(F.ltrim("record"), 1, 1) == "{")


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[tx.truthy(c.cast("string")) for c in cols])


def normalize(raw: DataFrame, organization: str, template: str = DOCUMENT_URL) -> DataFrame:
    """Raw records with any of the alternate field names to the metadata schema; absent fields are null, absent lists empty.

    A record without an address has the one that `template` makes of its key.
    """
    have = set(raw.columns)
    pick = lambda *names: first_truthy(*[F.col(n) for n in names if n in have]) if have & set(names) else F.lit(None).cast("string")
    many = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>")) if n in have else F.array().cast("array<string>")
    date = lambda *n: tx.normalize_date(pick(*n))
    ada = tx.strip(F.coalesce(pick("ada", "ADA", "iun"), F.lit("")))
    return raw.select(
        ada.alias("ada"),
        pick("protocolNumber").alias("protocol_number"),
        pick("subject").alias("subject"),
        date("issueDate", "issue_date", "submissionTimestamp", "submission_timestamp").alias("issue_date"),
        date("publishTimestamp").alias("publish_date"),
        date("submissionTimestamp", "submission_timestamp").alias("submission_date"),
        F.coalesce(tx.truthy(tx.strip(pick("organizationId", "organizationUid"))), F.lit(organization)).alias("organization_id"),
        many("unitIds").alias("unit_ids"),
        many("signerIds").alias("signer_ids"),
        pick("decisionTypeId", "decisionTypeUid").alias("decision_type_id"),
        many("thematicCategoryIds").alias("thematic_category_ids"),
        pick("status").alias("status"),
        (F.coalesce(F.col("privateData"), F.lit(False)) if "privateData" in have else F.lit(False)).alias("private_data"),
        pick("versionId").alias("version_id"),
        F.coalesce(pick("documentUrl"), F.format_string(template, ada)).alias("document_url"),
        pick("url").alias("api_url"),
        F.lit("diavgeia").alias("source"),
    )


def reason(date: Column, organization: Column, key: Column, wanted: str, first: str = FIRST_DAY, last: str = LAST_DAY) -> Column:
    """The first check that fails, or null: date in range, organization none or the wanted one, a key."""
    inside = F.coalesce(date.between(first, last), F.lit(False))
    other = F.coalesce(tx.strip(organization.cast("string")), F.lit(""))
    none = F.coalesce(tx.strip(key.cast("string")), F.lit("")) == ""
    return F.when(~inside, REASON_DATE).when((other != "") & (other != wanted), REASON_ORGANIZATION).when(none, REASON_KEY)


def validate(records: DataFrame, date: str, organization: str, key: str, wanted: str, first: str = FIRST_DAY, last: str = LAST_DAY) -> DataFrame:
    return records.withColumn("reason", reason(F.col(date), F.col(organization), F.col(key), wanted, first, last))


def accepted_and_rejected(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter("reason is null").drop("reason"), validated.filter("reason is not null")


def keep_first(d: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key. A combining aggregate, so a frequent key is no hot partition; order must be total."""
    rest = [c for c in d.columns if c != key]
    return d.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*").select(*d.columns)


def keep_last(d: DataFrame, key: str, *order: str) -> DataFrame:
    rest = [c for c in d.columns if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*").select(*d.columns)


def not_yet(d: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done; blank keys of `done` don't count."""
    return d.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def only(d: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among those done."""
    return d.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")


def first_rows(d: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order; each task keeps its own first n before they meet."""
    return d.orderBy(*order).limit(n)


def counters(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def dense_ids(d: DataFrame, order: str, count: str, name: str) -> DataFrame:
    """d with `name`, the sum of `count` over the rows before it in `order`; null comes first.

    Rows are dealt out by ranges of the order between sampled quantiles, so tasks are even however ids are spread, and written once,
    since another sampling would deal them out otherwise. Sums of the ranges, a row each, are added up in one small window, rows
    within their range. Only equal values of the order, which the ranges can't part, share a task.
    """
    kept = d.columns
    t = written(d.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    t = t.withColumn("__range", F.shiftright("__at", 33))
    per = t.groupBy("__range").agg(F.sum(count).alias("__n"))
    ahead = F.broadcast(per.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__ahead")))
    inside = F.coalesce(F.sum(count).over(W.partitionBy("__range").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("__inside", inside).join(ahead, "__range").select(*kept, (F.col("__ahead") + F.col("__inside")).alias(name))
