"""Registration intake: e-mail uniqueness against the table and the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas as S
from cartwheel.functions.keys import dense_ids, max_key
from cartwheel.functions.text import email_key


def parse_int(col: str, default: int | None = None) -> F.Column:
    """int(form value) without raising: malformed text becomes ``default``
    (NULL when no default), to be routed to a reject output."""
    parsed = F.expr(f"try_cast(trim(cast(`{col}` as string)) as int)")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def registration_ingest(users: DataFrame, registrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (report, new_users); the report has every request.

    E-mails compare case-insensitively. A request without an e-mail is
    ``missing_email``; one whose e-mail is already registered is
    ``duplicate_existing``; among new e-mails the lowest request_id is
    ``accepted`` and the rest ``duplicate_in_batch`` -- the outcome of handling
    the requests one by one in id order. Accepted rows get user ids after
    max(user_id) in request order.
    """
    r = registrations.withColumn("email_key", email_key("email"))
    # one row per e-mail of the batch: its first request, and whether users has it
    first = r.where(F.col("email_key").isNotNull()).groupBy("email_key").agg(F.min("request_id").alias("_first"))
    known = users.select(email_key("email").alias("email_key"), F.lit(1).alias("_known"))
    keys = first.join(known, "email_key", "left").groupBy("email_key").agg(
        F.first("_first").alias("_first"), F.max("_known").alias("_known"))
    ids = dense_ids(keys.where(F.col("_known").isNull()).select(F.col("_first").alias("request_id")),
                    "request_id", max_key(users, "user_id"), "user_id")
    tagged = r.join(keys, "email_key", "left").join(ids, "request_id", "left")
    status = (F.when(F.col("email_key").isNull(), F.lit("missing_email"))
               .when(F.col("_known").isNotNull(), F.lit("duplicate_existing"))
               .when(F.col("request_id") == F.col("_first"), F.lit("accepted"))
               .otherwise(F.lit("duplicate_in_batch")))
    tagged = tagged.withColumn("status", status)
    report = tagged.select("request_id", "email_key", "status", "user_id")
    new_users = tagged.where(F.col("status") == "accepted").select(
        "user_id", "name", "email", "address", "phone", F.lit(None).cast(S.TS).alias("created_at"))
    return report, new_users


def registration_rejects(report: DataFrame) -> DataFrame:
    return report.where(F.col("status") != "accepted").select("request_id", F.col("status").alias("reason"))
