"""Scalar functions over whole columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweave.functions import headers as H
from mailweave.functions import text as X
from mailweave.functions.html import html_to_text
from mailweave.plans.registry import query
from mailweave.sources.testmail import emails, mail, table

SNIPPET_QUERY = "the"


@query
def x_address(spark, sf):
    """Senders in the header forms mail programs write."""
    name = F.concat(F.lit('"Mail, Nr '), F.col("email_id").cast("string"), F.lit('" <'), F.upper("sender"), F.lit("> "))
    header = F.when(F.col("in_reply_to").isNull(), F.concat(F.lit("  "), F.upper("sender"))).otherwise(name)
    return mail(spark, sf).select("email_id", H.address(header).alias("address"))


@query
def x_address_list(spark, sf):
    joined = F.concat_ws(" ; ", F.upper("receivers_csv"), "cc_csv", F.concat(F.lit("X <"), F.col("sender"), F.lit(">")),
                         "receivers_csv")
    return mail(spark, sf).select("email_id", F.array_join(H.address_list(joined), "|").alias("addresses"))


@query
def x_norm_subject(spark, sf):
    stacked = F.concat(F.lit(" RE:re: FWD:\tfw:  "), F.col("subject"), F.lit("  \n x  Re: kept "))
    return mail(spark, sf).select(
        "email_id", H.normalized_subject(F.col("subject")).alias("subject"), H.normalized_subject(stacked).alias("stacked"))


@query
def x_rfc2822_date(spark, sf):
    """Send dates written as headers in several forms, then read back; one form is not a date."""
    at, n = F.col("sent_at"), F.pmod("email_id", F.lit(9))
    text = (
        F.when(n == 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(n == 1, F.concat(F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(n == 2, F.concat(F.date_format(at, "EEE, d MMM yyyy H:mm:ss"), F.lit(" +0200 (CEST)")))
        .when(n == 3, F.concat(F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" -0530")))
        .when(n == 5, F.concat(F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .when(n == 6, F.concat(F.date_format(at, "EEE, d MMM yy HH:mm:ss"), F.lit(" +0000")))
        .when(n == 7, F.date_format(at, "d MMM yyyy HH:mm:ss"))
        .when(n == 8, F.concat(F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" -0000 (a zone) (of no place)")))
        .otherwise(F.date_format(at, "yyyy/MM/dd"))
    )
    return mail(spark, sf).select("email_id", H.utc_wall_time(H.rfc2822_time(text)).alias("sent"))


@query
def x_message_id(spark, sf):
    raw = F.concat(F.lit(" <"), F.coalesce("message_id", F.lit("")), F.lit("> "))
    return mail(spark, sf).select("email_id", H.message_id(raw).alias("message_id"))


@query
def x_snippet(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.search_snippet(F.col("text"), F.lit(SNIPPET_QUERY)).alias("snippet"))


@query
def x_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query
def x_clean_body(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_body(F.col("text")).alias("text"))


@query
def x_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate(F.col("text"), 500).alias("text"))


@query
def x_extractive_summary(spark, sf):
    return emails(spark, sf).select("id", "summary")


@query
def x_embedding_text(spark, sf):
    text = X.embedding_text(F.col("subject"), F.col("sender"), F.col("body_text"),
                            F.when(F.col("in_reply_to").isNotNull(), F.col("summary")))
    return emails(spark, sf).select("id", text.alias("document"))
