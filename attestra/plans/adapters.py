"""Attempt-shaped views of ordinary business tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.policy import Policy

DAY = 86_400
# Order dates have day resolution, so the windows of this policy span days.
ORDER_POLICY = Policy(velocity_seconds=3 * DAY, spread_seconds=5 * DAY, failed_seconds=200 * DAY)
EVENT_VELOCITY, EVENT_SPREAD, EVENT_FAILED = 21_600, 43_200, 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS record_id", "event_id AS seq", "CAST(ts AS TIMESTAMP) AS ts",
        "unix_timestamp(CAST(ts AS TIMESTAMP)) AS sec", "CAST(user_id AS STRING) AS claimed_user_ref",
        "concat('ip', CAST(user_id % 7 AS STRING)) AS ip_address",
        "nullif(regexp_extract(props, '[0-9]+', 0), '') AS device_id",
        "CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS login_status",
        "CASE WHEN event_type = 'signup' THEN 'ONBOARDING' ELSE 'LOGIN' END AS stage",
        "CAST(NULL AS STRING) AS document_hash")


def attempts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts of their customers; customers form small rings through shared attributes."""
    c = "o_custkey"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS record_id", "CAST(o_orderdate AS TIMESTAMP) AS ts",
        f"concat('C', {c}) AS claimed_user_ref", f"concat('ip', {c} div 150) AS ip_address",
        f"CASE WHEN {c} % 4 < 2 THEN concat('dev', {c} div 4) END AS device_id",
        f"CASE WHEN {c} % 9 < 2 THEN concat('+', 97150000000 + {c} div 9) END AS phone",
        f"CASE WHEN {c} % 14 < 3 THEN concat({c} div 28, ' Ring Rd, ', CASE ({c} div 28) % 3 "
        "WHEN 0 THEN 'UAE' WHEN 1 THEN 'India' ELSE 'Springfield' END) END AS address",
        f"concat('user', {c}, '@', CASE WHEN {c} % 37 = 0 THEN 'YOPMAIL.com' ELSE 'example.com' END) AS email",
        f"CASE WHEN {c} % 21 < 2 THEN concat('H', {c} div 21) END AS document_hash",
        "CASE WHEN o_orderkey % 25 = 0 THEN CAST((o_orderkey % 130) / 10.0 AS DOUBLE) END AS ela_score",
        f"CASE {c} % 50 WHEN 0 THEN '2015-06-01' WHEN 1 THEN '1/2/1880' ELSE '1980-05-05' END AS date_of_birth",
        "CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'NOT_SUBMITTED' END AS login_status",
        "CASE WHEN o_orderkey % 40 = 0 THEN 'FAIL' ELSE 'PASS' END AS liveness_status",
        "CASE o_orderstatus WHEN 'F' THEN 'CREDENTIAL_STUFFING' WHEN 'O' THEN 'LEGITIMATE' "
        "ELSE 'UNKNOWN' END AS scenario")


def presentations_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS record_id", "doc_id AS seq", "source AS claimed_user_ref",
        "sha2(text, 256) AS document_hash", "n_chars", "lang")


def people_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per customer, in key order, with the same shared attributes as the orders have."""
    c = "c_custkey"
    return table(spark, sf_dir, "customer").selectExpr(
        f"{c} AS record_id", f"{c} AS seq", f"concat('C', {c}) AS claimed_user_ref",
        f"concat('ip', {c} % 20) AS ip_address",
        f"CASE WHEN {c} % 4 < 2 THEN concat('dev', {c} div 4) END AS device_id",
        f"CASE WHEN {c} % 9 < 2 THEN concat('+', 97150000000 + {c} div 9) END AS phone",
        f"CASE WHEN {c} % 14 < 3 THEN concat({c} div 28, ' Ring Rd') END AS address",
        f"CASE WHEN {c} % 21 < 2 THEN concat('H', {c} div 21) END AS document_hash",
        "CASE WHEN c_acctbal < 0 THEN 'BLOCK' ELSE 'ALLOW' END AS decision")


def documented_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who show a document: names that differ, metadata flags, some without identity; nothing is shared."""
    c = "c_custkey"
    return table(spark, sf_dir, "customer").selectExpr(
        f"{c} AS record_id", f"timestamp_seconds(1700000000 + {c} * 60) AS ts",
        f"CASE WHEN {c} % 10 <> 0 THEN concat('C', {c}) END AS claimed_user_ref", "c_name AS full_name",
        f"CASE {c} % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN substr(c_name, 1, 9) WHEN 2 THEN 'Zzz' WHEN 4 THEN concat(c_name, 'x') END "
        "AS document_name",
        f"CASE WHEN {c} % 4 = 0 THEN CAST(({c} % 130) / 10.0 AS DOUBLE) END AS ela_score",
        f"CASE {c} % 7 WHEN 0 THEN array('x', 'Metadata names image editing software: GIMP') "
        "WHEN 1 THEN array('No EXIF metadata present') WHEN 2 THEN CAST(array() AS array<string>) END AS metadata_flags",
        f"{c} % 3 <> 0 AS has_forensics")


def results_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with labels and campaigns, each column a plain function of the order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS record_id", "o_orderkey AS seq", "concat('C', o_custkey) AS claimed_user_ref",
        "CASE WHEN o_orderkey % 83 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS ts",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'ERROR' ELSE 'OK' END AS status",
        "CAST((o_orderkey * 37 + o_custkey * 11) % 101 AS INT) AS risk_score",
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN (o_orderkey * 37 + o_custkey * 11) % 101 >= 70 "
        "THEN 'BLOCK' WHEN (o_orderkey * 37 + o_custkey * 11) % 101 >= 30 THEN 'STEP_UP' ELSE 'ALLOW' END "
        "AS decision",
        "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7 % 1000) / 1000.0D END AS fraud_probability",
        "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS label_is_fraud",
        "CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'LEGITIMATE' END AS label_category",
        "CASE WHEN o_orderstatus = 'F' THEN concat('K', o_custkey % 400) END AS campaign_id",
        "CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'LEGITIMATE' ELSE 'UNKNOWN' END "
        "AS scenario",
        "concat('H', o_custkey % 300) AS document_hash",
        "format_string('ATT-%05d', o_orderkey) AS attempt_ref").withColumn(
        "initial_decision", F.when((F.col("decision") == "ALLOW") & (F.col("record_id") % 11 == 0), "STEP_UP")
        .otherwise(F.col("decision")))


def campaigns_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS campaign_id", "turn AS record_id", "'OK' AS status",
        "timestamp_seconds(1700000000 + turn * 30) AS ts",
        "CASE WHEN role = 'assistant' THEN 'BLOCK' ELSE 'ALLOW' END AS decision")


def truth_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; the prediction challenges long texts."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id AS record_id", "'OK' AS status", "toxic = 1 AS label_is_fraud",
        "CASE WHEN toxic = 1 THEN upper(lang) ELSE 'LEGITIMATE' END AS label_category",
        "CAST(least(100, n_chars div 100) AS INT) AS risk_score",
        "CASE WHEN n_chars > 4000 THEN 'BLOCK' WHEN n_chars > 1500 THEN 'STEP_UP' ELSE 'ALLOW' END AS decision",
        "CAST(NULL AS DOUBLE) AS fraud_probability")


def pixels_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector read as a small picture, eight values wide."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_hash", "posexplode(embedding)") \
        .selectExpr("doc_hash", "pos % 8 AS x", "pos div 8 AS y", "abs(CAST(col AS DOUBLE)) AS error",
                    "CAST(pos % 5 AS DOUBLE) AS texture")
