"""Table bindings and SQL fragments the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import vocab

SEED = vocab.DEFAULT_SEED


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- bindings


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels: two binary targets, text sizes as numbers, language and source."""
    docs = load(spark, sf, "documents")
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    sized = docs.select("doc_id", "lang", "source", "n_chars", spaces.cast("bigint").alias(
        "n_spaces"))
    return load(spark, sf, "labels").join(sized, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("bigint").alias("quality"),
        F.col("toxic").cast("bigint").alias("toxic"), "lang", "source", "n_chars", "n_spaces")


LABELLED = """labelled AS (
  SELECT l.doc_id AS row_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic,
         lang, source, n_chars,
         CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS n_spaces
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderpriority")


ORDERS = """ord AS (
  SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
  FROM orders)"""


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), "c_nationkey", "c_acctbal", "c_mktsegment")


CUSTOMERS = """cust AS (
  SELECT c_custkey AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM customer)"""

# ---------------------------------------------------------------- review log bound to orders
#
# run = customer, objection = order, disposition event = order line.

CATEGORY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'leakage'
  WHEN '2-HIGH' THEN 'contamination' WHEN '3-MEDIUM' THEN 'overfit'
  WHEN '4-NOT SPECIFIED' THEN 'implausible_importance' ELSE 'other' END"""
NAMED = "CASE WHEN o_totalprice < 150000 THEN 'price_low' WHEN o_totalprice < 350000 " \
        "THEN 'price_mid' ELSE 'price_high' END"

RUNS = """runs AS (
  SELECT c_custkey AS run_id,
         CASE WHEN c_nationkey < 12 THEN 'by_category' ELSE 'as_addressed' END
           AS objection_routing,
         CASE WHEN c_acctbal < 2000 THEN 'resolved_or_withdrawn' ELSE 'withdrawn_only' END
           AS forced_drop_release,
         c_mktsegment, c_acctbal
  FROM customer)"""
OBJECTIONS = f"""objections AS (
  SELECT o_custkey AS run_id, o_orderkey AS objection_id, {CATEGORY} AS category,
         CASE WHEN o_orderstatus = 'F' THEN 'modeler' ELSE 'feature_eng' END AS target_node,
         {NAMED} AS named, 'status_' || o_orderstatus AS status_name
  FROM orders)"""
DISPOSITIONS = """dispositions AS (
  SELECT o_custkey AS run_id, l_orderkey AS objection_id, l_linenumber AS iteration,
         CASE WHEN l_returnflag = 'R' THEN 'resolved'
              WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'withdrawn'
              WHEN l_returnflag = 'A' THEN 'not_reviewed' ELSE 'still_open' END AS disposition
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LATEST = """latest AS (
  SELECT run_id, objection_id, disposition, iteration FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, objection_id
                                 ORDER BY iteration DESC, disposition DESC) AS rn
    FROM dispositions) WHERE rn = 1)"""
ACTING = """acting AS (
  SELECT o.*, r.objection_routing, r.forced_drop_release,
         CASE WHEN r.objection_routing = 'by_category'
               AND o.category IN ('leakage', 'contamination', 'implausible_importance')
              THEN 'feature_eng' ELSE o.target_node END AS acting_node
  FROM objections o LEFT JOIN runs r ON o.run_id = r.run_id)"""
REVIEW = f"{RUNS}, {OBJECTIONS}, {DISPOSITIONS}, {LATEST}, {ACTING}"


def runs_of(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_nationkey") < 12, "by_category").otherwise("as_addressed").alias(
            "objection_routing"),
        F.when(F.col("c_acctbal") < 2000, "resolved_or_withdrawn").otherwise(
            "withdrawn_only").alias("forced_drop_release"), "c_mktsegment", "c_acctbal")


def objections_of(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("objection_id"),
        F.expr(CATEGORY).alias("category"),
        F.when(F.col("o_orderstatus") == "F", "modeler").otherwise("feature_eng").alias(
            "target_node"),
        F.array(F.expr(NAMED), F.concat(F.lit("status_"), "o_orderstatus")).alias("columns"),
        F.lit(0).alias("raised_at_iteration"))


def dispositions_of(spark: SparkSession, sf: str) -> DataFrame:
    kind = (
        F.when(F.col("l_returnflag") == "R", "resolved")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "withdrawn")
        .when(F.col("l_returnflag") == "A", "not_reviewed").otherwise("still_open"))
    lines = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("objection_id"), F.col("l_linenumber").alias("iteration"),
        kind.alias("disposition"))
    owners = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("objection_id"), F.col("o_custkey").alias("run_id"))
    return lines.join(owners, "objection_id")


# ---------------------------------------------------------------- result rows bound to events
#
# One event is one run's results row: dataset = event type, replicate = week, the metrics are
# booleans that are missing for some rows.

EVENT_ROWS = """ev AS (
  SELECT event_id AS run_id, event_type AS dataset_id,
         CASE WHEN user_id < 40 THEN 'team' WHEN user_id < 80 THEN 'single_agent' END AS arm,
         CAST(day(ts) // 7 AS BIGINT) AS replicate,
         CASE WHEN value >= 5 THEN value >= 60 END AS leakage_caught,
         CASE WHEN value >= 20 THEN event_type <> 'error' AND value < 90 END AS leakage_remediated,
         CASE WHEN event_type = 'error' AND value > 100 THEN 'modeler' END AS halted_at,
         event_type = 'error' AS errored, value AS cost_usd, ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    value, kind = F.col("value"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("run_id"), kind.alias("dataset_id"),
        F.when(F.col("user_id") < 40, "team").when(F.col("user_id") < 80, "single_agent").alias(
            "arm"),
        F.floor(F.dayofmonth("ts") / 7).cast("bigint").alias("replicate"),
        F.when(value >= 5, value >= 60).alias("leakage_caught"),
        F.when(value >= 20, (kind != "error") & (value < 90)).alias("leakage_remediated"),
        F.when((kind == "error") & (value > 100), "modeler").alias("halted_at"),
        (kind == "error").alias("errored"), value.alias("cost_usd"), "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---------------------------------------------------------------- SQL fragments


def sql_draw(identity: str, salt: str = "", seed: int = SEED) -> str:
    return (f"CAST('0x' || substr(md5('{seed}{salt}|' || CAST({identity} AS VARCHAR)), 1, 13) "
            "AS BIGINT)")


def sql_double_text(column: str) -> str:
    """A double as its row's digest reads it: the shortest digits, an exponent below 1e-3 and from
    1e7 on, both zeros as 0.0, NULL for NaN."""
    plain = f"CAST(abs({column}) AS VARCHAR)"
    digits = f"replace(split_part({plain}, 'e', 1), '.', '')"
    lead = f"ltrim({digits}, '0')"
    power = (f"coalesce(TRY_CAST(split_part({plain}, 'e', 2) AS INTEGER), 0) - 1 - length({digits}) + length({lead})"
             f" + length(split_part(split_part({plain}, 'e', 1), '.', 1))")
    rest = f"coalesce(nullif(rtrim(substr({lead}, 2), '0'), ''), '0')"
    return f"""CASE WHEN isnan({column}) THEN NULL WHEN {column} = 0 THEN '0.0'
        WHEN isinf({column}) THEN CASE WHEN {column} > 0 THEN 'Infinity' ELSE '-Infinity' END
        WHEN abs({column}) >= 1e-3 AND abs({column}) < 1e7 THEN CAST({column} AS VARCHAR)
        ELSE CASE WHEN {column} < 0 THEN '-' ELSE '' END || substr({lead}, 1, 1) || '.' || {rest}
          || 'E' || ({power}) END"""


def sql_code(rel: str, column: str, identity: str = "row_id") -> str:
    """(identity, code) of one numeric column: its equal-frequency bin or its string form."""
    return f"""SELECT {identity}, CASE WHEN {column} IS NULL THEN '<MISSING>'
      WHEN d > 12 THEN CAST(greatest(((r - 1) * 10 + (m - 2)) // (m - 1) - 1, 0) AS VARCHAR)
      ELSE CAST({column} AS VARCHAR) END AS code
    FROM (SELECT {identity}, {column},
            row_number() OVER (PARTITION BY {column} IS NULL ORDER BY {column}, {identity}) AS r,
            count({column}) OVER () AS m, (SELECT count(DISTINCT {column}) FROM {rel}) AS d
          FROM {rel})"""


def sql_text_code(rel: str, column: str, identity: str = "row_id") -> str:
    return f"SELECT {identity}, coalesce(CAST({column} AS VARCHAR), '<MISSING>') AS code FROM {rel}"


def sql_nmi(rel: str, target: str, numeric: list[str], text: list[str],
            target_numeric: bool = True, identity: str = "row_id") -> str:
    """(column, nmi) for every listed column; ``rel`` is a CTE defined by the caller."""
    code = sql_code if target_numeric else sql_text_code
    branches = [(c, sql_code(rel, c, identity)) for c in numeric] + [
        (c, sql_text_code(rel, c, identity)) for c in text]
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {identity}, code FROM ({q})" for c, q in branches)
    return f"""
    tcode AS ({code(rel, target, identity)}),
    cells AS ({cells}),
    g AS (SELECT c."column", t.code AS t, c.code AS x, count(*) AS n
          FROM cells c JOIN tcode t ON c.{identity} = t.{identity} GROUP BY 1, 2, 3),
    s AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total,
                 sum(n) OVER (PARTITION BY "column", t) AS nt,
                 sum(n) OVER (PARTITION BY "column", x) AS nx FROM g),
    p AS (SELECT "column", sum(n / total * ln(n * total / (nt * nx))) AS mi,
                 -sum(n / total * ln(nt / total)) AS ht, -sum(n / total * ln(nx / total)) AS hx
          FROM (SELECT "column", CAST(n AS DOUBLE) AS n, CAST(total AS DOUBLE) AS total,
                       CAST(nt AS DOUBLE) AS nt, CAST(nx AS DOUBLE) AS nx FROM s) GROUP BY 1),
    nmi AS (SELECT "column", CASE WHEN ht = 0 AND hx = 0 THEN 1.0
                 WHEN mi <= 1e-12 THEN 0.0 ELSE round(mi / ((ht + hx) / 2), 4) END AS nmi FROM p)"""


def sql_profile(rel: str, columns: dict[str, str], width: int) -> str:
    """Profile branches; ``columns`` maps a name to the dtype it reads as."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS dtype,
        round(1 - count({c}) / count(*), 6) AS missing_fraction,
        count(DISTINCT {c}) AS n_unique, count(*) AS n_rows, CAST({width} AS BIGINT) AS n_columns
        FROM {rel}""" for c, kind in columns.items())
