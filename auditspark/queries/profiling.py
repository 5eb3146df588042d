"""Queries over profiling, association, naming and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions import exprs, vocab
from auditspark.operators import naming, profile, transform
from auditspark.queries.common import (
    CUSTOMERS, LABELLED, OBJECTIONS, ORDERS, customers, event_rows, labelled, load, objections_of,
    orders, sql_code, sql_double_text, sql_draw, sql_nmi, sql_profile, sql_text_code, EVENT_ROWS,
)
from auditspark.sources import fingerprint, registry, tables

FEATURES = ["toxic", "lang", "source", "n_chars", "n_spaces"]
KINDS = {"row_id": "int64", "quality": "int64", "toxic": "int64", "lang": "object",
         "source": "object", "n_chars": "int64", "n_spaces": "int64"}


def audit_view(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every column's profile beside its association with the label."""
    df = labelled(spark, sf)
    profiled = profile.column_profile(df)
    associated = profile.association(df.withColumn("__id", F.col("row_id")), "quality",
                                     ["row_id", *FEATURES], row_id="__id")
    return profile.evidence(profiled, associated, "quality").select(
        "column", "dtype", F.round("missing_fraction", 6).alias("missing_fraction"), "n_unique",
        "nmi", profile.id_like().alias("id_like"))


def column_profile_labelled(spark, sf):
    return profile.column_profile(labelled(spark, sf)).withColumn(
        "missing_fraction", F.round("missing_fraction", 6))


def column_profile_lineitem(spark, sf):
    return profile.column_profile(load(spark, sf, "lineitem")).withColumn(
        "missing_fraction", F.round("missing_fraction", 6))


LINE_KINDS = {
    "l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int64",
    "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64",
    "l_tax": "float64", "l_returnflag": "object", "l_linestatus": "object", "l_shipdate": "object"}


def nullable_profile_events(spark, sf):
    """Columns that are partly missing, including an integer that then reads as a float."""
    rows = event_rows(spark, sf).select(
        "arm", "leakage_caught", F.when(F.col("k") > 20, F.col("k")).alias("k_some"), "halted_at")
    return profile.column_profile(rows).withColumn(
        "missing_fraction", F.round("missing_fraction", 6))


def profile_documents(spark, sf):
    """Whole texts are profiled: distinct counts, missing shares, row counts."""
    return profile.column_profile(load(spark, sf, "documents")).withColumn(
        "missing_fraction", F.round("missing_fraction", 6))


def catalog_orders(spark, sf):
    return profile.table_catalog(load(spark, sf, "orders"))


def sample_values_events(spark, sf):
    df = load(spark, sf, "events").withColumn("row_id", F.col("event_id"))
    return profile.sample_values(df, ["event_type", "user_id", "props", "value"])


def _sample_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column",
      row_number() OVER (ORDER BY min(event_id)) AS position, CAST({column} AS VARCHAR) AS value
    FROM events WHERE {column} IS NOT NULL GROUP BY {column}"""


def balance_orders(spark, sf):
    return profile.target_balance(load(spark, sf, "orders"), "o_orderstatus")


def discretize_orders(spark, sf):
    return profile.discretize(
        orders(spark, sf), ["o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus"])


def _big_orders(spark, sf):
    """Keys that doubles do not tell apart, against the order of the rows, with equal ones among them."""
    keys = F.lit(1 << 60) - F.floor(F.col("row_id") / 3)
    return orders(spark, sf).select("row_id", keys.cast("bigint").alias("big"), F.expr(
        "CAST(CAST(100000000000000000 + o_custkey AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(18,2))").alias("amount"),
        "o_totalprice")


def discretize_big_values(spark, sf):
    return profile.discretize(_big_orders(spark, sf), ["big", "amount", "o_totalprice"])


def discretize_events_with_missing(spark, sf):
    rows = event_rows(spark, sf).select(
        F.col("run_id").alias("row_id"), F.when(F.col("k") > 20, F.col("k")).alias("k"), "arm")
    return profile.discretize(rows, ["k", "arm"])


def association_labelled(spark, sf):
    return profile.association(labelled(spark, sf), "quality", FEATURES).select("column", "nmi")


def association_toxic(spark, sf):
    return profile.association(
        labelled(spark, sf), "toxic", ["quality", "lang", "source", "n_chars", "n_spaces"]
    ).select("column", "nmi")


def association_orders(spark, sf):
    return profile.association(orders(spark, sf), "o_orderstatus").select("column", "nmi")


def association_events(spark, sf):
    """Numeric target: binned like any other numeric column."""
    df = load(spark, sf, "events").withColumn("row_id", F.col("event_id"))
    return profile.association(df, "value", ["event_type", "user_id", "props"]).select(
        "column", "nmi")


LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
LINE_ALL = [*LINE_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem_identified(spark, sf):
    """Order lines carry no unique key; a hash of the whole row orders equal values."""
    df = load(spark, sf, "lineitem")
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in LINE_ALL])
    return df.withColumn("row_id", exprs.draw(vocab.DEFAULT_SEED, text))


def association_lineitem(spark, sf):
    return profile.association(lineitem_identified(spark, sf), "l_linestatus").select(
        "column", "nmi")


def association_embeddings(spark, sf):
    """A column type without levels is reported with its reason, not scored as clean."""
    df = load(spark, sf, "embeddings").withColumn("row_id", F.col("vec_id"))
    return profile.association(df.withColumn("vec", F.col("vec_id") + 0), "label",
                               ["vec", "embedding"])


def usable_features_orders(spark, sf):
    return profile.usable_features(
        profile.column_profile(load(spark, sf, "orders")), "o_orderstatus").select(
            "column", "n_unique")


def minority_labelled(spark, sf):
    return profile.minority_class(labelled(spark, sf), "quality")


def measure_labelled(spark, sf):
    return profile.measure_table(labelled(spark, sf), "quality").select(
        "n_rows", "n_features", "n_classes", "n_usable_features", "positive_class",
        "positive_rate", "failed")


def measure_orders(spark, sf):
    return profile.measure_table(load(spark, sf, "orders"), "o_orderstatus").select(
        "n_rows", "n_features", "n_classes", "failed")


def agreement_quality_toxic(spark, sf):
    return labelled(spark, sf).groupBy("lang").agg(F.round(profile.agreement(
        F.col("toxic"), F.col("quality")), 6).alias("agreement"))


def class_guard_orders(spark, sf):
    parts = [profile.class_guard(load(spark, sf, "orders"), c, n).withColumn(
        "target", F.lit(f"{c}>={n}")) for c, n in (("o_orderstatus", 10), ("o_orderstatus", 10**9))]
    constant = load(spark, sf, "orders").withColumn("one", F.lit("x"))
    parts.append(profile.class_guard(constant, "one").withColumn("target", F.lit("one")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scoring_rows_labelled(spark, sf):
    return profile.scoring_rows(labelled(spark, sf), "toxic")


def positive_class_orders(spark, sf):
    df = load(spark, sf, "orders")
    asked = [None, "F", "nope"]
    frames = [profile.resolve_positive(df, "o_orderstatus", a).withColumn(
        "requested", F.lit(a).cast("string")) for a in asked]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def encoded_target_orders(spark, sf):
    df = orders(spark, sf)
    binary = profile.encode_target(df, "o_orderstatus", "binary", "P")
    multi = profile.encode_target(binary, "o_orderstatus", "multiclass", output="m")
    number = profile.encode_target(multi, "o_orderpriority", "regression", output="r")
    return number.select("row_id", F.col("y").cast("bigint").alias("y"), "m", "r")


def labelled_rows_events(spark, sf):
    rows = event_rows(spark, sf)
    kept = profile.labelled_rows(rows, "leakage_caught").agg(F.count("*").alias("kept"))
    lost = profile.missing_label_count(rows, "leakage_caught")
    return kept.withColumn("part", F.lit("kept")).withColumnRenamed("kept", "n").unionByName(
        lost.withColumn("part", F.lit("lost")).withColumnRenamed("dropped_missing_target", "n"))


def coerced_numbers_part(spark, sf):
    df = load(spark, sf, "part")
    brand = F.regexp_replace("p_brand", "Brand#", "")
    return df.select("p_partkey", exprs.to_number(brand).alias("brand_no"),
                     exprs.to_number(F.col("p_type")).alias("type_no"))


def column_kinds_orders(spark, sf):
    df = load(spark, sf, "orders").drop("o_orderdate").join(
        load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"),
        "o_custkey")
    rows = []
    for cap, name in ((vocab.MAX_LEVELS, "capped"), (None, "uncapped")):
        for kind, names in profile.classify_columns(df, "o_orderstatus", cap=cap).items():
            rows += [(name, c, kind) for c in names]
    return spark.createDataFrame(rows, "rule string, column string, kind string")


def metric_predicates_events(spark, sf):
    rows = event_rows(spark, sf)
    specs = ["leakage_caught", "halted_at:notnull", "halted_at:isnull", "k", "dataset_id"]
    wide = rows.agg(*[F.struct(
        F.count_if(exprs.metric_outcome(rows, s)).alias("hits"),
        F.count(exprs.metric_outcome(rows, s)).alias("n")).alias(f"c{i}")
        for i, s in enumerate(specs)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("metric"), F.col(f"c{i}.hits").alias("hits"),
                 F.col(f"c{i}.n").alias("n")) for i, s in enumerate(specs)])).alias("s")).select(
                     "s.*")


def opaque_customer(spark, sf):
    return naming.opaque_names(load(spark, sf, "customer"), "c_mktsegment")


def renamed_columns_orders(spark, sf):
    mapping = naming.rename_map(["price_low", "price_mid", "price_high", "y"], "y")
    return objections_of(spark, sf).select("objection_id", F.array_join(
        naming.rename_names(F.col("columns"), mapping), ",").alias("columns"))


def slug_part_type(spark, sf):
    df = load(spark, sf, "part")
    return df.select(exprs.slug(F.concat_ws(" -- ", "p_brand", "p_name", "p_type")).alias("slug")
                     ).groupBy("slug").agg(F.count("*").alias("n"))


def truncated_documents(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", F.md5(exprs.truncate(F.col("text"))).alias("digest"),
        F.length(exprs.truncate(F.col("text"), 40)).cast("bigint").alias("short"))


def validated_objections(spark, sf):
    rows = objections_of(spark, sf).withColumn("columns", F.when(
        F.size(F.filter("columns", lambda c: c == "price_low")) > 0, F.array().cast(
            "array<string>")).otherwise(F.col("columns")))
    _, bad = tables.validate(rows, tables.objection_rules())
    return bad.groupBy("reason", "category").agg(F.count("*").alias("n"))


def fingerprint_customer(spark, sf):
    return fingerprint.table_fingerprint(load(spark, sf, "customer"))


def fingerprint_documents(spark, sf):
    return fingerprint.table_fingerprint(load(spark, sf, "documents"))


def row_identity_part(spark, sf):
    return tables.with_row_id(load(spark, sf, "part"), order_by=["p_brand", "p_name", "p_partkey"]
                              ).select("row_id", "p_partkey", "p_name")


def missing_tokens_part(spark, sf):
    df = load(spark, sf, "part").withColumn("p_type", F.when(
        F.col("p_type") == "ECONOMY", "N/A").when(F.col("p_type") == "PROMO", "").otherwise(
            F.col("p_type")))
    return tables.normalise_missing(df).groupBy("p_type").agg(F.count("*").alias("n"))


def table_diff_orders(spark, sf):
    a = load(spark, sf, "orders")
    b = (a.filter(F.col("o_orderpriority") != "5-LOW")
         .withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F",
                                            F.col("o_totalprice") + 1).otherwise(
                                                F.col("o_totalprice"))))
    return tables.table_diff(a, b, ["o_orderkey"]).select(
        "o_orderkey", "change", F.array_join("columns", ",").alias("columns"))


def _registries(spark, sf):
    parts = load(spark, sf, "part").groupBy("p_brand").agg(
        F.count("*").alias("n_rows"), F.count_distinct("p_type").alias("n_features"),
        F.round(F.avg("p_size"), 6).alias("positive_rate"))
    suppliers = load(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count("*").alias("n_rows"), F.lit(3).cast("bigint").alias("n_features"),
        F.round(F.avg("s_acctbal"), 6).alias("positive_rate"))
    a = parts.withColumn("dataset_id", exprs.slug(F.col("p_brand"))).withColumn(
        "target", F.lit("p_size")).drop("p_brand")
    b = suppliers.withColumn("dataset_id", F.concat(F.lit("nation_"), "s_nationkey")).withColumn(
        "target", F.lit("s_acctbal")).drop("s_nationkey")
    return a, b


def registry_union(spark, sf):
    a, b = _registries(spark, sf)
    return registry.listing(registry.combine(fixture=a, benchmark=b))


def forced_drops_customer(spark, sf):
    df = load(spark, sf, "customer")
    binding = objections_binding(spark, sf)
    return transform.forced_drops(profile.column_profile(df), "c_mktsegment", binding)


def objections_binding(spark, sf):
    """Columns named by urgent orders of any customer, mapped to customer columns."""
    named = load(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.when(F.col("o_orderstatus") == "F", "c_acctbal").when(
            F.col("o_orderstatus") == "O", "c_name").otherwise("c_mktsegment").alias("column"))
    return named.groupBy("column").agg(F.count("*").alias("n")).select("column")


def merged_drops_customer(spark, sf):
    df = load(spark, sf, "customer")
    profiled = profile.column_profile(df)
    forced = transform.forced_drops(profiled, "c_mktsegment")
    proposed = load(spark, sf, "nation").select(F.when(
        F.col("n_regionkey") == 0, "c_acctbal").when(F.col("n_regionkey") == 1, "c_name").otherwise(
            F.concat(F.lit("ghost_"), "n_regionkey")).alias("column"))
    kept = proposed.unionByName(spark.createDataFrame([("c_nationkey",)], "column string"))
    return transform.merge_drops(profiled, forced, proposed, kept)


def valid_nominations_orders(spark, sf):
    nominated = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.concat(F.lit("o_"), F.lower(F.regexp_extract("o_orderpriority", "-(.*)", 1))).alias("raw"),
        "o_orderstatus").withColumn("column", F.when(
            F.col("o_orderstatus") == "F", "o_custkey").when(
                F.col("o_orderstatus") == "O", "o_orderstatus").otherwise(F.col("raw")))
    profiled = profile.column_profile(load(spark, sf, "orders"))
    return transform.valid_nominations(nominated, profiled, "o_orderstatus").groupBy(
        "column").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    column_profile_labelled, column_profile_lineitem, nullable_profile_events, profile_documents,
    catalog_orders, sample_values_events, balance_orders, discretize_orders, discretize_big_values,
    discretize_events_with_missing, association_labelled, association_toxic, association_orders,
    association_events, association_lineitem, association_embeddings, usable_features_orders,
    minority_labelled, measure_labelled, measure_orders, agreement_quality_toxic,
    class_guard_orders, scoring_rows_labelled, positive_class_orders, encoded_target_orders,
    labelled_rows_events, coerced_numbers_part, column_kinds_orders, metric_predicates_events,
    opaque_customer, renamed_columns_orders, slug_part_type, truncated_documents,
    validated_objections, fingerprint_customer, fingerprint_documents, row_identity_part,
    missing_tokens_part, table_diff_orders, registry_union, forced_drops_customer,
    merged_drops_customer, valid_nominations_orders)}
QUERIES["audit_view_labelled"] = audit_view

_DIGEST = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "documents": "doc_id text lang source n_chars"}
_DOUBLES = ("c_acctbal",)


def _fingerprint_sql(table: str) -> str:
    values = ", ".join(f"coalesce({sql_double_text(c) if c in _DOUBLES else f'CAST({c} AS VARCHAR)'}, '\\N')"
                       for c in _DIGEST[table].split())
    return f"""WITH d AS (SELECT md5(concat_ws('|', {values})) AS h FROM {table})
    SELECT count(*) AS n_rows,
           bit_xor(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS xor_head,
           CAST(sum(CAST('0x' || substr(h, 13, 7) AS BIGINT)) AS BIGINT) AS sum_tail FROM d"""


_LINE_ID = f"""ln AS (SELECT *, {sql_draw("concat_ws('|', " + ", ".join(LINE_ALL) + ")")} AS row_id
  FROM lineitem)"""
_EV_SOME = f"""{EVENT_ROWS}, evs AS (SELECT run_id AS row_id, arm, leakage_caught, halted_at,
  CASE WHEN k > 20 THEN k END AS k_some FROM ev)"""

ORACLES = {
    "audit_view_labelled": f"""WITH {LABELLED},
      {sql_nmi('labelled', 'quality', ['row_id2', 'toxic', 'n_chars', 'n_spaces'],
               ['lang', 'source']).replace('row_id2', 'row_id')},
      prof AS ({sql_profile('labelled', KINDS, 7)})
      SELECT p."column", dtype, missing_fraction, n_unique, nmi,
             dtype NOT LIKE '%float%' AND n_unique >= 0.98 * n_rows AS id_like
      FROM prof p LEFT JOIN nmi n ON p."column" = n."column" WHERE p."column" <> 'quality'""",
    "column_profile_labelled": f"WITH {LABELLED} {sql_profile('labelled', KINDS, 7)}",
    "column_profile_lineitem": sql_profile("lineitem", LINE_KINDS, 11),
    "nullable_profile_events": f"WITH {_EV_SOME} " + sql_profile("evs", {
        "arm": "object", "leakage_caught": "object", "k_some": "float64", "halted_at": "object"},
        4),
    "profile_documents": sql_profile("documents", {
        "doc_id": "int64", "text": "object", "lang": "object", "source": "object",
        "n_chars": "int64"}, 5),
    "catalog_orders": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(DISTINCT {c}) AS n_unique,
        count(*) AS n_rows FROM orders""" for c, k in {
            "o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object",
            "o_totalprice": "float64", "o_orderdate": "object",
            "o_orderpriority": "object"}.items()),
    "sample_values_events": "SELECT * FROM (" + " UNION ALL ".join(
        _sample_sql(c) for c in ("event_type", "user_id", "props", "value"))
        + ") WHERE position <= 5",
    "balance_orders": """SELECT o_orderstatus AS label,
      round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1""",
    "discretize_orders": f"""WITH {ORDERS}
      SELECT a.row_id, a.code AS o_totalprice, b.code AS o_custkey, o.o_orderpriority,
             o.o_orderstatus
      FROM ({sql_code('ord', 'o_totalprice')}) a JOIN ({sql_code('ord', 'o_custkey')}) b
        ON a.row_id = b.row_id JOIN ord o ON o.row_id = a.row_id""",
    "discretize_big_values": f"""WITH {ORDERS}, bg AS (
        SELECT row_id, 1152921504606846976 - row_id // 3 AS big, o_totalprice,
               CAST(CAST(100000000000000000 + o_custkey AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS amount FROM ord)
      SELECT row_id, a.code AS big, b.code AS amount, c.code AS o_totalprice
      FROM ({sql_code('bg', 'big')}) a JOIN ({sql_code('bg', 'amount')}) b USING (row_id)
      JOIN ({sql_code('bg', 'o_totalprice')}) c USING (row_id)""",
    "discretize_events_with_missing": f"""WITH {_EV_SOME}
      SELECT a.row_id, a.code AS k, b.code AS arm FROM ({sql_code('evs', 'k_some')}) a
      JOIN ({sql_text_code('evs', 'arm')}) b ON a.row_id = b.row_id""",
    "association_labelled": f"""WITH {LABELLED}, {sql_nmi(
        'labelled', 'quality', ['toxic', 'n_chars', 'n_spaces'], ['lang', 'source'])}
      SELECT * FROM nmi""",
    "association_toxic": f"""WITH {LABELLED}, {sql_nmi(
        'labelled', 'toxic', ['quality', 'n_chars', 'n_spaces'], ['lang', 'source'])}
      SELECT * FROM nmi""",
    "association_orders": f"""WITH {ORDERS}, {sql_nmi(
        'ord', 'o_orderstatus', ['o_custkey', 'o_totalprice'], ['o_orderpriority'], False)}
      SELECT * FROM nmi""",
    "association_events": f"""WITH e AS (SELECT *, event_id AS row_id FROM events), {sql_nmi(
        'e', 'value', ['user_id'], ['event_type', 'props'])} SELECT * FROM nmi""",
    "association_lineitem": f"""WITH {_LINE_ID}, {sql_nmi(
        'ln', 'l_linestatus', LINE_NUMERIC, ['l_returnflag', 'l_shipdate'], False)}
      SELECT * FROM nmi""",
    "association_embeddings": f"""WITH e AS (SELECT vec_id AS row_id, vec_id AS vec, label
        FROM embeddings), {sql_nmi('e', 'label', ['vec'], [])}
      SELECT "column", nmi, CAST(NULL AS VARCHAR) AS error FROM nmi
      UNION ALL SELECT 'embedding', NULL, 'unsupported type: array<float>'""",
    "usable_features_orders": f"""SELECT "column", n_unique FROM ({sql_profile('orders', {
        "o_orderkey": "int64", "o_custkey": "int64", "o_totalprice": "float64",
        "o_orderdate": "object", "o_orderpriority": "object"}, 6)})
      WHERE NOT (dtype NOT LIKE '%float%' AND n_unique >= 0.98 * n_rows)
        AND NOT (dtype = 'object' AND n_unique > 20)""",
    "minority_labelled": f"""WITH {LABELLED} SELECT CAST(quality AS VARCHAR) AS positive_class,
      round(count(*) / (SELECT count(*) FROM labelled), 6) AS positive_rate
      FROM labelled GROUP BY quality ORDER BY count(*), 1 LIMIT 1""",
    "measure_labelled": f"""WITH {LABELLED}, prof AS ({sql_profile('labelled', KINDS, 7)}),
      least AS (SELECT CAST(quality AS VARCHAR) AS c, count(*) AS n FROM labelled GROUP BY 1
                ORDER BY 2, 1 LIMIT 1)
      SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_features,
        count(DISTINCT quality) AS n_classes,
        (SELECT count(*) FROM prof WHERE "column" <> 'quality'
          AND NOT (dtype NOT LIKE '%float%' AND n_unique >= 0.98 * n_rows)
          AND NOT (dtype = 'object' AND n_unique > 20)) AS n_usable_features,
        (SELECT c FROM least) AS positive_class,
        round((SELECT n FROM least) / count(*), 6) AS positive_rate,
        CAST(NULL AS VARCHAR) AS failed FROM labelled""",
    "measure_orders": """SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_features,
      count(DISTINCT o_orderstatus) AS n_classes, 'task_type' AS failed FROM orders""",
    "agreement_quality_toxic": f"""WITH {LABELLED} SELECT lang,
      round(avg(CASE WHEN toxic = quality THEN 1.0 ELSE 0.0 END), 6) AS agreement
      FROM labelled GROUP BY 1""",
    "class_guard_orders": """
      SELECT count(*) AS n_rows, true AS several_classes, CAST(NULL AS VARCHAR) AS refused,
             'o_orderstatus>=10' AS target FROM orders
      UNION ALL SELECT count(*), true, 'too few rows', 'o_orderstatus>=1000000000' FROM orders
      UNION ALL SELECT count(*), false, 'fewer than two classes', 'one' FROM orders""",
    "scoring_rows_labelled": f"""WITH {LABELLED} SELECT count(toxic) AS n_rows,
      CAST(sum(toxic) AS BIGINT) AS n_positive, min(toxic) = max(toxic) AS single_class
      FROM labelled""",
    "positive_class_orders": """
      SELECT max(o_orderstatus) AS used, false AS mismatch, CAST(NULL AS VARCHAR) AS requested
      FROM orders UNION ALL
      SELECT 'F', false, 'F' UNION ALL SELECT max(o_orderstatus), true, 'nope' FROM orders""",
    "encoded_target_orders": f"""WITH {ORDERS} SELECT row_id,
      CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS BIGINT) AS y, o_orderstatus AS m,
      TRY_CAST(o_orderpriority AS DOUBLE) AS r FROM ord""",
    "labelled_rows_events": f"""WITH {EVENT_ROWS}
      SELECT count(leakage_caught) AS n, 'kept' AS part FROM ev
      UNION ALL SELECT count(*) - count(leakage_caught), 'lost' FROM ev""",
    "coerced_numbers_part": """SELECT p_partkey,
      TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no,
      TRY_CAST(p_type AS DOUBLE) AS type_no FROM part""",
    "column_kinds_orders": """WITH j AS (SELECT o.*, c_name FROM orders o JOIN customer c
        ON o_custkey = c_custkey), d AS (
        SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS d FROM j
        UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM j)
      SELECT 'capped' AS rule, "column",
             CASE WHEN d <= 20 THEN 'categorical' ELSE 'skipped' END AS kind FROM d
      UNION ALL SELECT 'uncapped', "column", 'categorical' FROM d
      UNION ALL SELECT r.rule, n."column", 'numeric' FROM (VALUES ('capped'), ('uncapped')) r(rule),
        (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) n("column")""",
    "metric_predicates_events": f"""WITH {EVENT_ROWS}
      SELECT 'leakage_caught' AS metric, count(*) FILTER (WHERE leakage_caught) AS hits,
             count(leakage_caught) AS n FROM ev
      UNION ALL SELECT 'halted_at:notnull', count(halted_at), count(*) FROM ev
      UNION ALL SELECT 'halted_at:isnull', count(*) - count(halted_at), count(*) FROM ev
      UNION ALL SELECT 'k', count(*) FILTER (WHERE k <> 0), count(k) FROM ev
      UNION ALL SELECT 'dataset_id', count(*) FILTER (WHERE dataset_id <> ''), count(dataset_id)
        FROM ev""",
    "opaque_customer": """SELECT c_custkey AS var_01, c_name AS var_02, c_nationkey AS var_03,
      c_acctbal AS var_04, c_mktsegment FROM customer""",
    "renamed_columns_orders": f"""WITH {OBJECTIONS} SELECT objection_id, CASE named
      WHEN 'price_low' THEN 'var_01' WHEN 'price_mid' THEN 'var_02' ELSE 'var_03' END || ','
      || status_name AS columns FROM objections""",
    "slug_part_type": """SELECT trim(regexp_replace(lower(
        p_brand || ' -- ' || p_name || ' -- ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
      count(*) AS n FROM part GROUP BY 1""",
    "truncated_documents": """SELECT doc_id, md5(substr(text, 1, 500)) AS digest,
      CAST(length(substr(text, 1, 40)) AS BIGINT) AS short FROM documents""",
    "validated_objections": f"""WITH {OBJECTIONS} SELECT 'column_required' AS reason, category,
      count(*) AS n FROM objections WHERE named = 'price_low'
        AND category IN ('leakage', 'contamination', 'implausible_importance') GROUP BY 2""",
    "fingerprint_customer": _fingerprint_sql("customer"),
    "fingerprint_documents": _fingerprint_sql("documents"),
    "row_identity_part": """SELECT row_number() OVER (ORDER BY p_brand, p_name, p_partkey) - 1
      AS row_id, p_partkey, p_name FROM part""",
    "missing_tokens_part": """SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN NULL
      ELSE p_type END AS p_type, count(*) AS n FROM part GROUP BY 1""",
    "table_diff_orders": """SELECT o_orderkey,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'o_totalprice' END AS columns
      FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'F'""",
    "registry_union": """SELECT lower(replace(p_brand, '#', '_')) AS dataset_id,
        'fixture' AS dataset_source, 'p_size' AS target, count(*) AS n_rows,
        count(DISTINCT p_type) AS n_features, round(avg(p_size), 6) AS positive_rate
      FROM part GROUP BY p_brand
      UNION ALL SELECT 'nation_' || s_nationkey, 'benchmark', 's_acctbal', count(*),
        CAST(3 AS BIGINT), round(avg(s_acctbal), 6) FROM supplier GROUP BY s_nationkey""",
    "forced_drops_customer": f"""WITH prof AS ({sql_profile('customer', {
        "c_custkey": "int64", "c_name": "object", "c_nationkey": "int64", "c_acctbal": "float64",
        "c_mktsegment": "object"}, 5)}),
      b AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'c_acctbal' WHEN 'O' THEN 'c_name'
            ELSE 'c_mktsegment' END AS "column" FROM orders WHERE o_orderpriority = '1-URGENT'),
      r AS (SELECT "column", 'target' AS reason, 1 AS p FROM prof WHERE "column" = 'c_mktsegment'
            UNION ALL SELECT "column", 'identifier', 2 FROM prof WHERE "column" <> 'c_mktsegment'
              AND dtype NOT LIKE '%float%' AND n_unique >= 0.98 * n_rows
            UNION ALL SELECT "column", 'leakage', 3 FROM b)
      SELECT "column", arg_min(reason, p) AS reason FROM r GROUP BY 1""",
    "merged_drops_customer": """SELECT * FROM (VALUES ('c_mktsegment', 'forced'),
        ('c_custkey', 'forced'), ('c_name', 'forced')) f("column", decision)
      UNION ALL SELECT DISTINCT 'c_acctbal', 'proposed' FROM nation WHERE n_regionkey = 0
      UNION ALL SELECT 'c_nationkey', 'kept'""",
    "valid_nominations_orders": """SELECT 'o_custkey' AS "column", count(*) AS n FROM orders
      WHERE o_orderstatus = 'F'""",
}
