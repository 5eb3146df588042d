"""Planting leaks of known shape into a table, to prove that the screens find them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.functions.exprs import draw, uniform
from auditspark.operators.profile import association
from auditspark.operators.ranking import order_statistics

SEED = vocab.DEFAULT_SEED


def noisy_copy(df: DataFrame, target: str, positive: str, name: str = "status_code",
               flip: float = 0.06, seed: int = SEED, row_id: str = "row_id",
               codes: tuple[str, str] = ("A1", "Z9")) -> DataFrame:
    """A code column that equals the label except where a draw below ``flip`` inverts it."""
    label = F.col(target).cast("string") == F.lit(positive)
    flipped = uniform(seed, F.col(row_id), f":{name}") < F.lit(flip)
    return df.withColumn(name, F.when(label != flipped, codes[1]).otherwise(codes[0]))


def _normal(seed: int, row_id: Column, salt: str) -> Column:
    """Standard normal by Box-Muller on two uniforms."""
    u1 = F.greatest(uniform(seed, row_id, f"{salt}:u1"), F.lit(2.0 ** -52))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * uniform(seed, row_id, f"{salt}:u2"))


_POISSON_TERMS = 40


def _poisson(rate: Column, u: Column) -> Column:
    """Inverse distribution function: how many cumulative terms lie at or below the draw."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(_POISSON_TERMS)), lambda k: F.exp(
        -rate + k * F.log(rate) - F.aggregate(
            F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0),
            lambda acc, j: acc + F.log(j.cast("double")))))
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        cdf = acc["cdf"] + p
        return F.struct(cdf.alias("cdf"), (acc["n"] + (cdf <= u).cast("int")).alias("n"))

    return F.aggregate(terms, start, step, lambda acc: acc["n"])


def post_label(df: DataFrame, target: str, positive: str, seed: int = SEED,
               row_id: str = "row_id") -> DataFrame:
    """Two columns recorded after the label: a log-normal duration and a Poisson count.

    Both only shift with the label, so neither is a copy of it.
    """
    y = F.coalesce((F.col(target).cast("string") == F.lit(positive)).cast("double"), F.lit(0.0))
    rid = F.col(row_id)
    days = F.round(F.exp(2.35 + 0.80 * y + 0.60 * _normal(seed, rid, ":days")), 1)
    touches = _poisson(F.lit(1.6) + 2.2 * y, uniform(seed, rid, ":touches"))
    return df.withColumn("days_to_close", days).withColumn(
        "adjuster_touches", touches.cast("bigint"))


def rekeyed_id(df: DataFrame, target: str, positive: str, name: str = "member_number",
               seed: int = SEED, row_id: str = "row_id", block: int = 700_000,
               share: tuple[float, float] = (0.80, 0.20), repeat: float = 0.06) -> DataFrame:
    """An identifier re-issued in a high block mostly for positive rows.

    A share of the rows reuses the number of the row before it, which keeps the column under the
    identifier rule's distinctness threshold, so only an association screen can catch it.
    """
    rid = F.col(row_id).cast("bigint")
    positive_row = F.coalesce(F.col(target).cast("string") == F.lit(positive), F.lit(False))
    chance = F.when(positive_row, share[0]).otherwise(share[1])
    reissued = uniform(seed, rid, f":{name}:block") < chance
    number = rid - (uniform(seed, rid, f":{name}:repeat") < F.lit(repeat)).cast("bigint")
    return df.withColumn(name, number + F.when(reissued, F.lit(block)).otherwise(F.lit(0)))


def missing(df: DataFrame, column: str, fraction: float, seed: int = SEED,
            row_id: str = "row_id", small_group: int | None = None) -> DataFrame:
    """Blank exactly floor(fraction * n) values of one column, whatever the label."""
    n = df.count()
    take = int(fraction * n)
    if take == 0:
        return df
    rid = F.col(row_id)
    key = draw(seed, rid, f":missing:{column}")
    cut = order_statistics(
        df.select(F.lit("all").alias("grp"), key.alias("key"), rid.cast("bigint").alias("tie")),
        {"all": [take]}, {"all": n}, small_group=small_group)[0]
    return df.withColumn(column, F.when(~cut.reached(key, rid), F.col(column)))


def answer_key(df: DataFrame, target: str, positive: str, planted: dict[str, str],
               row_id: str = "row_id") -> DataFrame:
    """(column, kind, agreement, nmi) of planted columns as they came out.

    Agreement is the share of rows where the majority side of the column's values predicts the
    label; a planted code column is compared through its own levels.
    """
    columns = list(planted)
    measured = association(df.select(row_id, target, *columns), target, row_id=row_id)
    y = (F.col(target).cast("string") == F.lit(positive)).cast("int")
    cells = df.select(y.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("s")).select("y", "s.column", "s.value")
    per_value = cells.groupBy("column", "value").agg(
        F.sum("y").alias("pos"), F.count("*").alias("n"))
    agreement = per_value.groupBy("column").agg(
        (F.sum(F.greatest("pos", F.col("n") - F.col("pos"))) / F.sum("n")).alias("agreement"))
    kinds = F.create_map(*[F.lit(x) for pair in planted.items() for x in pair])
    return measured.join(agreement, "column").select(
        "column", F.element_at(kinds, F.col("column")).alias("kind"),
        F.round("agreement", 4).alias("agreement"), "nmi")
