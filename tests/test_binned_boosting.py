"""Long tables are boosted on bin numbers: fewer rows to fit, scores as good as on the values."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from auditspark.operators import models


def test_rows_alike_in_their_bins_are_merged_and_score_as_before(spark, monkeypatch):
    monkeypatch.setitem(models._BOOST, "maxIter", 3)
    x = F.array(F.rand(1) * 1000, (F.col("id") % 3).cast("double"))
    rows = spark.range(20_000).select(
        x.alias("x"), F.rand(2).alias("noise")).select(
            array_to_vector("x").alias("features"),
            ((F.col("x")[0] > 400) != (F.col("noise") < 0.1)).cast("int").alias("y")).persist()
    plain = models.fit_model(models._boosted, rows, "binary", [])
    monkeypatch.setattr(models, "BINNED_ABOVE", 10_000)
    binned = models.fit_model(models._boosted, rows, "binary", [])
    assert list(binned.fitted.bounds) == [0] and len(binned.fitted.bounds[0]) == 254
    assert models.merged(models.in_bins(rows, binned.fitted.bounds).withColumn("label", F.col("y"))).count() <= 1530
    areas = [models.evaluate(m.predict(rows), "roc_auc", "binary").first().value for m in (plain, binned)]
    assert abs(areas[0] - areas[1]) < 0.005 and areas[1] > 0.85
