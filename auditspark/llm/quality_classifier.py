"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of each whole text are standardised and mapped to cosines whose inner products
approximate a Gaussian kernel. Every partition sums its own normal equations; the sums meet in one
small system. Raw scores of labelled rows that the fit has not seen calibrate it: pooled adjacent
violators over a bounded histogram of scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import as_bytes, by_arrow, stored

FEATURES = ("log_words", "word_bytes", "upper", "digits", "symbols", "bars", "loud", "stops",
            "other_bytes", "distinct", "adjacent", "top", "pairs", "dup_lines", "line_words")
N_COSINES = 256
#: Partitions that sum normal equations; bounds what is summed over, not the rows.
PARTS = 48
#: Steps of the histogram that calibration pools, over raw scores from -0.5 to 1.5.
STEPS = 2_000


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text; all are finite, those of texts without words are zero."""
    import numpy as np

    text = text or b""
    found = text.split()
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(by[65:91].sum() + by[97:123].sum()))
    size = sum(map(len, found))
    counts: dict[bytes, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    of = lambda chars: float(sum(int(by[c]) for c in chars))
    return [
        float(np.log1p(n)), min(size / n, 40.0), float(by[65:91].sum()) / letters,
        float(by[48:58].sum()) / size, min(of(b"#*$%&<>@^~_=+") / n, 4.0), min(of(b"|") / n, 2.0),
        min(of(b"!?") / n, 3.0), min(of(b".,;:") / n, 2.0), float(by[128:].sum()) / size,
        len(counts) / n ** 0.8, sum(a == b for a, b in zip(found, found[1:], strict=False)) / n,
        max(counts.values()) / n, len(set(zip(found, found[1:], strict=False))) / max(1, n - 1),
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines)))]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics ``x`` of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([statistics(t) for t in as_bytes(batch.column(1))],
                                           pa.list_(pa.float64()))], ["doc_id", "x"])

    return by_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, x array<double>")


@dataclass
class QualityModel:
    """Fitted by :func:`fit`: everything that scoring needs, a few hundred kB."""

    mean: list[float]
    deviation: list[float]
    weights: list[float]
    knots: list[float]
    levels: list[float]
    seed: int

    def cosines(self, x):
        import numpy as np

        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        z = np.clip((x - np.array(self.mean)) / np.array(self.deviation), -6, 6)
        w = rng.normal(0, 1 / np.sqrt(d), (d, N_COSINES))
        shift = rng.uniform(0, 2 * np.pi, N_COSINES)
        return np.hstack([np.sqrt(2 / N_COSINES) * np.cos(z @ w + shift), np.ones((len(x), 1))])

    def raw(self, x):
        import numpy as np

        return self.cosines(x) @ np.array(self.weights)

    def score(self, x):
        """Calibrated probability; a slight slope keeps the order within calibrated levels."""
        import numpy as np

        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.98 * level + 0.02 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def _matrix(column):
    import numpy as np

    return np.array(column.to_pylist(), float).reshape(-1, len(FEATURES))


def pooled(histogram: list[tuple[float, int, float]]) -> tuple[list[float], list[float]]:
    """Isotonic fit of (score, rows, sum of labels) by pooling adjacent violators.

    Returns the centres of the pools and their smoothed rates, for linear interpolation.
    """
    pools: list[list[float]] = []
    for at, n, y in sorted(histogram):
        pools.append([at * n, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return [0.0], [0.5]
    levels = [(y + 0.01) / (n + 0.02) for _, n, y in pools]
    for i in range(1, len(levels)):  # smoothing may not break the order
        levels[i] = max(levels[i], levels[i - 1])
    return [s / n for s, n, _ in pools], levels


def fit(training: DataFrame, calibrating: Column, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """Fit on ``training`` (``x``, ``y`` 0 or 1): rows where ``calibrating`` calibrate, others fit.

    Without rows every score is a half.
    """
    import numpy as np

    d = len(FEATURES)
    marked = training.withColumn("__late", calibrating)
    fitting = marked.where("NOT __late")
    moments = fitting.select(*[F.col("x")[i].alias(f"x{i}") for i in range(d)]).agg(
        *[F.avg(f"x{i}") for i in range(d)], *[F.stddev_pop(f"x{i}") for i in range(d)]).first()
    model = QualityModel([m or 0.0 for m in moments[:d]], [max(s or 0.0, 1e-6) for s in moments[d:]],
                         [], [0.0], [0.5], seed)

    def sums(batches):
        import pyarrow as pa

        m = N_COSINES + 1
        total, right = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            if batch.num_rows:
                z = model.cosines(_matrix(batch.column(0)))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                total += z.T @ z
                right += z.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(m), pa.int32()), pa.array(np.column_stack([total, right]).tolist(),
                                                      pa.list_(pa.float64()))], ["i", "row"])

    parts = by_arrow(fitting.select("x", F.col("y").cast("double")).coalesce(PARTS), sums,
                     "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(
        F.sum("v").alias("v")).collect()  # (N_COSINES + 1) * (N_COSINES + 2) numbers
    system = np.zeros((N_COSINES + 1, N_COSINES + 2))
    for r in summed:
        system[r.i, r.j] = r.v
    rows = max(1.0, system[-1, -2])
    model.weights = np.linalg.solve(
        system[:, :-1] + ridge * rows / N_COSINES * np.eye(N_COSINES + 1), system[:, -1]).tolist()

    def raw(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], ["raw", "y"])

    late = by_arrow(marked.where("__late").select("x", F.col("y").cast("double")), raw,
                    "raw double, y double")
    step = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * (STEPS / 2))
    bars = late.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    model.knots, model.levels = pooled([((r.s + 0.5) / (STEPS / 2), r.n, r.y) for r in bars])
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality",
             threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Labels of rows with crc32(id) mod 5 = 0 are never read; of the others, remainder 4 calibrates
    and the rest fit. Only the text makes a score. Null and empty texts share one score. A null id
    is never held out and learns nothing; a null label is no label; repeated rows score alike.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    measured = stored(with_statistics(docs))
    usable = labels.select("doc_id", F.col(label).alias("y")).where(
        F.col("y").isin(0, 1) & (fold != 0)).dropDuplicates(["doc_id"])
    training = stored(measured.join(usable, "doc_id").select("doc_id", "x", "y", fold.alias("f")))
    model = fit(training, F.col("f") == 4)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = by_arrow(measured.select("doc_id", "x"), run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
