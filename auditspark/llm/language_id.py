"""Language identification by Bayesian fusion of what the text, the markup and the address say.

Text: byte-trigram likelihoods per language, counted over all labelled documents. Markup: how often
pages of a language declare what they declare. Address: a prior per host, smoothed by its domain,
that by its suffix, that by all pages. Both are grouped sums of the pages' text posteriors, so a hot
host is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import as_bytes, by_arrow, stored
from auditspark.llm.html_extract import host, main_text

#: Hash buckets of byte trigrams; the model is this many numbers per language.
BUCKETS = 1 << 15
#: Neighbouring trigrams share bytes, so each counts as a third of a witness.
TEMPER = 1 / 3
#: Pages' worth of belief that a level of the address borrows from the level above.
BORROWED = 5.0


def trigrams(text: bytes | None):
    """Bucket of every byte trigram of a text, letters A-Z lower-cased and white space folded."""
    import numpy as np

    b = np.frombuffer(b" " + b" ".join((text or b"").lower().split()) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15)


def profiles(docs: DataFrame) -> tuple[list[str], list]:
    """Languages and, per language, the log likelihood of every bucket, from all labelled rows.

    Brings BUCKETS numbers per language to the driver; rows without a language teach nothing.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa

        sums: dict[str, object] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(total[at])], ["lang", "bucket", "n"])

    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = by_arrow(labelled, count, "lang string, bucket int, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list(F.struct("bucket", "n")).alias("counts")).collect()
    table = {}
    for r in counts:
        row = np.full(BUCKETS, 0.5)
        for c in r.counts:
            row[c.bucket] += c.n
        table[r.lang] = np.log(row / row.sum())
    names = sorted(table)
    return names, [table[k] for k in names]


def _read(pages: DataFrame, names: list[str], table: list, key: str) -> DataFrame:
    """Text posterior ``p``, declared language, host, domain and suffix of every page."""
    import numpy as np

    shared = pages.sparkSession.sparkContext.broadcast(np.array(table))

    def run(batches):
        import pyarrow as pa

        logs = shared.value
        for batch in batches:
            out = []
            for page in batch.column(2).to_pylist():
                at = trigrams(main_text(page).encode("utf-8", "replace"))
                value = logs[:, at].sum(axis=1) * TEMPER if len(at) else np.zeros(len(names))
                value = np.exp(value - value.max())
                out.append((value / value.sum()).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64())),
                 batch.column(3), batch.column(4)], [key, "url", "p", "host", "declared"])

    declared = F.lower(F.regexp_extract(
        F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    kind = dict(pages.dtypes)[key]
    read = by_arrow(
        pages.select(key, "url", "html", host(F.col("url")).alias("host"), declared.alias("declared")),
        run, f"{key} {kind}, url string, p array<double>, host string, declared string")
    labels = F.split("host", r"\.")
    return read.withColumn("suffix", F.element_at(labels, -1)).withColumn(
        "domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))


def _sums(read: DataFrame, by: list[str], size: int) -> DataFrame:
    """Sum of the posteriors per value of ``by``, as an array."""
    return read.groupBy(*by).agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(size)]).select(
        *by, F.array(*[f"s{i}" for i in range(size)]).alias("sums"))


def _borrow(sums: Column, above: Column) -> Column:
    """Shares of ``sums`` smoothed by the shares ``above``."""
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, above, lambda s, q: (s + BORROWED * q) / (total + BORROWED))


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, ``url``, ``lang`` and its ``probability`` for every page, with ``declared``.

    ``docs`` (``lang``, ``text``) teaches the text likelihoods. A page without text is judged by
    its declaration and address alone; one without any evidence gets the commonest language. Null
    addresses share one host. Ties go to the first language by code point. Repeated rows agree.
    Without labelled documents ``lang`` and ``probability`` are null.
    """
    names, table = profiles(docs)
    size = len(names)
    if not size:
        return pages.select(key, "url", F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("probability"),
                            F.lit(None).cast("string").alias("declared"))
    read = stored(_read(pages, names, table, key))
    hosts = stored(_sums(read, ["suffix", "domain", "host"], size))
    up = lambda frame, by: frame.groupBy(*by).agg(*[
        F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]).select(
        *by, F.array(*[f"s{i}" for i in range(size)]).alias("sums"))
    domains = up(hosts, ["suffix", "domain"])
    suffixes = up(domains, ["suffix"])
    even = F.array(*[F.lit(1.0 / size)] * size)
    all_pages = up(suffixes, []).select(
        _borrow(F.transform("sums", lambda x: F.coalesce(x, F.lit(0.0))), even).alias("whole"))
    per_suffix = suffixes.crossJoin(F.broadcast(all_pages)).select(  # one row: the shares overall
        "suffix", _borrow(F.col("sums"), F.col("whole")).alias("above"))
    per_domain = domains.join(per_suffix, "suffix").select(
        "suffix", "domain", _borrow(F.col("sums"), F.col("above")).alias("above"))
    per_host = hosts.join(per_domain, ["suffix", "domain"]).select("host", "sums", "above")
    # P(declared | language), smoothed by how often anything is declared at all
    said = stored(_sums(read, ["declared"], size))
    totals = up(said, []).select(F.col("sums").alias("totals"))
    chance = said.crossJoin(F.broadcast(totals)).select("declared", F.zip_with(  # one row of totals
        F.col("sums"), F.col("totals"), lambda s, t: (s + 0.5) / (t + 1.0)).alias("chance"))
    fused = read.join(per_host, "host").join(chance, "declared")
    # the page's own share is taken out of its host's sum, or it would witness twice
    prior = _borrow(F.zip_with("sums", "p", lambda s, p: F.greatest(s - p, F.lit(0.0))), F.col("above"))
    weight = F.zip_with(F.zip_with(prior, F.col("p"), lambda a, b: a * F.greatest(b, F.lit(1e-300))),
                        F.col("chance"), lambda a, b: a * b)
    judged = fused.select(key, "url", "declared", weight.alias("w")).select(
        key, "url", "declared", F.array_max("w").alias("m"), "w",
        F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("t"))
    place = F.array_position(F.col("w"), F.col("m")).cast("int")
    return judged.select(
        key, "url", F.element_at(F.array(*map(F.lit, names)), place).alias("lang"),
        F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(F.lit(1.0 / size)).alias("probability"),
        F.nullif(F.col("declared"), F.lit("")).alias("declared"))
