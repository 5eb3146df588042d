"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Each rule reads statistics of the whole text and votes good, bad or abstains. Documents with the
same votes are alike to the model, so the corpus is reduced to a histogram of vote patterns (at most
3 ** number of rules rows) and expectation-maximisation runs over that histogram: the E-step gives
each pattern a posterior, the M-step each rule its accuracy. A document is judged by the posterior
probability of good, not by passing every rule. Everything that touches documents is built-in
expressions; no text is exploded or shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import LOWER, SPACE, UPPER, count_of, let, stored, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_lower", "n_loud")


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array ``w``.

    Windows become 64-bit hashes. Only where some hash recurs are they sorted with their places, so
    that equal windows are neighbours; the places of recurring windows cover the repeated words.
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(
        F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(ordered, lambda s: F.transform(
            F.filter(F.transform(s, lambda x, i: F.struct(
                x["p"].alias("p"),
                (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                lambda x: x["twice"]), lambda x: x["p"]))

    def covered(hashes: Column) -> Column:
        each = F.transform(places(hashes), lambda p: F.array(p, p + 1, p + 2))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            F.size(F.array_distinct(F.flatten(each))))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of each whole text as struct ``__q``. Null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    ready = docs.withColumn("__w", words(F.col("text"))).withColumn("__lines", lines)
    return ready.withColumn("__q", F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        count_of(text, UPPER).alias("n_upper"),
        count_of(text, LOWER).alias("n_lower"),
        count_of(text, "!?").alias("n_loud"),
    )).drop("__w", "__lines")


def defects(q: str = "__q") -> dict[str, tuple[Column, float, float]]:
    """Per defect its measure, the value up to which it is usual, the value from which it is severe."""
    c = lambda name: F.col(q)[name].cast("double")
    n = F.greatest(c("n_words"), F.lit(1.0))
    letters = c("n_upper") + c("n_lower")
    none = F.lit(0.0)
    return {
        "symbols": (c("n_symbols") / n, 0.10, 0.30),
        "repeats": (c("n_repeat_words") / n, 0.25, 0.45),
        "dup_lines": (F.when(c("n_lines") < 4, none).otherwise(
            c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0))), 0.34, 0.60),
        "shouting": (F.when(letters < 20, none).otherwise(
            c("n_upper") / F.greatest(letters, F.lit(1.0))), 0.25, 0.50),
        "loud": (c("n_loud") / n, 0.15, 0.50),
    }


def rules(q: str = "__q") -> dict[str, Column]:
    """The labelling functions: 1 votes good, -1 bad, 0 abstains.

    A document usually has one defect at most, so a rule that looks for one says nothing when it
    finds none; ``evenness`` speaks for documents without any and against those with a severe one.
    """
    found = defects(q)
    votes = {k: F.when(v >= severe, -1).otherwise(0) for k, (v, _, severe) in found.items()}
    usual, severe = F.lit(True), F.lit(False)
    for value, low, high in found.values():
        usual, severe = usual & (value <= low), severe | (value >= high)
    n = F.col(q)["n_words"]
    mean = F.col(q)["word_chars"] / F.greatest(n, F.lit(1))
    votes["evenness"] = F.when(severe, -1).when(usual, 1).otherwise(0)
    votes["length"] = F.when(n < 30, -1).when(n >= 80, 1).otherwise(0)
    votes["word_length"] = F.when((mean >= 3) & (mean <= 12), 1).when(
        (mean < 1.5) | (mean > 30), -1).otherwise(0)
    return {k: v.cast("tinyint") for k, v in votes.items()}


@dataclass
class VoteModel:
    """Fitted by :func:`fit_votes`: the share of good documents and each rule's habits.

    ``habits[rule]`` maps a vote to ``(P(vote | good), P(vote | bad))``.
    """

    prior: float
    habits: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability that a document is good, given its votes."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, habit in self.habits.items():
            weight = {v: math.log(g / b) for v, (g, b) in habit.items()}
            total = total + F.when(votes[name] == 1, F.lit(weight[1])).when(
                votes[name] == -1, F.lit(weight[-1])).otherwise(F.lit(weight[0]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def em(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 100,
       tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over (votes, count) rows.

    How often a rule abstains is a habit like its votes. At the start a rule that votes is right
    nine times in ten; no fit may make a vote count against what it says, else the two classes could
    change places. Every habit is smoothed by one document. Patterns are visited in order, so
    reruns agree to the last bit.
    """
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    share = {k: {v: sum(n for p, n in patterns if p[i] == v) / max(total, 1) for v in (1, 0, -1)}
             for i, k in enumerate(names)}

    def ordered(habit: dict[int, list[float]]) -> dict[int, tuple[float, float]]:
        g, b = (sum(habit[v][i] for v in habit) for i in (0, 1))
        out = {v: (x / g, y / b) for v, (x, y) in habit.items()}
        for v, sign in ((1, 1), (-1, -1)):
            x, y = out[v]
            if (x - y) * sign < 0:
                out[v] = ((x + y) / 2, (x + y) / 2)
        return out

    prior = 0.9
    habits = {k: ordered({
        1: [share[k][1] + 0.01, share[k][1] / 9 + 0.01], 0: [share[k][0] + 0.01] * 2,
        -1: [share[k][-1] / 9 + 0.001, share[k][-1] * 9 + 0.009]}) for k in names}
    for _ in range(rounds if total else 0):
        good, tallies = 0.0, {k: {v: [0.0, 0.0] for v in (1, 0, -1)} for k in names}
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(habits[k][v][0] / habits[k][v][1])
                for k, v in zip(names, votes, strict=True))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good += n * p
            for k, v in zip(names, votes, strict=True):
                tallies[k][v][0] += n * p
                tallies[k][v][1] += n * (1 - p)
        for k in names:
            for v in (1, 0, -1):
                tallies[k][v][0] += share[k][v] + 1e-6
                tallies[k][v][1] += share[k][v] + 1e-6
        before, prior = (prior, habits), min(max((good + 0.9) / (total + 1), 0.5), 0.99)
        habits = {k: ordered(tallies[k]) for k in names}
        if max([abs(prior - before[0]), *(abs(x - y) for k in names for v in (1, 0, -1) for x, y in zip(
                habits[k][v], before[1][k][v], strict=True))]) < tolerance:
            break
    return VoteModel(prior, habits)


def fit_votes(judged: DataFrame, names: list[str]) -> VoteModel:
    """Fit on the histogram of vote patterns over all rows: at most 3 ** len(names) rows come back."""
    counts = judged.groupBy(*[f"__v_{k}" for k in names]).agg(F.count("*").alias("n")).collect()
    return em([(tuple(int(r[i]) for i in range(len(names))), r["n"]) for r in counts], names)


def judge(docs: DataFrame, columns: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """``columns`` of ``docs`` with the five statistics, ``base_failed``, ``p_good`` and ``kept``.

    Needs ``text``; ``columns`` are all of ``docs`` if not given, and columns of added names are
    replaced. Null and blank texts have no words, so the base rule rejects them. Repeated rows are
    judged alike. An empty table gives an empty table. Each text is read once: its votes are
    written beside ``columns``, and fitting and judging read that copy.
    """
    names = list(rules())
    added = (*STATISTICS, "base_failed", "p_good", "kept")
    kept = [c for c in columns or docs.columns if c not in added]
    measured = with_statistics(docs)
    votes = stored(measured.select(
        *kept, "__q", *[v.alias(f"__v_{k}") for k, v in rules().items()]))
    model = fit_votes(votes, names)
    q = F.col("__q")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    good = model.posterior({k: F.col(f"__v_{k}") for k in names})
    return votes.select(
        *kept, *[q[s].alias(s) for s in STATISTICS], failed.alias("base_failed"),
        good.alias("p_good"), (~failed & (good >= least)).alias("kept"))
