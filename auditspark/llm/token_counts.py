"""Token counts of a unigram vocabulary: the best segmentation's score and size, never its pieces.

An Aho-Corasick automaton finds every vocabulary piece in a stretch of text; a pass over the matches
by where they end carries, per place, the best score so far and its number of pieces. Ties go to
the piece that begins first, as the tokenizer's own lattice does: it visits beginnings from the left
and replaces a path only by a strictly better one. A character that no piece covers costs the least
score minus ten and counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import by_arrow

#: The tokenizer's sign for a space, and what it takes off for an unknown character: fixed values.
SPACE_SIGN, UNKNOWN_PENALTY = "▁", 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; control, unknown and byte pieces are left out."""

    scores: dict[str, float]

    @classmethod
    def read(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return cls({p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size())
                    if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))})

    def splits_at_spaces(self) -> bool:
        """Whether no piece reaches over the beginning of a word, so words are counted apart."""
        return not any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in self.scores)


class Counter:
    """Counts one stretch at a time; remembers words up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 300_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.scores.values()) - UNKNOWN_PENALTY
        self.by_word = vocabulary.splits_at_spaces()
        self.seen: dict[str, tuple[float, int]] = {}
        self.remembered = remembered

    def stretch(self, text: str) -> tuple[float, int]:
        """Score and number of tokens of the best segmentation of ``text``."""
        n = len(text)
        ending: list[list] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(text):
            ending[last + 1].append(found)
        best, size = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            for length, score in sorted(ending[end], reverse=True):  # the earliest beginning first
                value = best[end - length] + score
                single |= length == 1
                if top is None or value > top:
                    top, pieces = value, size[end - length] + 1
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, pieces = value, size[end - 1] + len(text[end - 1].encode())
            best[end], size[end] = top, pieces
        return best[n], size[n]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = SPACE_SIGN + text.replace(" ", SPACE_SIGN)
        if not self.by_word:
            return self.stretch(marked)
        total, size = 0.0, 0
        for word in re.findall(f"{SPACE_SIGN}*[^{SPACE_SIGN}]+|{SPACE_SIGN}+", marked):
            known = self.seen.get(word)
            if known is None:
                known = self.stretch(word)
                if len(word) <= 64:
                    if len(self.seen) >= self.remembered:
                        self.seen.clear()
                    self.seen[word] = known
            total += known[0]
            size += known[1]
        return total, size


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` with ``n_tokens`` and ``score`` of each whole text.

    Needs ``text``; columns of added names are replaced. Null and empty texts have no tokens and
    score 0. Repeated rows count alike, an empty table gives an empty table.
    """
    kept = [c for c in columns or docs.columns if c not in ("n_tokens", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary, a few MB

    def run(batches):
        import pyarrow as pa

        counter = Counter(shared.value)
        for batch in batches:
            found = [counter.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for _, n in found], pa.int64()),
                 pa.array([s for s, _ in found], pa.float64())], [*kept, "n_tokens", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return by_arrow(docs.select(*kept, F.col("text").alias("__text")), run,
                    f"{schema}, n_tokens bigint, score double")
