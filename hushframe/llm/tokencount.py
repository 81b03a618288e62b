"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming carries the best score and the
number of pieces at every place, never the pieces. Ties go to the candidate that begins first, and a candidate only
replaces a better or equal one if its score is strictly higher: the rule of the public unigram tokenizers. A character
without a piece of its own costs ten more than the worst piece, and unknown characters in a row count as one piece.

White space becomes the sign ▁, which also begins each text. If the vocabulary has that sign only at the beginning of
pieces, text falls apart there and each distinct part is counted once per batch; otherwise texts are taken whole.
The vocabulary is a parameter: the pieces and scores of a sentencepiece file.

Defined cases: null and empty texts have no tokens and score 0; all columns of the documents are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.llm.common import slices, texts_of

SIGN = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct parts whose counts a task keeps.
KEPT_PARTS = 1_500_000
RESULT = "struct<n_tokens:long,score:double>"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in ids]


class Counter:
    """Counts pieces of texts under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}
        self.parts = all(SIGN not in p.lstrip(SIGN) for p, _ in pieces)

    def path(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        n = len(text)
        best, count, stray = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done, single, found = 0, False, None

        def close(end: int) -> None:
            """The place is settled: a character without a piece of its own may be unknown."""
            nonlocal found
            if not single:
                total = best[end - 1] + self.unknown
                if found is None or total > found:
                    found, count[end], stray[end] = total, count[end - 1] + (not stray[end - 1]), True
            best[end] = found

        # Matches come by their ends, at one end the longest first: the order of the tie rule.
        for last, (length, score) in self.automaton.iter(text):
            while done < last:
                done += 1
                close(done)
                single, found = False, None
            total = best[last + 1 - length] + score
            if found is None or total > found:
                found, count[last + 1], stray[last + 1] = total, count[last + 1 - length] + 1, False
            single = single or length == 1
        while done < n:
            done += 1
            close(done)
            single, found = False, None
        return count[n], best[n]

    def counts(self, texts: list[bytes]) -> tuple[list[int], list[float]]:
        known = self.known
        if len(known) > KEPT_PARTS:  # the memory of a task stays bounded
            known.clear()
        numbers, scores = [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace").replace(" ", SIGN)
            if text and not text.startswith(SIGN):
                text = SIGN + text
            n, total = 0, 0.0
            for part in re.findall(f"{SIGN}+[^{SIGN}]*", text) if self.parts else [text]:
                found = known.get(part)
                if found is None:
                    found = known[part] = self.path(part)
                n, total = n + found[0], total + found[1]
            numbers.append(n)
            scores.append(total)
        return numbers, scores


def token_counts(spark, pieces: list[tuple[str, float]], text: Column) -> Column:
    """A struct of the number of tokens and the score of each text. The vocabulary's size is that of its file."""
    sent = spark.sparkContext.broadcast(pieces)

    @F.arrow_udf(RESULT)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(sent.value)
        for column in batches:
            numbers, scores = [], []
            for some in slices(column):
                n, s = counter.counts(texts_of(some))
                numbers += n
                scores += s
            yield pa.StructArray.from_arrays([pa.array(numbers, pa.int64()), pa.array(scores, pa.float64())], ["n_tokens", "score"])

    return counted(text)
