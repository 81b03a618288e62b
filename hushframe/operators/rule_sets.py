"""Recognizers and allow-list patterns by the thousand, as a table instead of expressions in the plan.

Every pattern that cannot match without some literal text is found through that text: one Aho-Corasick automaton over all
literals reads a value once and names the patterns worth trying, so the time grows with the text and its finds, not with the
number of rules, and the plan stays the same for any number. Patterns are Python's regular expressions here.

A set of rules is a list that people keep: it is collected, checked against `MAX_RULE_BYTES` and broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 64 << 20
SPAN_TYPE = pa.list_(
    pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())])
)


def required_literal(pattern: str) -> tuple[str, bool]:
    """The longest text that every match holds ('' when there is none), and whether case does not count."""
    import re._parser as parser

    tree = parser.parse(pattern)
    folded = bool(tree.state.flags & re.IGNORECASE)
    best, run = "", ""

    def close() -> None:
        nonlocal best, run
        best, run = (run if len(run) > len(best) else best), ""

    def walk(nodes) -> None:
        nonlocal run
        for op, value in nodes:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                walk(value[2])  # once at least, and what follows the repeats is not next to it
                if value[1] > 1:
                    close()
            elif name == "ATOMIC_GROUP":
                walk(value)
            elif name != "AT":
                close()

    walk(tree)
    close()
    # flags inside groups may fold case too; then no literal is safe
    if folded or "(?i" in pattern or re.search(r"\(\?[a-z]*i[a-z]*:", pattern):
        return best.lower() if best.isascii() else "", True
    return best, False


class RuleSet:
    """Patterns behind one automaton."""

    def __init__(self, patterns: Sequence[str]) -> None:
        import ahocorasick

        self.patterns, self.compiled = list(patterns), {}
        self.plain: list[str | None] = []
        by_literal: dict[bool, dict[str, list[int]]] = {False: {}, True: {}}
        self.always: list[int] = []
        for i, pattern in enumerate(self.patterns):
            literal, folded = required_literal(pattern)
            self.plain.append(literal if not folded and literal and re.escape(literal) == re.escape(pattern) else None)
            if literal:
                by_literal[folded].setdefault(literal, []).append(i)
            else:
                self.always.append(i)
        self.automata = []
        for folded, literals in by_literal.items():
            if literals:
                automaton = ahocorasick.Automaton()
                for literal, rules in literals.items():
                    automaton.add_word(literal, tuple(rules))
                automaton.make_automaton()
                self.automata.append((folded, automaton))

    def candidates(self, text: str) -> list[int]:
        """Rules that may match, in their order."""
        found = set(self.always)
        for folded, automaton in self.automata:
            for _, rules in automaton.iter(text.translate(_LOWER) if folded else text):
                found.update(rules)
        return sorted(found)

    def pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.patterns[i])
        return self.compiled[i]

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) of all matches that are not empty; those of one rule do not overlap."""
        for i in self.candidates(text):
            literal = self.plain[i]
            if literal is not None:
                at = text.find(literal)
                while at >= 0:
                    yield i, at, at + len(literal)
                    at = text.find(literal, at + len(literal))
                continue
            for m in self.pattern(i).finditer(text):
                if m.end() > m.start():
                    yield i, m.start(), m.end()

    def any(self, text: str) -> bool:
        return any(self.pattern(i).search(text) for i in self.candidates(text))


# ASCII letters, and the few other characters that match one of them where case does not count.
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)} | {ord("İ"): "i", ord("ı"): "i", ord("ſ"): "s", 0x212A: "k"}


def _collected(rules: DataFrame, columns: Sequence[str]) -> list[tuple]:
    """The rows of a rule table, which must be small enough to send to every task."""
    size = rules.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws("", *columns))), F.lit(0))).first()[0]
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules; at most {MAX_RULE_BYTES} are sent to the tasks")
    return [tuple(r) for r in rules.select(*columns).distinct().orderBy(*columns).collect()]


def rule_spans(rules: DataFrame, text: Column, min_len: int = 4) -> Column:
    """The spans that a table of recognizers (entity, regex, score) finds in a text, in the shape of `detect.SPANS`."""
    rows = _collected(rules.select("entity", "regex", F.col("score").cast("double").alias("score")), ["entity", "regex", "score"])
    sent = rules.sparkSession.sparkContext.broadcast((rows, {}))

    @F.arrow_udf("array<struct<entity_type:string,start:int,end:int,score:double,text:string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows, kept = sent.value  # a worker keeps its copy, and with it the automaton
        if "set" not in kept:
            kept["set"] = RuleSet([r[1] for r in rows])
        for column in batches:
            out = []
            for text in column.to_pylist():
                spans = []
                if text is not None and len(text.encode()) >= min_len:
                    for i, start, end in kept["set"].matches(text):
                        spans.append({"entity_type": rows[i][0], "start": start, "end": end, "score": rows[i][2], "text": text[start:end]})
                out.append(spans)
            yield pa.array(out, SPAN_TYPE)

    return found(text)


def matches_any(patterns: DataFrame, text: Column) -> Column:
    """Whether one of a table of patterns (`text`) is found in a value; null gives false."""
    rows = [r[0] for r in _collected(patterns.select("text"), ["text"])]
    sent = patterns.sparkSession.sparkContext.broadcast((rows, {}))

    @F.arrow_udf("boolean")
    def allowed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows, kept = sent.value
        if "set" not in kept:
            kept["set"] = RuleSet(rows)
        for column in batches:
            yield pa.array([x is not None and kept["set"].any(x) for x in column.to_pylist()], pa.bool_())

    return allowed(text)
