"""Rules by the thousand against trying every pattern."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hushframe.operators import detect
from hushframe.operators.rule_sets import MAX_RULE_BYTES, RuleSet, required_literal
from hushframe.plans.policy import Detection

LITERALS = {
    "ACME-[0-9]{9}": ("ACME-", False), "ab+c": ("ab", False), "a?bc": ("bc", False), "(?:xy){2,}z": ("xy", False), "x|y": ("", False),
    "[ab]cd": ("cd", False), "(ab)c": ("abc", False), "(?i)AbC": ("abc", True), "(?i:Ab)c": ("", True), "a(?=bc)": ("a", False), "": ("", False),
    r"\bword\b": ("word", False), r"\d+": ("", False), "a(?:b|c)def": ("def", False), "a.*bcd": ("bcd", False), "(?i)é": ("", True),
}


@pytest.mark.parametrize("pattern", sorted(LITERALS))
def test_required_literals(pattern):
    literal, folded = required_literal(pattern)
    want = LITERALS[pattern]
    if pattern == "(?i:Ab)c":
        assert folded and literal in ("", "c")
    else:
        assert (literal, folded) == want


def rules(rng, n):
    """Patterns of all kinds over a small alphabet, so that many of them match."""
    out = []
    for _ in range(n):
        word = "".join(rng.choice("abcdeK") for _ in range(rng.randint(2, 5)))
        out.append(rng.choice([word, word, word + "[0-9]+", f"(?:{word})+x?", f"{word[0]}?{word[1:]}", f"(?i){word}", f"{word}|{word[::-1]}z", r"\\b" + word, "[ab]{3}" + word[0]]).replace("\\\\", "\\"))
    return out


def tried(patterns, text):
    return sorted((i, m.start(), m.end()) for i, p in enumerate(patterns) for m in re.finditer(p, text) if m.end() > m.start())


def test_matches_against_every_pattern():
    rng = random.Random(4)
    patterns = rules(rng, 800)
    rule_set = RuleSet(patterns)
    for _ in range(150):
        text = "".join(rng.choice("abcdeKAB 12xz\u212aé") for _ in range(rng.randint(0, 60)))
        assert sorted(rule_set.matches(text)) == tried(patterns, text)
        assert rule_set.any(text) == any(re.search(p, text) for p in patterns)


def test_thousands_of_rules(spark):
    rng = random.Random(5)
    patterns = rules(rng, 1000) + [f"NAME{i:05d}" for i in range(4000)]
    table = spark.createDataFrame([(f"E{i % 7}", p, 0.5 + (i % 4) / 10) for i, p in enumerate(patterns)], "entity string, regex string, score double")
    rows = [(i, "".join(rng.choice("abcdeKAB 12xz") for _ in range(40)) + f" NAME{rng.randrange(5000):05d} a@x.io") for i in range(60)] + [(90, None), (91, ""), (92, "abc")]
    df = spark.createDataFrame(rows, "id int, t string")
    started = time.time()
    found = detect.detect_spans(df, "id", "t", recognizers=table)
    found._jdf.queryExecution().executedPlan()
    assert time.time() - started < 20  # most of it a first job; the plan does not hold the rules
    got = sorted((r["id"], r["entity_type"], r["start"], r["end"], r["score"]) for r in found.collect())
    want = set()
    for i, t in rows:
        if t and len(t) >= 4:
            want |= {(i, f"E{k % 7}", a, b, 0.5 + (k % 4) / 10) for k, a, b in tried(patterns, t)} | {(i, "EMAIL_ADDRESS", t.index("a@"), len(t), 1.0)}
    assert got == sorted(want)
    only = detect.detect_spans(df, "id", "t", Detection(entities=["E1"], threshold=0.6), recognizers=table).collect()
    assert {(r["id"], r["start"], r["end"], r["score"]) for r in only} == {(w[0], *w[2:]) for w in want if w[1] == "E1" and w[4] >= 0.6}
    masked = {r["id"]: r["t"] for r in detect.mask_by_rules(df, ["t"], table).collect()}
    assert masked[90] is None and masked[91] == "" and not any("NAME" in t and re.search("NAME0[0-3]", t) for t in masked.values() if t)


def test_allowed_patterns(spark):
    df = spark.createDataFrame([(1, "jane@a.io and bob@b.io"), (2, "JANE@a.io")], "id int, t string")
    allowed = spark.createDataFrame([("^jane@",), ("^nobody$",), (None,)], "text string").filter("text IS NOT NULL")
    got = [(r["id"], r["text"]) for r in detect.detect_spans(df, "id", "t", allow_patterns=allowed).orderBy("id").collect()]
    assert got == [(1, "bob@b.io"), (2, "JANE@a.io")]
    assert detect.detect_spans(df, "id", "t", allow_patterns=allowed.limit(0)).count() == 3


def test_rules_must_be_small(spark, monkeypatch):
    from hushframe.operators import rule_sets

    monkeypatch.setattr(rule_sets, "MAX_RULE_BYTES", 10)
    big = spark.createDataFrame([("E", "a" * 20, 1.0)], "entity string, regex string, score double")
    with pytest.raises(ValueError, match="bytes of rules"):
        rule_sets.rule_spans(big, F.lit("x"))
    assert MAX_RULE_BYTES == 64 << 20
