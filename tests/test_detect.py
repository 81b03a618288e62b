import dataclasses

import pytest
from pyspark.sql import functions as F

from hushframe.operators import detect
from hushframe.plans.policy import Anonymizer, Detection, Recognizer


def found(values, texts, d=None):
    spans = values(texts, lambda c: detect.span_array(c, d))
    return [[(s["entity_type"], s["start"], s["end"]) for s in row] for row in spans]


def test_each_entity(values):
    cases = {
        "mail jane.doe@example.com now": [("EMAIL_ADDRESS", 5, 25)],
        "call +1 (743) 555-3824 or 555-123-4567": [("PHONE_NUMBER", 5, 22), ("PHONE_NUMBER", 26, 38)],
        "card 4111 1111 1111 1111.": [("CREDIT_CARD", 5, 24)],
        "card 4111 1111 1111 1112.": [],
        "ssn 123-45-6789": [("US_SSN", 4, 15)],
        "ssn 000-45-6789": [],
        "é 11.2.3.45 und 1.2.3.4": [("IP_ADDRESS", 2, 11), ("IP_ADDRESS", 16, 23)],
        "256.1.1.1": [],
        "2001:0db8:85a3:0000:0000:8a2e:0370:7334": [("IP_ADDRESS", 0, 39)],
        "pay DE89370400440532013000 today": [("IBAN_CODE", 4, 26)],
        "to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa": [("CRYPTO", 3, 37)],
        "nothing here": [],
        "a@b": [],
        "": [],
        None: [],
    }
    assert found(values, cases) == list(cases.values())


def test_many_matches_have_exact_offsets(values):
    text = "".join(f"é{i % 7 * 'x'} 10.0.{i % 250}.{i % 99} " for i in range(300))
    import re

    want = [(m.start(), m.end()) for m in re.finditer(detect.IPV4, text)]
    got = [(s, e) for _, s, e in found(values, [text], Detection(entities=["IP_ADDRESS"]))[0]]
    assert got == want and len(want) == 300


def test_long_run_of_letters_is_cheap(values):
    assert found(values, ["a" * 400_000 + " @ x"]) == [[]]


def test_entities_threshold_and_own_recognizer(values):
    text = "ACME-123456789 jane@example.com 10.0.0.1"
    own = Recognizer("ACME_ACCOUNT_NUMBER", r"ACME-[0-9]{9}", 0.8)
    names = lambda d: [e for e, _, _ in found(values, [text], d)[0]]
    assert names(Detection(recognizers=[own])) == ["ACME_ACCOUNT_NUMBER", "EMAIL_ADDRESS", "IP_ADDRESS"]
    assert names(Detection(recognizers=[own], threshold=0.7)) == ["ACME_ACCOUNT_NUMBER", "EMAIL_ADDRESS"]
    assert names(Detection(entities=["IP_ADDRESS"], threshold=0.0)) == ["IP_ADDRESS"]
    assert names(Detection(entities=["ACME_ACCOUNT_NUMBER"], recognizers=[own])) == ["ACME_ACCOUNT_NUMBER"]


def test_allow_list(values):
    text = "help@example.com jane@example.com"
    exact = Detection(allow_list=["help@example.com"])
    assert found(values, [text], exact)[0] == [("EMAIL_ADDRESS", 17, 33)]
    regex = Detection(allow_list=[r"@example\.com$"], allow_match="regex")
    assert found(values, [text], regex)[0] == []


def test_mask_text(values):
    cases = {
        "a jane@example.com b 10.0.0.1": "a [redacted] b [redacted]",
        "jane@example.com": "[redacted]",
        "é jane@example.com": "é [redacted]",
        "clean": "clean",
        None: None,
    }
    assert values(cases, detect.mask_text) == list(cases.values())
    rules = {
        "US_SSN": Anonymizer("mask", chars_to_mask=7),
        "PHONE_NUMBER": Anonymizer("mask", chars_to_mask=6, from_end=True),
        "EMAIL_ADDRESS": Anonymizer("redact"),
        "DEFAULT": Anonymizer("hash"),
    }
    text = "123-45-6789 555-123-4567 x jane@example.com 10.0.0.1"
    import hashlib

    digest = hashlib.sha256(b"10.0.0.1").hexdigest()
    want = f"*******6789 555-12****** x  {digest}"
    assert values([text], lambda c: detect.mask_text(c, Detection(anonymizers=rules))) == [want]


def test_overlaps_keep_the_longer(values):
    # the card number holds a phone-like part
    wide = Recognizer("WIDE", r"[0-9]{3}-[0-9]{3}-[0-9]{4} ext [0-9]+", 0.1)
    text = "555-123-4567 ext 9!"
    assert values([text], lambda c: detect.mask_text(c, Detection(recognizers=[wide]))) == ["[redacted]!"]


def test_table_form(spark):
    df = spark.createDataFrame([(1, "jane@example.com 10.0.0.1"), (2, "none"), (3, None)], "id int, t string")
    spans = detect.detect_spans(df, "id", "t")
    assert spans.count() == 2
    assert detect.best_detection(spans, "id").collect() == [(1, "EMAIL_ADDRESS", 1.0)]
    out = {r["id"]: r["t"] for r in detect.anonymize(df, "id", "t", spans).collect()}
    assert out == {1: "[redacted] [redacted]", 2: "none", 3: None}
    allow = spark.createDataFrame([("10.0.0.1",)], "text string")
    assert [r["entity_type"] for r in detect.detect_spans(df, "id", "t", allow_list=allow).collect()] == ["EMAIL_ADDRESS"]


def test_best_ties_go_to_the_first(values):
    text = "10.0.0.1 then 10.0.0.2 and 555-123-4567"
    best = values([text, "none"], lambda c: detect.best_of(detect.span_array(c)))
    assert tuple(best[0]) == ("IP_ADDRESS", 0.6) and best[1] is None


def test_plugged_in_detector(spark):
    def names(texts):
        return [
            [{"entity_type": "PERSON", "start": t.index("Ann"), "end": t.index("Ann") + 3, "score": 0.9}]
            if "Ann" in t
            else []
            for t in texts
        ]

    def broken(texts):
        raise RuntimeError("down")

    def short(texts):
        return []

    df = spark.createDataFrame([(1, "hi Ann!", "Ann"), (2, "nobody", None)], "id int, a string, b string")
    out = detect.detection_layer(df, Detection(detector=names)).orderBy("id").collect()
    # "Ann" alone is shorter than four bytes and is left alone
    assert [tuple(r) for r in out] == [(1, "hi [redacted]!", "Ann"), (2, "nobody", None)]
    for bad in (broken, short):
        kept = detect.detection_layer(df, Detection(detector=bad)).orderBy("id").collect()
        assert [r["a"] for r in kept] == ["hi Ann!", "nobody"]
        with pytest.raises(Exception, match="detector unavailable"):
            detect.detection_layer(df, Detection(detector=bad, strict=True)).collect()
    clean = detect.detection_layer(df, Detection(detector=lambda ts: [[] for _ in ts], strict=True))
    assert clean.count() == 2


def test_long_local_parts_vanish_whole(values):
    long = "a" * 200 + ".b+c@example.org"
    cases = [long, f"x {long}, y", "one@example.org-two@example.org", "@example.org", "a" * 100_000, "a@b.com-x@y.org"]
    out = values(cases, lambda c: detect.mask_text(c))
    assert out[0] == "[redacted]" and out[1] == "x [redacted], y" and "@" not in out[2]
    assert out[3] == cases[3] and out[4] == cases[4] and "@" not in out[5]


ABROAD = {
    "+49 30 901820": True, "+44 (0)20 7946 0958": True, "+33 1 42 68 53 00": True, "+15551234567": True, "+971501234567": True,
    "+351 912 345 678": True, "+48 12 345": False, "+999 12": False, "+1 55512345": False, "+49": False, "+0 123 456 789": False,
}
SHORT = {
    "2001:db8::1": True, "::1": True, "fe80::1ff:fe23:4567:890a": True, "::ffff:192.0.2.128": True, "1:2:3:4:5:6:7::": True, "a::": True,
    "1::2::3": False, "::": False, "12:30:45": False, "::ffff:192.0.2.999": False, "std::vector": False, "1:2:3:4:5:6:7:8::": False, ":::1": False,
    "12345::1": False,
}


@pytest.mark.parametrize("entity, cases", [("PHONE_NUMBER", ABROAD), ("IP_ADDRESS", SHORT)])
def test_numbers_from_abroad_and_short_addresses(spark, entity, cases):
    df = spark.createDataFrame([(k, f"at ({k}), and {k}.") for k in cases], "k string, t string")
    got = {k: [] for k in cases}
    for r in detect.detect_spans(df, "k", "t", Detection(entities=[entity])).collect():
        got[r["k"]].append(r["text"])
    # parts of them may be found too: overlapping spans are all kept
    assert {k: v.count(k) == 2 for k, v in got.items()} == cases


def test_long_runs_cost_linear_time(spark):
    df = spark.createDataFrame([(1, "a" * 300_000 + " x::y " + "+1" * 100_000 + " " + "1" * 300_000)], "k int, t string")
    assert detect.detect_spans(df, "k", "t", Detection(entities=["IP_ADDRESS", "PHONE_NUMBER"])).count() == 0


def test_context_words_raise_scores(spark):
    own = [Recognizer("ACCOUNT", r"AC-[0-9]{4}", 0.3, context=("Account", "konto")), Recognizer("OTHER", r"ZZ[0-9]+", 0.3, language="fr")]
    texts = {
        "AC-0001": 0.3,
        "your account no. AC-0001": 0.65,
        "KONTO: AC-0001": 0.65,
        "account a b c d AC-0001": 0.65,
        "account a b c d e AC-0001": 0.3,  # the sixth word before
        "AC-0001 account": 0.3,
        "accounts AC-0001": 0.3,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    d = Detection(entities=["ACCOUNT", "OTHER"], recognizers=own, language="en")
    assert {r["t"]: round(r["score"], 9) for r in detect.detect_spans(df, "t", "t", d).collect()} == texts
    sure = {r["t"] for r in detect.detect_spans(df, "t", "t", dataclasses.replace(d, threshold=0.5)).collect()}
    assert sure == {t for t, s in texts.items() if s > 0.5}
    many = "konto AC-0001 " + "AC-0001 " * 6
    got = detect.detect_spans(spark.createDataFrame([(many,)], "t string"), "t", "t", d).orderBy("start").collect()
    assert [round(r["score"], 2) for r in got] == [0.65, 0.65, 0.65, 0.3, 0.3, 0.3, 0.3]  # each find is two words
    assert detect.detect_spans(spark.createDataFrame([("ZZ1",)], "t string"), "t", "t", dataclasses.replace(d, language="fr", min_len=1)).count() == 1


def test_many_spans_in_one_text(spark):
    """Masking costs about the length of a text, however many spans it has and whether they overlap."""
    own = [Recognizer("A", "x[0-9]", 0.9), Recognizer("B", "[0-9]y", 0.8), Recognizer("C", "x[0-9]y", 0.7)]
    d = Detection(entities=["A", "B", "C"], recognizers=own, anonymizers={"A": Anonymizer(new_value="<a>"), "C": Anonymizer(new_value="<c>")})
    lengths = (0, 1, 31, 32, 33, 63, 64, 65, 200, 3000)
    rows = [(n, " ".join(("x1y é", "x2", "-3y")[i % 3] for i in range(n)) + " end") for n in lengths]
    got = {r["n"]: r["t"] for r in spark.createDataFrame(rows, "n int, t string").select("n", detect.mask_text(F.col("t"), d).alias("t")).collect()}
    # the longer of two that begin together, then whatever begins behind it
    assert got == {n: " ".join(("<c> é", "<a>", "-[redacted]")[i % 3] for i in range(n)) + " end" for n in lengths}
