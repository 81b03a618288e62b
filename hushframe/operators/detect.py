"""Find personal data inside texts and rewrite it, all as column expressions.

Spans are 0-based character offsets with an exclusive end. A text is scanned once per wanted entity,
behind a cheap gate; only texts with a match pay for offsets, checks and rewriting.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import checks
from hushframe.functions.text import eligible, let
from hushframe.operators.columns import replace_columns
from hushframe.operators.rule_sets import matches_any, rule_spans
from hushframe.plans.policy import (
    DEFAULT_ENTITIES,
    Anonymizer,
    Detection,
    Recognizer,
    classify_columns,
)

SPAN = "struct<entity_type:string,start:int,end:int,score:double,text:string>"
SPANS = f"array<{SPAN}>"
HITS = "array<struct<no:int,matches:array<string>,gaps:array<string>>>"

# A match takes the whole run of characters before the sign, however long, and only begins where a run does (or
# right behind the match before), so that one long run of letters costs linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
IPV4 = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
# A run of letters, digits, colons and dots with two colons; `short_ipv6_ok` reads it.
IPV6_SHORT = r"(?:\G|(?<![0-9A-Za-z.:]))[0-9A-Za-z.]*+:(?:[0-9A-Za-z.]*+:)++(?:[0-9A-Za-z]++(?:\.[0-9A-Za-z]++)*+)?+"
PHONE_ABROAD = r"\+[1-9][0-9]{0,3}(?:[ ./-]?(?:\(0\))?[ ]?(?:\([0-9]+\)|[0-9]+)){1,7}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?\b"
CRYPTO = r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})\b"

# One pass that tells whether any of the numeric patterns can match at all.
NUMERIC_GATE = (
    r"[0-9](?:[0-9]{2}[ .-][0-9]{4}|(?:[ -]?[0-9]){12}|-[0-9]{2}-|\.[0-9]{1,3}\.[0-9]|[0-9A-Za-z]{11})"
    r"|[A-Z]{2}[0-9]{2}[ -]?[A-Z0-9]{4}"
)


def _ipv6_gate(text: Column) -> Column:
    return F.contains(text, F.lit(":")) & text.rlike(":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")


BUILT_IN = (
    Recognizer("EMAIL_ADDRESS", EMAIL, 1.0, gate=lambda t: F.contains(t, F.lit("@"))),
    Recognizer("IP_ADDRESS", IPV6, 0.6, gate=_ipv6_gate),
    Recognizer("IP_ADDRESS", IPV6_SHORT, 0.6, checks.short_ipv6_ok, lambda t: F.contains(t, F.lit("::"))),
    Recognizer("PHONE_NUMBER", PHONE_ABROAD, 0.4, checks.international_phone_ok, lambda t: F.contains(t, F.lit("+")) & t.rlike("[+][1-9]")),
    Recognizer("PHONE_NUMBER", PHONE, 0.4, gate=lambda t: t.rlike("[0-9]{3}[ .-][0-9]{4}"), numeric=True),
    Recognizer(
        "CREDIT_CARD", CARD, 1.0, checks.luhn_ok, lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"), numeric=True
    ),
    Recognizer("US_SSN", SSN, 0.5, checks.ssn_ok, lambda t: t.rlike("-[0-9]{2}-"), numeric=True),
    Recognizer("IP_ADDRESS", IPV4, 0.6, checks.ipv4_ok, lambda t: t.rlike(r"\.[0-9]{1,3}\.[0-9]"), numeric=True),
    Recognizer("IBAN_CODE", IBAN, 1.0, checks.iban_ok, lambda t: t.rlike("[A-Z]{2}[0-9]{2}[ -]?[A-Z0-9]{4}"), numeric=True),
    Recognizer("CRYPTO", CRYPTO, 1.0, checks.crypto_ok, lambda t: t.rlike("[13][0-9A-Za-z]{11}"), numeric=True),
)

#: A context word among so many words before a match raises its score by `CONTEXT_BOOST`, to `CONTEXT_LEAST` at least and
#: 1 at most. Words are runs of letters and digits, compared in lower case; those before the fifth-last match of the same
#: recognizer do not count.
CONTEXT_WORDS = 5
CONTEXT_BOOST = 0.35
CONTEXT_LEAST = 0.4

_BLOCK = 64
_PIECES = 32


def _offsets(lengths: Column) -> Column:
    """Running sum before each element, in blocks so that many matches stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, n: a + n)

    size = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int")),
        lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))),
    )
    starts = let(
        blocks,
        lambda s: F.transform(s, lambda _, b: F.when(b == 0, 0).otherwise(total(F.slice(s, F.lit(1), b)))),
    )
    return let(
        starts,
        lambda s: F.transform(
            lengths,
            lambda _, i: F.get(s, F.floor(i / _BLOCK).cast("int"))
            + F.when(i % _BLOCK == 0, 0).otherwise(
                total(F.slice(lengths, i - i % _BLOCK + 1, i % _BLOCK))
            ),
        ),
    )


def _hits(text: Column, r: Recognizer, no: int) -> Column:
    """Matches of one recognizer and the text between them; null when there is none."""
    matches = F.regexp_extract_all(text, F.lit(r.regex), F.lit(0))

    def keep(m: Column) -> Column:
        hit = F.struct(F.lit(no).alias("no"), m.alias("matches"), F.split(text, r.regex, -1).alias("gaps"))
        return F.when(F.size(m) > 0, hit)

    gate = F.lit(True) if r.gate is None else r.gate(text)
    return F.when(gate, let(matches, keep))


def _spans_of(hit: Column, recognizers: Sequence[Recognizer]) -> Column:
    """Turn the matches of one recognizer into spans."""
    entities = F.array(*[F.lit(r.entity) for r in recognizers])
    scores = F.array(*[F.lit(float(r.score)) for r in recognizers])
    # start of match k: every gap up to and including k, and every match before it
    steps = F.transform(
        hit["matches"],
        lambda m, k: F.char_length(F.get(hit["gaps"], k))
        + F.when(k > 0, F.char_length(F.get(hit["matches"], k - 1))).otherwise(0),
    )
    many = let(steps, lambda s: F.zip_with(_offsets(s), s, lambda a, b: a + b))
    starts = F.when(F.size(hit["matches"]) == 1, F.array(F.char_length(F.get(hit["gaps"], F.lit(0))))).otherwise(many)

    def span(m: Column, at: Column) -> Column:
        return F.struct(
            F.get(entities, hit["no"]).alias("entity_type"),
            at.alias("start"),
            (at + F.char_length(m)).alias("end"),
            F.get(scores, hit["no"]).alias("score"),
            m.alias("text"),
        )

    spans = F.zip_with(hit["matches"], starts, span)
    if any(r.context for r in recognizers):
        spans = _raise_by_context(hit, spans, recognizers)
    by_check: dict[Callable, list[int]] = {}
    for no, r in enumerate(recognizers):
        if r.check is not None:
            by_check.setdefault(r.check, []).append(no)
    if not by_check:
        return spans

    def holds(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(True))
        for check, numbers in by_check.items():
            out = out.when(hit["no"].isin(*numbers), check(s["text"]))
        return out.otherwise(F.lit(True))

    return F.filter(spans, holds)


def _raise_by_context(hit: Column, spans: Column, recognizers: Sequence[Recognizer]) -> Column:
    """Spans with a context word shortly before them get a higher score."""
    lists = F.array(*[F.array(*[F.lit(w.lower()) for w in r.context]).cast("array<string>") for r in recognizers])

    def nearest(k: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.greatest(k - CONTEXT_WORDS + 1, F.lit(0)), k),
            lambda j: F.concat(F.when(j > 0, F.get(hit["matches"], j - 1)).otherwise(F.lit("")), F.get(hit["gaps"], j)),
        )
        words = F.regexp_extract_all(F.lower(F.array_join(pieces, "")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        return let(words, lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT_WORDS + 1, F.lit(1)), F.lit(CONTEXT_WORDS)))

    def raised(context: Column) -> Column:
        return F.transform(
            spans,
            lambda s, k: F.when(
                F.arrays_overlap(nearest(k), context),
                s.withField("score", F.least(F.lit(1.0), F.greatest(s["score"] + CONTEXT_BOOST, F.lit(CONTEXT_LEAST)))),
            ).otherwise(s),
        )

    return let(F.get(lists, hit["no"]), lambda context: F.when(F.size(context) > 0, raised(context)).otherwise(spans))


def _best_score(r: Recognizer) -> float:
    return min(1.0, max(r.score + CONTEXT_BOOST, CONTEXT_LEAST)) if r.context else r.score


def active_recognizers(d: Detection) -> list[Recognizer]:
    """Built-in and own recognizers that the settings leave in force."""
    wanted = set(d.entities or DEFAULT_ENTITIES)
    # own recognizers act beside the built-ins; a list of entities restricts both
    own = [r for r in d.recognizers if not d.entities or r.entity in wanted]
    built_in = [r for r in BUILT_IN if r.entity in wanted]
    limit = d.threshold if d.threshold and d.threshold > 0 else None
    spoken = [r for r in built_in + own if not r.language or not d.language or r.language == d.language]
    return [r for r in spoken if limit is None or _best_score(r) >= limit]


def _allowed(span_text: Column, d: Detection) -> Column:
    if d.allow_match == "regex":
        return span_text.rlike("|".join(f"(?:{p})" for p in d.allow_list))
    return span_text.isin(*d.allow_list)


def _order_spans(spans: Column) -> Column:
    """By start, then the longer, then the surer one."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("k1"),
            (s["start"] - s["end"]).alias("k2"),
            (-s["score"]).alias("k3"),
            s["entity_type"].alias("k4"),
            s.alias("span"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def span_array(text: Column, d: Detection | None = None) -> Column:
    """All spans of a text, ordered by position; overlapping ones are all kept."""
    d = d or Detection()
    none = F.array().cast(SPANS)
    active = active_recognizers(d)
    if not active:
        return F.when(text.isNotNull(), none).otherwise(none)
    numeric = [_hits(text, r, no) for no, r in enumerate(active) if r.numeric]
    hits = F.array(*[_hits(text, r, no) for no, r in enumerate(active) if not r.numeric])
    if numeric:
        gated = F.when(text.rlike(NUMERIC_GATE), F.array(*numeric)).otherwise(F.array().cast(HITS))
        hits = F.concat(hits, gated) if len(numeric) < len(active) else gated
    found = let(
        F.filter(hits, lambda h: h.isNotNull()),
        lambda hs: F.when(
            F.size(hs) > 0, F.flatten(F.transform(hs, lambda h: _spans_of(h, active)))
        ).otherwise(none),
    )
    if d.threshold and any(r.context and r.score < d.threshold for r in active):
        found = F.filter(found, lambda x: x["score"] >= d.threshold)
    if d.allow_list:
        found = let(
            found,
            lambda s: F.when(F.size(s) > 0, F.filter(s, lambda x: ~_allowed(x["text"], d))).otherwise(s),
        )
    # two patterns of one entity may find the same
    ordered = let(found, lambda s: F.when(F.size(s) > 1, _order_spans(F.array_distinct(s))).otherwise(s))
    return F.when(eligible(text, d.min_len), ordered).otherwise(none)


def resolve_overlaps(spans: Column) -> Column:
    """Walk ordered spans and keep one only if it starts at or after the end of the last kept."""

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["end"]
        return F.struct(
            F.when(free, s["end"]).otherwise(acc["end"]).alias("end"),
            F.when(free, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"),
        )

    def walk(part: Column, end: Column) -> Column:
        return F.aggregate(part, F.struct(end.alias("end"), F.array().cast(SPANS).alias("kept")), step)

    def join(acc: Column, b: Column) -> Column:
        # arrays only grow inside a block; blocks are put side by side
        def joined(new: Column) -> Column:
            return F.struct(new["end"].alias("end"), F.concat(acc["kept"], F.array(new["kept"])).alias("kept"))

        return let(walk(F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK)), acc["end"]), joined)

    first = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPANS}>").alias("kept"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int"))
    free = F.forall(
        F.transform(spans, lambda s, i: (i == 0) | (s["start"] >= F.get(spans, i - 1)["end"])),
        lambda x: x,
    )
    return F.when((F.size(spans) < 2) | free, spans).otherwise(F.aggregate(blocks, first, join, lambda acc: F.flatten(acc["kept"])))


def rewrite(value: Column, how: Anonymizer) -> Column:
    """One found text, anonymized."""
    if how.type == "redact":
        return F.lit("")
    if how.type == "hash":
        return F.sha2(value, 256)
    if how.type == "mask":
        size = F.char_length(value)
        n = F.least(F.lit(max(how.chars_to_mask, 0)), size)
        cover = F.repeat(F.lit(how.masking_char), n)
        if how.from_end:
            return F.concat(F.left(value, size - n), cover)
        return F.concat(cover, F.substr(value, n + 1))
    return F.lit(how.new_value)


def _replacement(span: Column, anonymizers: Mapping[str, Anonymizer]) -> Column:
    default = rewrite(span["text"], anonymizers.get("DEFAULT", Anonymizer()))
    out = F.when(F.lit(False), default)
    for entity, how in anonymizers.items():
        if entity != "DEFAULT":
            out = out.when(span["entity_type"] == entity, rewrite(span["text"], how))
    return out.otherwise(default)


def splice(text: Column, spans: Column, anonymizers: Mapping[str, Anonymizer] | None = None) -> Column:
    """The text with every kept span rewritten; untouched when there is none."""
    rules = anonymizers or {}

    def build(kept: Column) -> Column:
        # cutting from a text costs its length: blocks of spans are cut from the text, spans from their block
        def block(b: Column) -> Column:
            part = F.slice(kept, b * _PIECES + 1, F.lit(_PIECES))
            at = F.when(b == 0, 0).otherwise(F.get(kept, b * _PIECES - 1)["end"])
            cut = F.struct(part.alias("part"), at.alias("at"))
            return let(
                cut,
                lambda c: let(
                    F.struct(F.substr(text, c["at"] + 1, F.element_at(c["part"], -1)["end"] - c["at"]).alias("text"), c["part"].alias("part"), c["at"].alias("at")),
                    pieces,
                ),
            )

        def pieces(c: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.when(i == 0, c["at"]).otherwise(F.get(c["part"], i - 1)["end"])
                return F.concat(let(before, lambda at: F.substr(c["text"], at - c["at"] + 1, s["start"] - at)), _replacement(s, rules))

            return F.array_join(F.transform(c["part"], piece), "")

        blocks = F.sequence(F.lit(0), F.floor((F.size(kept) - 1) / _PIECES).cast("int"))
        rest = F.substr(text, F.element_at(kept, -1)["end"] + 1)
        return F.concat(F.array_join(F.transform(blocks, block), ""), rest)

    def one(s: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), s["start"]), _replacement(s, rules), F.substr(text, s["end"] + 1))

    many = F.when(F.size(spans) > 1, let(resolve_overlaps(spans), build)).otherwise(text)
    return F.when(F.size(spans) == 1, let(F.get(spans, F.lit(0)), one)).otherwise(many)


def mask_text(text: Column, d: Detection | None = None) -> Column:
    """Detect and anonymize in one expression."""
    d = d or Detection()
    return let(span_array(text, d), lambda s: splice(text, s, d.anonymizers))


def detect_spans(
    df: DataFrame,
    id_col: str,
    text_col: str,
    detection: Detection | None = None,
    allow_list: DataFrame | None = None,
    recognizers: DataFrame | None = None,
    allow_patterns: DataFrame | None = None,
) -> DataFrame:
    """One row per span: id, span_no, entity_type, start, end, score, text.

    `allow_list` is a table with a column `text`, for lists too long to write into a plan; `allow_patterns` the same for
    patterns. `recognizers` is a table of further ones (entity, regex, score), see `rule_sets`.
    """
    if recognizers is None:
        found = df.select(id_col, span_array(F.col(text_col), detection).alias("_spans"))
    else:
        found = df.select(id_col, spans_with_rules(F.col(text_col), recognizers, detection).alias("_spans"))
    # the outer form: see inline_rows
    each = found.select(id_col, F.posexplode_outer("_spans").alias("span_no", "_s"))
    out = each.filter(F.col("span_no").isNotNull()).select(id_col, "span_no", "_s.*")
    if allow_list is not None:
        entries = allow_list.select("text").distinct()
        out = out.join(entries, "text", "left_anti")
    if allow_patterns is not None:
        out = out.filter(~matches_any(allow_patterns, F.col("text")))
    return out.select(id_col, "span_no", "entity_type", "start", "end", "score", "text")


def spans_with_rules(text: Column, recognizers: DataFrame, detection: Detection | None = None) -> Column:
    """The spans of the patterns in force and of a table of recognizers, in their common order."""
    d = detection or Detection()
    own = filter_spans(rule_spans(recognizers, text, d.min_len), d)
    return _order_spans(F.array_distinct(F.concat(span_array(text, d), own)))


def mask_by_rules(df: DataFrame, text_cols: Sequence[str], recognizers: DataFrame, detection: Detection | None = None) -> DataFrame:
    """Mask text columns by the patterns in force and by a table of recognizers."""
    d = detection or Detection()
    staged = df.withColumns({f"_spans_{i}": spans_with_rules(F.col(f"`{c}`"), recognizers, d) for i, c in enumerate(text_cols)})
    masked = {c: splice(F.col(f"`{c}`"), F.col(f"_spans_{i}"), d.anonymizers) for i, c in enumerate(text_cols)}
    return replace_columns(staged, masked).select(*[F.col(f"`{c}`") for c in df.columns])


def anonymize(
    df: DataFrame,
    id_col: str,
    text_col: str,
    spans: DataFrame,
    anonymizers: Mapping[str, Anonymizer] | None = None,
) -> DataFrame:
    """Rewrite texts by a table of spans, such as one corrected by hand.

    `id_col` is unique in `df`, so a group is the spans of a single text.
    """
    fields = F.struct("entity_type", "start", "end", "score", "text")
    per_text = spans.groupBy(id_col).agg(F.collect_list(fields).cast(SPANS).alias("_spans"))
    joined = df.join(per_text, id_col, "left")
    ordered = _order_spans(F.coalesce(F.col("_spans"), F.array().cast(SPANS)))
    masked = let(ordered, lambda s: splice(F.col(text_col), s, anonymizers))
    return joined.withColumn(text_col, masked).select(*df.columns)


def best_detection(spans: DataFrame, id_col: str) -> DataFrame:
    """Category of the highest score per value, the first span winning ties."""
    best = F.max_by(F.struct("entity_type", "score"), F.struct(F.col("score"), -F.col("span_no")))
    return (
        spans.groupBy(id_col)
        .agg(best.alias("_best"))
        .select(id_col, F.col("_best.entity_type").alias("category"), F.col("_best.score").alias("confidence"))
    )


def best_of(spans: Column) -> Column:
    """(category, confidence) of an array of spans, null when it is empty."""
    ranked = F.transform(
        spans,
        lambda s, i: F.struct(
            s["score"].alias("score"), (-i).alias("no"), s["entity_type"].alias("entity")
        ),
    )
    top = F.array_max(ranked)
    return F.when(
        F.size(spans) > 0,
        F.struct(top["entity"].alias("category"), top["score"].alias("confidence")),
    )


Detector = Callable[[Sequence[str]], Sequence[Sequence[Mapping]]]


def detector_call(detector: Detector, columns: Sequence[Column], min_len: int = 4) -> Column:
    """Run a plugged-in detector, one call per Arrow batch for all eligible columns.

    The result has one entry per column: `spans`, and `failed` when the call raised or answered with
    the wrong number of results.
    """

    def run(*series: pd.Series) -> pd.Series:
        wanted = [(c, i) for c, s in enumerate(series) for i, v in enumerate(s) if v is not None]
        size = len(series[0])
        out = [[{"spans": [], "failed": False} for _ in series] for _ in range(size)]
        texts = [series[c].iloc[i] for c, i in wanted]
        try:
            found = list(detector(texts)) if texts else []
            failed = len(found) != len(texts)
        except Exception:
            found, failed = [], True
        for n, (c, i) in enumerate(wanted):
            if failed:
                out[i][c]["failed"] = True
                continue
            text = texts[n]
            out[i][c]["spans"] = [
                {
                    "entity_type": s["entity_type"],
                    "start": int(s["start"]),
                    "end": int(s["end"]),
                    "score": float(s["score"]),
                    "text": text[int(s["start"]) : int(s["end"])],
                }
                for s in found[n]
            ]
        return pd.Series(out)

    # annotations are objects here: the module postpones their evaluation
    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, f"array<struct<spans:{SPANS},failed:boolean>>")
    return udf(*[F.when(eligible(c, min_len), c) for c in columns])


def detector_over(detector: Detector, texts: Column, min_len: int = 4) -> Column:
    """Run a plugged-in detector on arrays of texts, one call per Arrow batch; one entry per text."""

    def run(arrays: pd.Series) -> pd.Series:
        flat = [t for a in arrays for t in (a if a is not None else ()) if t]
        try:
            found = list(detector(flat)) if flat else []
            failed = len(found) != len(flat)
        except Exception:
            found, failed = [], True
        out, at = [], 0
        for a in arrays:
            entries = []
            for text in a if a is not None else ():
                if not text:
                    entries.append({"spans": [], "failed": failed})
                    continue
                spans = [] if failed else [
                    {"entity_type": s["entity_type"], "start": int(s["start"]), "end": int(s["end"]), "score": float(s["score"]), "text": text[int(s["start"]) : int(s["end"])]}
                    for s in found[at]
                ]
                entries.append({"spans": spans, "failed": failed})
                at += 1
            out.append(entries)
        return pd.Series(out)

    run.__annotations__ = {"arrays": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, f"array<struct<spans:{SPANS},failed:boolean>>")
    return udf(F.transform(texts, lambda t: F.when(eligible(t, min_len), t).otherwise(F.lit(""))))


def masked_texts(texts: Column, d: Detection) -> Column:
    """Every text of an array, masked by its content; by the plugged-in detector where there is one."""
    if d.detector is None:
        return F.transform(texts, lambda t: mask_text(t, d))

    def spliced(text: Column, entry: Column) -> Column:
        on_failure = F.raise_error(F.lit("detector unavailable")).cast("string") if d.strict else text
        return F.when(entry["failed"] & eligible(text, d.min_len), on_failure).otherwise(_splice_found(text, filter_spans(entry["spans"], d), d))

    return F.zip_with(texts, detector_over(d.detector, texts, d.min_len), spliced)


FOUND = "struct<text:string,looked:boolean,spans:array<struct<entity_type:string,size:int>>>"


def found_texts(texts: Column, d: Detection, text: bool = True) -> Column:
    """For every text of an array what detection makes of it (null unless `text`), whether it was long enough to be
    looked at, and its spans with their sizes: all of one scan, by the plugged-in detector where there is one."""

    def entry(value: Column, spans: Column, masked: Column) -> Column:
        sizes = F.transform(spans, lambda s: F.struct(s["entity_type"], (s["end"] - s["start"]).alias("size")))
        shown = masked if text else F.lit(None).cast("string")
        return F.struct(shown.alias("text"), eligible(value, d.min_len).alias("looked"), sizes.alias("spans"))

    if d.detector is None:
        return F.transform(texts, lambda v: let(span_array(v, d), lambda s: entry(v, s, splice(v, s, d.anonymizers))))

    def answered(value: Column, answer: Column) -> Column:
        failed = answer["failed"] & eligible(value, d.min_len)
        on_failure = F.raise_error(F.lit("detector unavailable")).cast("string") if d.strict else value
        spans = F.when(failed, F.array().cast(SPANS)).otherwise(filter_spans(answer["spans"], d))
        return let(_order_spans(spans), lambda s: entry(value, s, F.when(failed, on_failure).otherwise(splice(value, s, d.anonymizers))))

    return F.zip_with(texts, detector_over(d.detector, texts, d.min_len), answered)


def filter_spans(spans: Column, d: Detection) -> Column:
    """Entity list, threshold and allow list on spans a plugged-in detector gave."""
    wanted = tuple(d.entities or DEFAULT_ENTITIES)
    out = F.filter(spans, lambda s: s["entity_type"].isin(*wanted)) if d.entities else spans
    if d.threshold and d.threshold > 0:
        out = F.filter(out, lambda s: s["score"] >= d.threshold)
    if d.allow_list:
        out = F.filter(out, lambda s: ~_allowed(s["text"], d))
    return out


def _splice_found(text: Column, spans: Column, d: Detection) -> Column:
    return let(_order_spans(spans), lambda s: splice(text, s, d.anonymizers))


def detection_layer(df: DataFrame, d: Detection) -> DataFrame:
    """Mask every free-text column by its content."""
    names = [c.name for c in classify_columns(df.schema) if c.free_text]
    if not names:
        return df
    if d.detector is None:
        if len(names) <= 2:
            return replace_columns(df, {n: mask_text(F.col(f"`{n}`"), d) for n in names})
        # one expression for all columns: the plan does not grow with the width of the table
        texts = F.array(*[F.col(f"`{n}`") for n in names])
        done = df.withColumn("_masked", F.transform(texts, lambda v: mask_text(v, d)))
        return replace_columns(done, {n: F.get("_masked", F.lit(i)) for i, n in enumerate(names)}).drop("_masked")
    called = df.withColumn("_found", detector_call(d.detector, [F.col(f"`{n}`") for n in names], d.min_len))
    masked = {}
    for i, n in enumerate(names):
        col, entry = F.col(f"`{n}`"), F.get(F.col("_found"), F.lit(i))
        done = _splice_found(col, filter_spans(entry["spans"], d), d)
        on_failure = F.raise_error(F.lit("detector unavailable")).cast("string") if d.strict else col
        masked[n] = F.when(entry["failed"], on_failure).otherwise(done)
    return replace_columns(called, masked).drop("_found")
