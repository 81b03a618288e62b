"""Operators of training-data pipelines against brute force, round trips and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from hushframe.llm import katz, language, neardup, packing, quality, rans, tokencount, toxicity, vectors
from hushframe.llm.common import remainder
from hushframe.llm.components import components
from hushframe.llm.decontaminate import decontaminate, verbatim_matches, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use themselves
CLASH = "score double, fp string, spans string, matches string, label string, n long, block long, ids string, part long, queue string, lang_pred string"
SYLLABLES = ["ka", "lo", "mi", "ter", "an", "sol", "ve", "ru", "dim", "po"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    """Texts of all odd kinds: (id, text, lang, source)."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, "xx", f"s{i % 3}") for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        w = t.split()
        if len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "xx", "s0"))
    rows += [(200, base[3], None, None), (200, base[3], None, None), (201, base[3].upper() + " !", "xx", "s1")]
    rows += [(300, None, None, None), (301, "", "xx", "s1"), (302, " \n\t ", "xx", "s1"), (303, "one", None, "s2"), (None, "no id here", "xx", None)]
    rows += [(400, prose(rng, 6000), "yy", "long"), (401, "Ärger über Öl, don't!! 12,5 % … “q”", "yy", "s1"), (402, "1234 --- 5678", "yy", "s1")]
    rows += [(404, "one<|endoftext|>two <|startoftext|> <|ENDOFTEXT|>. <|end oftext|>", "yy", "s1")]
    rows += [(403, "tie tie tie tie tie tie tie", None, "s1"), (403, "another text under the same id", None, "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in corpus()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = [F.lit("x").alias(c.split()[0]) if "string" in c else F.lit(1).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")]
    return df.select("*", *clash)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def text_of(r):
    return r[1] or ""


# 1


def test_katz_against_counts(spark, docs, empty):
    rows = corpus()
    seqs = [text_of(r).encode().lower().split() + [None] for r in rows]
    learn = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 != 2 for r in rows]
    one, two, three = Counter(), Counter(), Counter()
    for s, ok in zip(seqs, learn):
        if ok:
            one.update(s)
            two.update(zip(["<"] + s, s))
            three.update(zip(["<", "<"] + s, ["<"] + s, s))

    def rule(counts):
        n = Counter(counts.values())
        return katz.discounts([n[i] for i in range(1, katz.DEPTH + 2)])

    def taken(x, r):
        return x * r[0][min(x, katz.DEPTH + 1) - 1] - r[1]

    total, rules = sum(one.values()), [rule(one), rule(two), rule(three)]
    p1 = {w: taken(x, rules[0]) / total for w, x in one.items()}
    unknown = 1 - sum(p1.values())

    def level(counts, r, lower):
        size, mass, below = Counter(), Counter(), Counter()
        for gram, x in counts.items():
            size[gram[:-1]] += x
            mass[gram[:-1]] += taken(x, r)
            below[gram[:-1]] += lower(gram[1:])
        den = {h: size[h] if size[h] - mass[h] > 1e-9 * size[h] else size[h] + 1 for h in size}
        back = {h: (1 - mass[h] / den[h]) / (1 - below[h]) for h in size}
        return lambda gram: taken(counts[gram], r) / den[gram[:-1]] if counts[gram] else back.get(gram[:-1], 1.0) * lower(gram[1:])

    p2 = level(two, rules[1], lambda g: p1.get(g[0], unknown))
    p3 = level(three, rules[2], p2)
    # every context sums to one, with the unknown word
    for h in list(two)[:5]:
        assert math.isclose(sum(p3((h[0], h[1], w)) for w in one) + p3((h[0], h[1], "?")), 1, rel_tol=1e-9)
    for order in (2, 3):
        got = katz.katz_scores(docs, remainder(F.col("doc_id"), 7) != 2, order).collect()
        want = []
        for r, s, ok in zip(rows, seqs, learn):
            ctx = ["<", "<"] + s
            p = [p2((ctx[i + 1], w)) if order == 2 else p3((ctx[i], ctx[i + 1], w)) for i, w in enumerate(s)]
            base = sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in s)
            want.append((str(r[0]), ok, len(s), sum(one[w] > 0 for w in s), round(base, 6), round(sum(map(math.log10, p)), 6)))
        have = [(str(r["doc_id"]), r["train"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
        assert sorted(have) == sorted(want) and {r["train_tokens"] for r in got} == {total}
    assert katz.katz_scores(empty, F.lit(True)).count() == 0
    unlearned = katz.katz_scores(docs, F.lit(False)).agg(F.max("score"), F.min("score"), F.max("n_known")).first()
    assert tuple(unlearned) == (0.0, 0.0, 0)


def test_katz_query_uses_trigrams(spark, monkeypatch):
    """The middle word is the same in both texts, so only the word before it tells what follows."""
    from hushframe.llm import op1

    texts = ["red cat runs", "big cat sits"] * 20
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "red cat runs"), (1001, "red cat sits")]
    monkeypatch.setattr(op1, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in op1.op1_katz(spark, "").collect()}
    assert got[1000] > got[1001] + 0.5


# 2


def shingle_sets():
    out = []
    for r in corpus():
        w = words(text_of(r).encode())
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_near_duplicates_against_all_pairs(docs, empty):
    rows, sets = corpus(), shingle_sets()
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            root[i] = min([root[i], *(root[j] for j in links[i])])
    names = {}
    for i in range(n):
        if rows[i][0] is not None:
            names[root[i]] = min(names.get(root[i], 1 << 60), rows[i][0])
    want = sorted((str(rows[i][0]), len(links[i]), str(names.get(root[i]))) for i in range(n))
    got = neardup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], str(r["component_id"])) for r in got) == want
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    texts = {i: text_of(r) for i, r in enumerate(rows)}
    with_words = {root[i] for i in range(n) if sets[i]}
    assert len(ids) == len(with_words) + sum(not s for s in sets) and texts


def test_forest_depth_meets_the_recall():
    d = neardup.forest_depth()
    assert 1 - (1 - 0.8**d) ** neardup.TREES >= neardup.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** neardup.TREES


def test_hot_group_is_dealt_to_chunks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_CLASSES", 7)
    rng = random.Random(3)
    base = prose(rng, 100).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[i % 90] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for _, t in rows]
    want = {i: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {r["doc_id"]: r["n_links"] for r in got} == want and min(want.values()) > 40


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


# 3


def encoded(end):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [np.array(tokenizer.encode(text_of(r), add_special_tokens=False).ids + [end], "<u4") for r in corpus()]


def test_packing_holds_every_id_once(docs, empty):
    ids = encoded(1)
    pieces = packing.pack(docs, TOKENIZER).collect()
    # equal rows of one id cannot be told apart: compare what each piece holds
    want, got = Counter(), Counter()
    for r, x in zip(corpus(), ids):
        want.update((str(r[0]), len(x), i, int(t)) for i, t in enumerate(x))
    for p in pieces:
        data = np.frombuffer(p["ids"], "<u4")
        assert len(data) == p["length"]
        got.update((str(p["doc_id"]), p["doc_tokens"], p["start"] + i, int(t)) for i, t in enumerate(data))
    assert got == want
    ends = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert ends[p["sequence_id"]] == p["offset"]
        ends[p["sequence_id"]] += p["length"]
    assert sorted(ends) == list(range(len(ends))) and all(ends[i] == 2048 for i in range(len(ends) - 1))
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packing_keeps_the_mixture(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 300), "big" if i % 3 else "small") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    shares = {}
    for p in packing.pack(df, TOKENIZER, window=256, targets={"big": 0.25, "small": 0.75}).collect():
        shares.setdefault(p["sequence_id"], Counter())[source[p["doc_id"]]] += p["length"]
    assert all(abs(shares[i]["small"] - 192) <= 2 for i in range(5))
    assert all(shares[i]["small"] == 0 for i in range(len(shares) - 3, len(shares)))  # that source ran dry


def test_targets_hold_with_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    rng = random.Random(6)
    names = ["big", "big", "small", None, "#0", "c", "d"]
    rows = [(i, prose(rng, 300), names[i % 7]) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for targets in ({"big": 0.25, "small": 0.75}, {"#0": 0.5, None: 0.5}):
        shares, every = {}, Counter()
        for p in packing.pack(df, TOKENIZER, window=256, targets=targets).collect():
            shares.setdefault(p["sequence_id"], Counter())[names[p["doc_id"] % 7]] += p["length"]
            every[p["doc_id"]] += p["length"]
            assert p["doc_tokens"] >= every[p["doc_id"]]
        assert all(abs(shares[i][x] - 256 * t) <= 2 for i in range(5) for x, t in targets.items())
        assert set(every) == set(range(70))


def test_schedule_sums_to_all(spark):
    plan = packing.Schedule([10_000, 3, 500_000], [1.0, 1.0, 5.0], 64)
    last = int(plan.start[-1]) + 20_000
    assert plan.granted(np.array([last])).tolist() == [[10_000, 3, 500_000]]
    for q, total in ((0, 10_000), (1, 3), (2, 500_000)):
        at = np.array([0, total // 2, total - 1])
        r = plan.round_of(np.full(3, q), at)
        assert (plan.granted(r)[:, q] > at).all() and (plan.granted(r - 1)[:, q] <= at).all()


# 4


def test_decontamination_against_search(spark, docs, empty):
    texts = {r[0]: text_of(r) for r in corpus()}
    long = texts[400].split()
    items = [("a", " ".join(long[50:75])), ("b", texts[5][:200]), ("b", texts[5][:200]), ("c", "tie tie"), ("d", None), (None, texts[6]), ("e", "..."), ("f", " ".join(long[60:69]))]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def search(text):
        w, hit, found = words(text.encode()), set(), set()
        for item, t in items:
            q = words((t or "").encode())
            m = min(10, len(q))
            for i in range(len(q) - m + 1 if m and item is not None else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == q[i : i + m]:
                        hit.update(range(j, j + m))
                        found.add(item)
        return len(w), len(hit), ",".join(sorted(found))

    want = sorted((str(r[0]), *search(text_of(r))) for r in corpus())
    for part_bytes in (1 << 20, 60):  # in one part, and in several
        got = verbatim_matches(docs, bench, result="found", part_bytes=part_bytes).collect()
        have = [(str(r["doc_id"]), r["found"]["n_words"], r["found"]["n_hit"], ",".join(sorted({s["item_id"] for s in r["found"]["spans"]}))) for r in got]
        assert sorted(have) == want
    spans = next(r["found"]["spans"] for r in got if r["doc_id"] == 400)
    assert any((s["item_id"], s["start"], s["length"]) == ("a", 50, 25) for s in spans)  # the longest match, not its windows
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(d for d, _, n, _ in want if n == 0)
    assert decontaminate(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == docs.count()


# 5


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    back = rans.round_trip(docs, TOKENIZER, folder=folder).collect()
    want = Counter((str(r[0]), x.tobytes()) for r, x in zip(corpus(), encoded(2)))
    assert Counter((str(r["doc_id"]), bytes(r["ids"])) for r in back) == want
    at = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(back, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert rans.round_trip(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 1000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.5, n).clip(0, 999).astype(np.uint32)
    frequency = rans.scaled(np.bincount(np.append(ids, 3), minlength=1000))
    assert frequency.sum() == 1 << rans.SCALE and (frequency[np.unique(ids)] > 0).all()
    data = rans.encode(ids, frequency, lanes=8, check=4)
    decoder = rans.Decoder(frequency)
    assert (decoder.decode(data) == ids).all()
    for first, last in ((0, n), (n // 2, n), (n // 3, n // 2)):  # from a checkpoint
        assert (decoder.decode(data, first, last) == ids[first:last]).all()
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        decoder.decode(bytes(broken))


# 6, 8, 9


def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        text = prose(rng, rng.randint(5, 60))
        bad, toxic = i % 4 == 0, i % 6 == 1
        if bad:
            text = " ".join(w + "###" for w in text.split())
        if toxic:
            text += " " + rng.choice(["idiot", "moron", "idiot moron"])
        rows.append((i, text, "xx", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(5, None, None), (None, 1, 1), (7, 0, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty):
    train, labels = labelled(spark)
    weights = quality.train(train, labels)
    made = train.select("doc_id", quality.score(spark, weights, F.col("text")).alias("s")).collect()
    assert sum((r["s"] >= quality.THRESHOLD) == (r["doc_id"] % 4 != 0) for r in made) >= 236
    odd = docs.select("doc_id", "text", quality.score(spark, weights, F.col("text")).alias("s")).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["s"] <= 1 for r in odd)
    assert len({r["s"] for r in odd if not (r["text"] or "").strip()}) == 1
    assert empty.select(quality.score(spark, weights, F.col("text"))).count() == 0
    unlearned = quality.train(train, labels.limit(0))
    assert train.select(quality.score(spark, unlearned, F.col("text")).alias("s")).distinct().first()[0] == 0.5


def test_toxicity(spark, docs, empty):
    train, labels = labelled(spark)
    cost = toxicity.letter_model(train)
    weights = toxicity.train(train, labels, cost)
    disguises = ["1d10t", "id1ot", "iiidiot", "i.d.i.o.t", "i d i o t", "m0r0n", "moooron", "!diot"]
    rows = [(i, "kalomi soltera " + w + " dimpo") for i, w in enumerate(disguises)] + [(50, "kalomi soltera dimpo"), (51, None), (52, "ka1 lo2 9 9 9 9")]
    shown = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", toxicity.score(spark, cost, weights, F.col("text")).alias("s"))
    got = {r["doc_id"]: r["s"] >= toxicity.THRESHOLD for r in shown.collect()}
    assert got == {**{i: True for i in range(len(disguises))}, 50: False, 51: False, 52: False}
    odd = docs.select(toxicity.score(spark, cost, weights, F.col("text")).alias("s")).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["s"] <= 1 for r in odd)
    assert empty.select(toxicity.score(spark, cost, weights, F.col("text"))).count() == 0
    assert toxicity.letter_model(empty).shape == (toxicity.BASE**4,)


def test_toxicity_of_spaced_words(spark):
    text = "you are a stupid idiot with a big ass and that is what you are " * 20
    cost = toxicity.letter_model(spark.createDataFrame([(text,)], "text string"))

    def read(text):
        words, ids, _ = toxicity.restored([text.encode()], cost)
        return {words[i] for i in ids}

    assert read("a s t u p i d") == {"a", "stupid"}
    assert read("y o u i d i o t") == {"you", "idiot"}
    assert read("s t u p i d i d i o t") == {"stupid", "idiot"}
    assert read("s . t . u . p . i . d") == {"stupid"}
    assert read("@$$") == read("455") == {"ass"}
    assert read("idiiot") == {"idiot"} and read("stuupid") == {"stupid"}
    assert read("you are") == {"you", "are"} and read("") == set()


def test_decoding_is_the_cheapest_path(spark):
    """Against all readings of short words."""
    train, _ = labelled(spark)
    cost = toxicity.letter_model(train)

    def price(text):
        s = [toxicity.EDGE] * 3 + toxicity._symbols(text) + [toxicity.EDGE]
        return sum(float(cost[((s[i] * 32 + s[i + 1]) * 32 + s[i + 2]) * 32 + s[i + 3]]) for i in range(len(s) - 3))

    def readings(word):
        if not word:
            return [("", 0.0)]
        c = word[0]
        options = [(c, 0.0 if c.isalpha() else toxicity.KEEP_COST)] + [(x, toxicity.LOOK_COST) for x in toxicity.LOOKS.get(c, "")]
        if c in toxicity.BETWEEN:
            options.append(("", toxicity.DROP_COST))
        return [(x + rest, p + q) for x, p in options for rest, q in readings(word[1:])]

    for word in ("1d10t", "m0r.n", "4@3", "k-a1", "*x"):
        best = min(readings(word), key=lambda r: r[1] + price(r[0]))
        assert math.isclose(best[1] + price(best[0]), min(r[1] + price(r[0]) for r in readings(word) if r[0] == toxicity.decode(word, cost)))


def test_language(spark, docs, empty):
    rng = random.Random(2)
    own = {"aa": ["zor", "quil", "brex"], "bb": ["mana", "lupo", "fina"], "cc": ["schnt", "wurg", "krom"]}
    rows = [(i, " ".join("".join(rng.choice(own[lang]) for _ in range(2)) for _ in range(30)), lang) for i in range(60) for lang in own]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = language.train(df.union(spark.createDataFrame([(900, "unlabelled", None), (901, None, "aa")], df.schema)))
    assert f.langs == ["aa", "bb", "cc"]
    got = df.select("lang", language.identify(spark, f, F.col("text")).alias("x")).collect()
    assert all(r["lang"] == r["x"]["lang"] and r["x"]["score"] > 0.5 for r in got)
    odd = docs.select("text", language.identify(spark, f, F.col("text")).alias("x")).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["x"]["score"] <= 1 for r in odd)
    assert all((r["x"]["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in odd)
    assert empty.select(language.identify(spark, f, F.col("text"))).count() == 0
    nothing = language.train(empty)
    assert {r[0]["lang"] for r in docs.select(language.identify(spark, nothing, F.col("text"))).collect()} == {"und"}


def test_filter_holds_shared_and_rare_grams(spark):
    """Eight languages share most words; a word used once among many is still its language's."""
    rng = random.Random(8)
    shared = [prose(rng, 30) for _ in range(8)]
    langs = list("abcdefgh")
    rows = [(" ".join(shared) + f" zq{x}", x) for x in langs] + [(prose(rng, 100) * 500, "a"), ("xyxyx " + "ka " * 300_000, "h")]
    f = language.train(spark.createDataFrame(rows, "text string, lang string"))

    def held(text):
        some, _, _ = language.grams(text.encode().split())
        return np.bitwise_and.reduce([f.slots[s] for s in language._probes(np.unique(some), len(f.slots))])

    masks = held(" ".join(shared))
    assert all(language._bit(masks, i).all() for i in range(8))
    assert all(language._bit(held(f"zq{x}"), i).all() for i, x in enumerate(langs))
    assert language._bit(held("xyxyx"), 7).all()
    text = spark.createDataFrame([(" ".join(shared),), ("xyxyx",), ("wvwvwvwv",)], "text string")
    got = [r[0] for r in text.coalesce(1).select(language.identify(spark, f, F.col("text"))).collect()]
    assert got[0]["told"] and got[0]["score"] < 0.35  # eight languages alike, each with all the evidence
    assert got[1]["told"] and got[1]["lang"] == "h" and not got[2]["told"]


def test_filter_holds_all_and_few_others(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(prose(rng, 400), "a"), (prose(rng, 400)[::-1], "b")], "text string, lang string")
    f = language.train(df)
    held, _, _ = language.grams([w for t, lang in df.collect() if lang == "a" for w in t.encode().split()])
    masks = np.bitwise_and.reduce([f.slots[s] for s in language._probes(np.unique(held), len(f.slots))])
    assert language._bit(masks, 0).mean() > 0.6  # the rest belongs to the other language by its rate
    strange = np.random.default_rng(0).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    masks = np.bitwise_and.reduce([f.slots[s] for s in language._probes(strange, len(f.slots))])
    assert abs(language._bit(masks, 0).mean() - f.false[0]) < 0.01


# 7


def test_token_counts_against_the_library(spark, docs, empty):
    pieces = tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    toy = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -3.0), ("aba", -3.0), ("▁▁", -2.5)]
    for vocab, odd in ((pieces, []), (toy, ["abab", "aaba  ab", "xaby", "  ", " a", "▁ab", "日本ab"])):
        tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False))
        tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        texts = [text_of(r) for r in corpus()] + odd
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        got = df.select("i", tokencount.token_counts(spark, vocab, F.col("text")).alias("t")).collect()
        assert {r["i"]: r["t"]["n_tokens"] for r in got} == {i: len(tokenizer.encode(t).ids) for i, t in enumerate(texts)}
    got = docs.select("text", tokencount.token_counts(spark, toy, F.col("text")).alias("t")).collect()
    assert all(r["t"]["n_tokens"] == 0 for r in got if not r["text"])
    assert empty.select(tokencount.token_counts(spark, toy, F.col("text"))).count() == 0


def test_token_counts_of_whole_texts():
    # a piece with the sign inside: no cutting there
    counter = tokencount.Counter([("▁", -1.0), ("a", -1.0), ("a▁a", -0.5), ("aa", -3.0)])
    assert not counter.parts and counter.counts([b"a a a", b"aaa", b""])[0] == [4, 4, 0]


# 10


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = [base[i] for i in range(60)]
    rows += [base[i % 6] + 0.05 * rng.standard_normal(16) for i in range(140)]
    rows += [rows[0], rows[0] * 3, rows[61]]
    values = [x.astype(np.float32).tolist() for x in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None, 2.0], [float("inf")] + [0.0] * 15, values[0][:8], values[0][:8]]
    data = [(i, v, 0) for i, v in enumerate(values + odd)] + [(None, [1.0] + [0.0] * 15, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4)
    n = len(data)

    def good(v):
        return v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v)

    x = [np.array(v, np.float64) if good(v) else None for _, v, _ in data]
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95
    links = [[j for j in range(n) if j != i and near(x[i], x[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(6):
        for i in range(n):
            root[i] = min([root[i], *(root[j] for j in links[i])])
    want = sorted((str(data[i][0]), len(links[i]), str(data[root[i]][0])) for i in range(n))
    got = vectors.near_duplicate_vectors(df, window=16).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_a_dense_cluster(spark):
    """A third of the rows points one way without being linked; pairs at 0.952 in it are all found."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rng.normal(size=64))
    cluster = unit(0.95 * axis + 0.312 * unit(rng.normal(size=(1000, 64))))
    across = rng.normal(size=(60, 64))
    base = cluster[:60]
    across = unit(across - (across * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([cluster, 0.952 * base + math.sqrt(1 - 0.952**2) * across, unit(rng.normal(size=(2000, 64)))])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert 60 <= near.sum() / 2 < 200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicate_vectors(df, window=4).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(axis=1).tolist()


def test_vectors_meet_over_short_partitions():
    assert sorted(vectors._borders({0: 4, 1: 1, 3: 2, 4: 4}, 4)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (3, 3)]
    assert vectors._borders({}, 4) == []


def test_hash_of_ids_is_the_contracts():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def _katz_rows(blocks):
    import numpy as np
    import pyarrow as pa
    import zstandard

    from hushframe.llm.common import word_hashes

    rows = []
    for number, texts in enumerate(blocks):
        words = sorted({w for x in texts for w in x.split()})
        ids = np.array([words.index(w) for x in texts for w in x.split()], "<u4")
        planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes()
        sizes = [len(x.split()) for x in texts]
        hashes = word_hashes([w.encode() for w in words]).tobytes()
        rows.append({"block": number, "doc_ids": sizes, "train": [True] * len(texts), "sizes": sizes, "hashes": hashes, "ids": zstandard.compress(planes)})
    return pa.Table.from_pylist(rows)


def test_katz_sends_only_what_other_blocks_hold():
    import pyarrow as pa

    blocks = _katz_rows([["a b c d", "a b"], ["a b x y z", "c"]])
    heard = [[], []]
    # words: a b c d and the end; a b x y z c and the end. Pairs without d, x, y and z: start a, ab, bc, b end; start a, ab, start c, c end
    for n, expected in ((1, 5 + 7), (2, 4 + 4)):
        replies = [pa.table({c: [r[c] for r in x] for c in ("bucket", "block", "order", "kind", "data")}) for x in heard]
        pieces = pa.concat_tables([katz._send_counts(n, 1)(blocks.slice(i, 1), replies[i]) for i in (0, 1)])
        assert sum(len(katz.expand(katz.parted(r["data"])[0])) for r in pieces.to_pylist() if r["block"] >= 0) == expected
        answers = katz._add_counts(pieces).to_pylist()
        for r in answers:
            if r["block"] >= 0:
                heard[r["block"]].append({**r, "kind": "counts"})
        # every occurrence is counted, sent or not
        assert sum(np.frombuffer(r["data"], np.int64)[-1] for r in answers if r["block"] == -1) == 16


def _calls(f, *args):
    """How many built-in functions `f` calls."""
    import sys

    found = [0]

    def seen(frame, event, arg):
        found[0] += event == "c_call"

    sys.setprofile(seen)
    try:
        out = f(*args)
    finally:
        sys.setprofile(None)
    return out, found[0]


def test_runs_are_parted_by_columns():
    import pyarrow as pa

    from hushframe.llm.tokens import chunk_encoder

    with open(TOKENIZER, encoding="utf-8") as file:
        spec = file.read()
    encode, plain = chunk_encoder(spec), Tokenizer.from_str(spec)
    stems = [a + b for a in SYLLABLES for b in SYLLABLES]
    runs = [w + a + b + c for w in stems for a in ".,;:!" for b in ".,;:!?" for c in ",!?"]
    texts = [" ".join(runs[i::50]) for i in range(50)] + ["Éa. ß! x.y 7, ._", "", None]
    (flat, sizes), calls = _calls(encode, pa.array(texts))
    assert calls < len(runs) / 2  # no call for each run
    want = [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert flat.tolist() == [i for x in want for i in x] and sizes.tolist() == list(map(len, want))


def test_edges_of_a_character_are_made_once():
    cost = np.full(toxicity.BASE**4, 3.0, np.float32)
    toxicity.edges.cache_clear()
    for word in ["st0p", "p0st", "t0ps", "s.t.o.p", "sttop"] * 50:
        toxicity.decode(word, cost)
    assert toxicity.edges.cache_info().misses <= 7  # s t 0 p . o, and t twice
    words = ["Straße", "ÀÉ", "don't", "x", "ΣΑΣ."]
    table = toxicity.count_letters(words, np.arange(1, 6))
    assert table.sum() == 1 * 7 + 2 * 3 + 4 * 2 + 5 * 4
