"""Main text of pages, tokens of two tokenizers aligned, whitened vectors: against brute force and odd rows."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushframe.llm import op11, op12, op13
from hushframe.llm.alignment import align, byte_alphabet, group_labels
from hushframe.llm.maintext import extract, main_text
from hushframe.llm.whitening import principal_components, squares, whiten

FOLDER = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# 11

LONG = "A first sentence, with a comma, and then some more words that make it prose. " * 3

PAGES = {
    "": "",
    "<p>": "",
    "no markup at all": "no markup at all",
    "<div>a<p>b</div>c<b>d</b>e": "a b cde",
    "<a href=x>only a link</a>": "",
    "x < y and <!-- c --> z <script>if (a<b) '</p>'</script> q <": "x < y and z q <",
    "<table><tr><td>one<td>two<tr><td>three</table>": "one two three",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes</p>": "yes",
    "<p>a<span>b</span>c<br>d</p>  <p>e\n\t f&nbsp;&amp;&#x41;&eacute;&lt;b&gt;": "abc d e f &Aé<b>",
    "<p>open comment <!-- never closed <p>x": "open comment",
    "<p>cut within a tag <a href='x": "cut within a tag",
    "<ul><li>one, and more<li>two</ul>": "one, and more two",
    "<textarea>a</textarea><select><option>b</select><noscript>c</noscript><title>t</title><p>d": "d",
    f"<body class='has-sidebar'><div class=sidebar-left><div>{LONG}<br>Next line</div></div><div class=sidebar>Side</div>": " ".join(LONG.split()) + " Next line",
    "<nav>menu</nav><header>top</header><main><h1>T</h1><section><p>One, two.</section><section><p>b</section><aside>no</aside>"
    "<div id=comments><article class=comment><p>first, very, long, comment, of, a, reader</article></div></main><footer>f</footer>": "T One, two. b",
    f"<div><h2>Title</h2><div id=x><p>{LONG}</p><p>{LONG}</p><form>mail<input></form></div><div class='cookie-notice'>{LONG}</div>"
    f"<div>{LONG}</div><div>tiny</div><h3>Later</h3></div>": " ".join(f"Title {LONG} {LONG} {LONG}".split()),
    f"<article><p>{LONG}</p><ul><li><a href=1>aa</a><li><a href=2>bb</a><li><a href=3>cc</a></ul><div class=ad-box>buy</div><p>end</article>": " ".join(LONG.split()) + " end",
    f"<article><p>see <a href=1>this</a>, too</p><script>x</script><p>{LONG}</article><article class=related><p>{LONG}</article>": "see this, too " + " ".join(LONG.split()),
}


def test_main_text():
    assert dict(zip(PAGES, extract(list(PAGES)))) == PAGES
    assert [extract([p])[0] for p in PAGES] == list(PAGES.values())  # a batch changes nothing
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert extract([deep, "<" * 5_000, "<p>" + "word, " * 200_000]) == ["deep", "<" * 5_000, ("word, " * 200_000).strip()]


def test_main_text_of_the_pages(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r["page_id"]: r for r in op11.op11_main_text(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inside)).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_main_text_odd_rows(spark):
    rows = [(1, "u", "<p>a", "old", 9), (1, "u", "<p>a", "old", 9), (None, None, None, None, None), (2, None, "", "x", 1), (3, "u", "<p>🙂é", None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(2)
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in main_text(df).collect())
    assert got == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("3", "🙂é", 2), ("None", "", 0)]
    assert main_text(df.limit(0)).count() == 0


# 12


def token_bytes():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = byte_alphabet()

    def both(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        return (x, left), (y, right)

    return both


def aligned(rows):
    """Each text walked token by token."""
    both, count, found = token_bytes(), Counter(), []
    for i, text in rows:
        (x, left), (y, right) = both(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(left) != whole or b"".join(right) != whole:
            found.append((i, None, None))
            continue
        p = q = 0
        groups, links, end_a, end_b = [([x[0]], [y[0]])], [(x[0], y[0])], len(left[0]), len(right[0])
        while end_a < len(whole) or end_b < len(whole):
            fresh = end_a == end_b
            if fresh:
                groups.append(([], []))
            step_a, step_b = fresh or end_a < end_b, fresh or end_b < end_a
            if step_a:
                p, end_a = p + 1, end_a + len(left[p + 1])
                groups[-1][0].append(x[p])
            if step_b:
                q, end_b = q + 1, end_b + len(right[q + 1])
                groups[-1][1].append(y[q])
            links.append((x[p], y[q]))
        count.update(links)
        found.append((i, groups, links))
    high = Counter()
    for (_, b), n in count.items():
        high[b] = max(high[b], n)
    out = []
    for i, groups, links in found:
        if links is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sides = [sum(len(g[s]) for g in groups) for s in (0, 1)]
        best = sum(count[link] == high[link[1]] for link in links)
        out.append((i, *sides, len(groups), len(links), best, sum(count[link] for link in links), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(map(str, out))


def odd_texts():
    rng = random.Random(3)
    signs = list("aAbeéß  \t\n 　​中文한국어हिन्दी🙂.,'s12…“”\x00\x1f\x85▁")
    parts = [" ", "  ", " the", "'s", " 12", "<|endoftext|>", "<s>", "﻿", " ", "᠎"]
    rows = [(i, "".join(rng.choice(signs) if rng.random() < 0.7 else rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows = [(i, t if i % 7 == 0 else t.replace("▁", "")) for i, t in rows]
    return rows + [(None, "no id"), (1, None), (2, ""), (3, " "), (4, "  "), (5, "a "), (6, "▁"), (7, "x" * 3000), (7, "x" * 3000), (8, "tie tie " * 4000)]


def test_alignment_against_a_walk(spark):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", *(F.lit("x").alias(c) for c in ("pair", "at", "part", "block", "groups")))
    assert sorted(str(tuple(r)) if r["groups_sha256"] else str((*r[:8], "")) for r in align(df, BYTES, PIECES, spell=True).collect()) == aligned(rows)
    assert align(df.limit(0), BYTES, PIECES).count() == 0
    assert align(df.where("text = ''").limit(1), BYTES, PIECES).drop("groups").collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(str(tuple(r)) for r in op12.op12_alignment(spark, FOLDER).collect())
    assert got == sorted(re.sub(r", '[^']*'\)$", ")", x) for x in aligned(rows))


def test_pointers_reach_the_end_of_each_group():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.flatnonzero(rng.random(n) < p) + 1, n) for p in rng.random(2)]
        a, b = (np.unique(e) for e in ends)
        common = np.intersect1d(a, b)
        assert [x.tolist() for x in group_labels(a, b)] == [np.searchsorted(common, side).tolist() for side in (a, b)]


# 13


def test_components_against_a_library():
    rng = np.random.default_rng(0)
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    x = rng.standard_normal((500, 40)) @ rng.standard_normal((40, 40))
    clusters = np.repeat([5.0, 3.0, 1.0, 1e-9], 10)
    cases = [x.T @ x, np.eye(9), np.ones((6, 6)), turn @ np.diag(clusters) @ turn.T, np.kron(np.eye(2), turn @ np.diag(np.arange(40.0)) @ turn.T)]
    cases += [turn @ np.diag(1 + 1e-10 * np.arange(40)) @ turn.T, np.diag([1e-300, 2e-300]), np.array([[7.0]]), np.diag([1.0, 4.0, 2.0]) * 1e150]
    for case in cases:
        k = min(8, len(case))
        values, vectors = principal_components(case, k)
        want = np.linalg.eigvalsh(case)[::-1][:k]
        assert np.abs(values - want).max() <= 1e-13 * want[0]
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
        assert np.abs(case @ vectors.T - vectors.T * values).max() <= 1e-12 * want[0]


def test_deviation_is_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**6), 10**6, (20, 7))
    for n in (1, 50, 10**9, 10**12, 10**14):
        sums = np.array([int(m) * n + int(r) for m, r in zip(rng.integers(-(10**6), 10**6, 7), rng.integers(0, n, 7))], object)
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert squares(x, n, sums) == [w if w < 10**38 else None for w in want]


def test_whitening_against_a_library(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    white, at = z @ vectors / np.sqrt(values), {r["vec_id"]: i for i, r in enumerate(rows)}
    got = op13.op13_whitening(spark, FOLDER).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((v, c) for v in at for c in range(1, 9))
    signs = {r["component"]: np.sign(r["whitened"] * white[at[r["vec_id"]], r["component"] - 1]) for r in got if r["vec_id"] == rows[0]["vec_id"]}
    for r in got:
        i, c = at[r["vec_id"]], r["component"]
        assert r["n"] == n and r["deviation"] == int(((n * x[i] - sums) ** 2).sum())
        assert abs(r["whitened"] - signs[c] * white[i, c - 1]) < 1e-9 and abs(r["explained"] / (values[c - 1] / np.trace(cov)) - 1) < 1e-9
        assert r["identity_error"] < 1e-9


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, float("inf")]), (2, None), (3, [None, 1.0]), (4, []), (5, [1.0]), (None, [2.0, 9.0]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).select("*", F.lit(1).alias("n"), F.lit("x").alias("component"))
    got = sorted((str(r["vec_id"]), r["component"], r["n"], round(abs(r["whitened"]), 6), round(r["explained"], 6)) for r in whiten(df).collect())
    assert got == [("1", 1, 3, 0.707107, 1.0), ("1", 1, 3, 0.707107, 1.0), ("None", 1, 3, 1.414214, 1.0)]
    # equal vectors have no variance, nothing remains, nothing is there
    for part in (df.where("vec_id = 1"), df.where("vec_id in (2, 4)"), df.limit(0)):
        assert whiten(part).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["deviation"] is None for r in whiten(huge).where("component = 1").orderBy("vec_id").collect()] == [True, True, False]


@pytest.mark.parametrize("run", [op11.op11_main_text, op12.op12_alignment, op13.op13_whitening])
def test_columns(spark, run):
    want = {
        "op11_main_text": "page_id bigint, url string, text string, n_chars bigint",
        "op12_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        "op13_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    }
    assert ", ".join(f"{n} {t}" for n, t in run(spark, FOLDER).dtypes) == want[run.__name__]


# 8


def test_long_runs_are_decoded_in_linear_time():
    from hushframe.llm import toxicity

    cost = np.random.default_rng(0).random(toxicity.BASE**4).astype(np.float32)
    assert toxicity.decode("a" * 200_000 + "b", cost) in ("ab", "aab")
    assert toxicity.run_lengths("aabccc") == [2, 1, 1, 3, 2, 1] and toxicity.run_lengths("") == []


def test_readings_do_not_depend_on_what_a_worker_knows():
    from hushframe.llm import toxicity

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aAsStuiIdD$@!0145.-é☃\0") for _ in range(rng.choice([1, 1, 1, 2, 4, 9]))) for _ in range(rng.randrange(30))).encode() for _ in range(300)]
    cost = np.random.default_rng(0).random(toxicity.BASE**4).astype(np.float32)
    known: dict = {}

    def words(part, kept):
        names, ids, sizes = toxicity.restored(part, cost, kept)
        return [sorted(names[i] for i in x) for x in np.split(ids, np.cumsum(sizes)[:-1])]

    whole = words(texts, known)
    assert whole == words(texts, known) == [w for t in texts for w in words([t], {})]


# 2


def test_one_row_of_each_component_stays(spark):
    from hushframe.llm.neardup import representatives

    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:30], f"changed{k}", *base[31:]])
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, near(1)), (None, near(2)), (None, near(3)), (2, other), (2, other + " tail"), (2, other + " tail"), (5, "x y z"), (5, "a b c"), (7, ""), (7, None), (8, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("root", F.lit("x"))
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in representatives(df).collect())
    assert [g for g in got if g[0] not in ("None", "2")] == [("5", "a b c"), ("5", "x y z"), ("7", ""), ("7", "None")]
    assert sum(g[0] == "None" for g in got) == 1 and sum(g[0] == "2" for g in got) == 1


def test_stretches_are_encoded_in_lines():
    import pyarrow as pa

    from hushframe.llm.alignment import Stretches

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        known = Stretches(file.read(), model.read())
    tokenizer, lines = known.a, []

    class Counted:
        def encode_batch_fast(self, strings, **options):
            lines.extend(strings)
            return tokenizer.encode_batch_fast(strings, **options)

    known.a = Counted()
    words = [f"w{i}x.é" for i in range(2000)] + ["日本", "a\u3000", "\tz", "don't", "😀"]
    texts = [" ".join(words), " a  b ", "x\n y", "▁", ""]
    numbers, counts = known.split(pa.array([x.encode() for x in texts], pa.large_binary()))
    assert counts[0] > 2000 and len(lines) < 100
    at = 0
    for text, n in zip(texts, counts.tolist()):
        want = tokenizer.encode(" " + text, add_special_tokens=False).ids if text and text != "▁" else []
        spelled = [g.split("|")[0] for s in numbers[at : at + n] for g in known.spelled[s].split(";") if g]
        assert [int(i) for g in spelled for i in g.split(",")] == want
        at += n
