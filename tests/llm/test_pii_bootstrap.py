"""The bootstrapped contexts against a plain model, and the cost of one text with very many spans."""

import re
import time
from collections import Counter, defaultdict

import pytest
import regex

from lumenframe.llm import pii
from tests.llm import plans

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:_+(?=\p{L})[\p{L}\p{M}\p{N}]+)*(?:[\"']?[:=])?")
SIGN = regex.compile(r"[\p{L}\p{M}\p{N}]")
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "candidate": r"(?<![A-Za-z0-9._/-])[A-Za-z._/-]*[0-9][A-Za-z0-9._/-]*",
}


def tokens(text):
    """Words of a text: maximal runs, so none begins inside another."""
    return [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text) if not (m.start() and SIGN.match(text[m.start() - 1]))]


def word_before(text, words, previous, at, end):
    """The last whole word between the match before and this one, with no other letter or digit behind it."""
    own = [(a, b, w) for a, b, w in words if a >= previous and b <= at]
    if own and not SIGN.search(text[own[-1][1] : at]):
        a, b, w = own[-1]
        if a == previous and previous > 0:
            return ""
        return w
    return ""


def model(texts, rounds=3, min_confidence=0.5, min_seeds=5):
    """Context spans by the rules of the docstring, in plain loops."""
    spans = {}
    for i, text in texts.items():
        words, found = tokens(text), []
        known = set(pii.brute_base(text))
        base = [(a, b) for a, b, _ in known]
        for kind, rule in RULES.items():
            previous = 0
            for m in re.finditer(rule, text):
                a, b = m.span()
                word, previous = word_before(text, words, previous, a, b), b
                if kind == "candidate":
                    ok = sum(c in "0123456789" for c in m[0]) >= 4 and not any(x < b and y > a for x, y in base)
                else:
                    ok = (a, b, kind) in known
                if ok:
                    found.append((a, b, kind, m[0], word))
        spans[i] = found
    edges, seed = Counter(), set()
    for found in spans.values():
        for _, _, kind, value, word in found:
            if word:
                edges[word, value] += 1
                if kind != "candidate":
                    seed.add((word, value))
    values = Counter(w for w, _ in edges)
    edges = {(w, v): n for (w, v), n in edges.items() if values[w] >= min_seeds}
    seed = {v for w, v in seed if (w, v) in edges}
    total = Counter(w for text in texts.values() for _, _, w in tokens(text))
    score, accepted = {v: float(v in seed) for _, v in edges}, {}
    for _ in range(rounds):
        told, support = defaultdict(float), defaultdict(float)
        for (w, v), n in edges.items():
            told[w] += n * score[v]
            support[w] += score[v]
        accepted = {w: min(1.0, x / total[w]) for w, x in told.items() if support[w] >= min_seeds and min(1.0, x / total[w]) >= min_confidence}
        score = {v: float(v in seed) for v in score}
        for w, v in edges:
            score[v] = max(score[v], accepted.get(w, 0.0))
    return {i: sorted((a, b) for a, b, k, _, w in found if k == "candidate" and w in accepted) for i, found in spans.items()}


def check(spark, texts, **options):
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.extra] for r in pii.find_pii(d, **options).collect()}
    want = model(texts, **options)
    assert got == want
    return sum(map(len, want.values()))


def test_bootstrap_equals_the_model_on_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    made = ["id: {}", "id={}", 'see "id":"{}"', "ref {} and id:{}", "call_me: {}", "é_no={} x"]
    values = [f"10.0.{i}.7" for i in range(9)] + [f"u{i}@site.org" for i in range(9)] + [f"AB-{i}998877" for i in range(9)] + ["none", "x_1", "v2"]
    texts |= {100_000 + 100 * i + j: f.replace("{}", v) for i, f in enumerate(made) for j, v in enumerate(values)}
    assert check(spark, texts) > 0
    check(spark, texts, rounds=1, min_confidence=0.2, min_seeds=2)


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_scores_travel_over_the_graph(spark, rounds):
    rows = [f"mail: u{i}@a.org" for i in range(8)] + [f"id: {1000 + i}" for i in range(30)] + [f"id: u{i}@b.org" for i in range(9)]
    rows += [f"mail: {1000 + i}" for i in range(30)] + ["no: 5555 6666"]
    check(spark, dict(enumerate(rows)), rounds=rounds, min_confidence=0.3)


def second_generation():
    """Twelve addresses and twelve numbers behind ``contact:``, the same numbers and a new one behind ``badge:``, and that one and three more behind ``locker:``."""
    numbers = [f"AB-{4000 + i}" for i in range(12)]
    rows = [f"contact: p{i}@site.org" for i in range(12)] + [f"contact: {n}" for n in numbers]
    rows += [f"badge: {n}" for n in [*numbers, "ZZ-9001"]]
    rows += [f"locker: {n}" for n in ["ZZ-9001", *numbers[:3], "QQ-7001"]] + [f"page {1000 + i}" for i in range(40)]
    return dict(enumerate(rows))


@pytest.mark.parametrize(("rounds", "reached"), [(1, {"contact"}), (2, {"contact", "badge"}), (3, {"contact", "badge", "locker"})])
def test_discovered_identifiers_induce_patterns(spark, rounds, reached):
    texts = second_generation()
    options = {"rounds": rounds, "min_confidence": 0.3, "min_seeds": 2}
    check(spark, texts, **options)
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    behind = {texts[r.doc_id].split(":")[0] for r in pii.find_pii(d, **options).collect() if r.extra}
    assert behind == reached
    new = [i for i, t in texts.items() if t == "badge: ZZ-9001"][0]
    assert bool(pii.find_pii(d, **options).where(f"doc_id = {new}").first().extra) == (rounds > 1)


def test_texts_are_not_shuffled(spark, sf):
    """With broadcasts off, no exchange or sort carries a text: what a part decides comes to the rows where they lie."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        red = pii.redact(d)
        assert plans.moved(red) and not plans.moved(red) & {"_c1", "text", "__clean"}
        assert red.count() == d.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_spans_in_one_text_take_linear_time(spark):
    def took(n):
        text = " ".join(f"n{i % 7} {1000000 + i}" if i % 3 else f"mail: a{i}@b.org" for i in range(n))
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = pii.digest(pii.find_pii(d)).first()
        red = pii.redact(d).first().text
        assert r.n_email == red.count("<EMAIL>") == len(range(0, n, 3))
        return time.time() - began

    took(500)
    few, many = took(4_000), took(16_000)
    assert many < 6 * few, (few, many)


def test_redaction_in_bytes_and_code_points(spark):
    d = spark.createDataFrame([(1, "é😀 a@b.co 😀 +1 10.20.30.40.50.60 é", 9), (2, None, None), (3, "ü", 1)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(d).collect()}
    assert got == {1: ("é😀 <EMAIL> 😀 <PHONE> é", 22), 2: (None, None), 3: ("ü", 1)}
    assert pii.redact(d.limit(0)).count() == 0 and pii.find_pii(d.limit(0)).count() == 0


def test_words_are_cut_before_the_shuffle(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    support = spark.createDataFrame([("the", 5.0)], "word string, seeds double")
    plan = pii._totals(d, "text", support)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("Exchange") < plan.index("LeftSemi")
