"""The operators against plain models, round trips and held-out accuracy."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import plans
from lumenframe.llm import components, cover_tree, decontaminate, packing, pii, quality, queries, secrets, simhash, token_counts, url_filter, warc

LONG = "lorem ipsum dolor " * 20_000
AWKWARD = [None, "", " ", "one", "two words", "A b C d", "é😀 ünï", "\x00\x01", "tab\tline\nfeed\x0b\x0c\r", LONG, "x" * 100_000, "7" * 5_000]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Every awkward text, ids null and repeated, and columns whose names clash with those of results."""
    rows = [(i, t, "x", i) for i, t in enumerate(AWKWARD)] + [(0, None, "x", 0), (1, "", "x", 1), (None, "one", "x", 2), (None, None, "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, start long").withColumns({c: F.lit(1) for c in ("n_words", "kind", "rank", "base", "length", "label_id", "node", "root", "keep", "n", "word", "value")})


@pytest.fixture(scope="module")
def bench(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


# --- 1 token counts


def test_trie_counts_equal_viterbi(docs):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    scores = token_counts.load_scores(path)
    got = token_counts.token_counts(docs.limit(40), path).collect()
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    assert all((r.n_pretokens, r.n_tokens) == token_counts.brute_count(texts[r.doc_id], scores) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é1 .\n", max_size=30), max_size=6), st.integers(1, 40))
def test_trie_shares_prefixes_and_survives_clearing(texts, nodes):
    scores = {bytes([b]): -5.0 for b in range(256)} | {b"ab": -6.0, b"abc": -6.5, b" a": -4.0, "é".encode(): -3.0}
    counter = token_counts.Counter(scores)
    counter.trie.max_nodes = nodes
    for t in texts:
        assert counter.count(t) == token_counts.brute_count(t, scores)


def test_token_counts_awkward(awkward):
    got = token_counts.token_counts(awkward, queries.vocabulary("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == awkward.count()
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (0, 1) or (r.doc_id is None and r.n_pretokens == 0))


# --- 2 personal data


def _spans(text):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in pii.brute_base(text))


TRICKY = [
    "a@b.c d@e..f x.y@a-b.c.d. 1.2.3.4.5.6.7.8 +1 (2) 345-6789.0 -", "_a@b.com_x@y.com@z.com", "4111 1111 1111 1111 4111-1111-1111-1111", "1234.1.1.1 256.1.1.1 001.02.3.4",
    "+++1 23456789 +12345678()", "é😀 a@b.co 😀 4111111111111111", "1.1.1.1 " * 500, "a@b." + "c." * 5_000, "+1" * 3_000, "4 1-1" * 500,
]


def test_base_spans_equal_the_plain_rules(spark, docs):
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("0123456789+-.() @ab%_x"), 80)) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate([*TRICKY, *noise, *AWKWARD])), "doc_id long, text string")
    made = made.unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in made.collect()}
    for r in pii.digest(pii.find_pii(made)).collect():
        assert r.base_sha256 == hashlib.sha256(_spans(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]


def test_contexts_learn_from_seeds_and_find_new_identifiers(spark):
    rows = [(i, f"my ssn-like contact: user{i}@site.org and then some words") for i in range(12)]
    rows += [(100, "please use contact: AB-99887766 from now on"), (101, "the year 20240101 is plain text and the 55667788 too")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(d).collect()}
    assert [(s.kind, s.value) for s in found[100].extra] == [("context", "AB-99887766")]
    assert not found[101].extra and [s.kind for s in found[3].base] == ["email"]


@pytest.mark.parametrize("form", ["id:{}", "id={}", '{{"name":"n{{0}}","id":"{}"}}', "a=1,id={};b=2", 'id="{}"', "x" * 60 + "={}", "ID\t(  {} )"])
def test_contexts_joined_to_their_value(spark, form):
    rows = [(i, "log " + form.format(f"10.20.30.{i}") + " end") for i in range(12)]
    rows += [(100, "log " + form.format("4455667788") + " end"), (101, "plain 20240101 and 55667788 too")]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.value) for s in found[100].extra] == [("context", "4455667788")] and not found[101].extra


def test_totals_count_glued_occurrences(spark):
    rows = [(i, f"id:user{i}@site.org and then") for i in range(12)] + [(50 + i, "see id:none or id:null") for i in range(12)] + [(100, "id:4455667788")]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not found[100].extra  # 12 of 25 occurrences lead to a known identifier


@pytest.mark.parametrize("seed", ["10.20.30.{}", "card"])
def test_a_seed_counts_once(spark, seed):
    cards = ["4111111111111111", "5555555555554444", "378282246310005", "6011111111111117", "3530111333300000", "4012888888881881", "4222222222222", "5105105105105100", "371449635398431", "30569309025904", "38520000023237", "6011000990139424"]
    known = [cards[i] if seed == "card" else seed.format(i) for i in range(12)]
    rows = [(i, f"id: {x} and then") for i, x in enumerate(known)] + [(50 + i, "see id: none") for i in range(20)] + [(100, "id: 44556677")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(d).collect()}
    assert not found[100].extra  # 12 of 33 occurrences lead to a known identifier
    assert sum(len(r.base) for r in found.values()) == 12


def test_words_of_patterns_are_words_of_totals(spark, docs):
    made = spark.createDataFrame(list(enumerate(AWKWARD + TRICKY + ["a_1.2.3.4", "v1.2.3.4 é_x@y.com", "_id_=12345678", "x_AB-12345678", "a_" * 50_000 + "=1234567"], 10_000)), "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(made)
    found = d.select(F.explode(pii._base(pii._text("text"))).alias("s")).select(F.col("s.word").alias("w")).where("w <> ''").groupBy("w").count()
    total = d.select(F.explode(F.regexp_extract_all("text", F.lit(pii.WORD), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    assert found.count() and found.join(total, "w", "left_anti").count() == 0


def test_redaction_keeps_columns_and_merges_overlaps(spark, awkward):
    d = spark.createDataFrame([(1, "mail a@b.co, +1 10.20.30.40.50.60 now", 9)], "doc_id long, text string, n_chars long")
    r = pii.redact(d).first()
    assert r.text == "mail <EMAIL>, <PHONE> now"
    assert r.n_chars == len(r.text)
    kept = pii.redact(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


# --- 3 quality


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = quality.training_rows(d, lab, "doc_id", "text", 4000)
    rng = np.random.default_rng(0)
    order = rng.permutation(len(rows))
    fit, held = ([rows[i] for i in order[:2500]], [rows[i] for i in order[2500:]])
    model = quality.fit(fit)
    z = np.array([model.weights[b].sum() + model.dense_weights @ x for b, x, _ in held])
    p, g = model.probabilities(z), np.array([g for _, _, g in held])
    keep = p[:, 2] >= 0.5
    assert keep[g == 2].mean() > 0.96 and keep[g == 0].mean() < 0.04 and keep[g == 1].mean() < 0.06
    assert (model.weights > 0).sum() > 50 and (model.weights < 0).sum() > 50
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and model.thresholds[0] < model.thresholds[1]


def test_quality_of_awkward_rows_and_one_grade(spark, awkward, labels):
    s = quality.score(awkward, labels).collect()
    assert len(s) == awkward.count() and all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in s)
    only = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.score(awkward, only).collect())
    assert quality.select(awkward, labels).columns == awkward.columns
    assert quality.score(awkward.limit(0), labels).count() == 0


# --- 4 decontamination


def _model(found):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(found).collect()}


@pytest.mark.parametrize("block", [1 << 28, (20 << 20) + 200_000])
def test_wu_manber_equals_brute_force(spark, docs, bench, block):
    d = docs.limit(60).select("doc_id", "text")
    extra = spark.createDataFrame([(1001, None), (1002, bench.first().text.upper()), (1003, "short item"), (1004, "a b c d e f g h i j")], "doc_id long, text string")
    items = bench.limit(15).unionByName(spark.createDataFrame([(900, "short item"), (901, None), (902, "!!"), (903, "b"), (None, "a b c")], "item_id long, text string"))
    d = d.unionByName(extra)
    want = decontaminate.brute([tuple(r) for r in d.collect()], [tuple(r) for r in items.collect()])
    assert _model(decontaminate.decontaminate(d, items, table_bytes=block)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=25), max_size=5), st.text(alphabet="ab ", max_size=80), st.integers(1, 4))
def test_wu_manber_on_tiny_alphabets(items, text, window):
    rows = list(enumerate(items))
    w = decontaminate.words(text)
    spans, got = decontaminate.Searcher(rows, window).find(w)
    want = decontaminate.brute([(0, text)], rows, window)[0]
    assert (sum(b - a for a, b in spans), len(got)) == want[1:3]


def test_drop_contaminated(spark, awkward, bench):
    kept = decontaminate.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert decontaminate.drop_contaminated(awkward, bench.limit(0)).count() == awkward.count()


# --- 5 near-duplicates


def _brute_components(rows):
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    label = {k: i for k, (i, _) in enumerate(fps)}
    while True:
        new = {a: min(label[b] for b, (_, y) in enumerate(fps) if (x ^ y).bit_count() <= 3) for a, (_, x) in enumerate(fps)}
        if new == label:
            return sorted((fps[k][0], f"{fps[k][1]:016x}", label[k]) for k in label)
        label = new


@pytest.mark.parametrize("tile", [2048, 3])
def test_components_equal_brute_force(spark, docs, tile):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(5000, None), (5001, ""), (5002, "a"), (5003, "A"), (5004, "a b"), (7, "a b")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simhash.digest(simhash.near_duplicates(d, tile=tile)).collect())
    assert got == _brute_components(rows)


def test_links_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 600:
        x = centre
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(1 << 62, size=400)}
    signed = sorted(simhash._signed(x) for x in fps)
    d = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(7)
    got = {r.node: r.root for r in components.connected_components(simhash.links(d, tile=100)).collect()}
    u = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = np.arange(len(u))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert all(got.get(x, x) == signed[label[k]] for k, x in enumerate(signed))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=40), st.integers(0, (1 << 64) - 1))
def test_bit_planes(fps, probe):
    fps = fps + [probe ^ 1, probe ^ 0b111, probe ^ 0b1111, probe ^ (2**64 - 1)]
    found = simhash.BitPlanes(np.array(fps, np.uint64)).near(probe)
    assert [i for i in range(len(fps)) if found >> i & 1] == [i for i, x in enumerate(fps) if (x ^ probe).bit_count() <= 3]


def test_hash_is_that_of_the_engine(spark):
    import xxhash

    r = spark.sql("select xxhash64('a b c') as h").first()
    assert simhash._signed(xxhash.xxh64_intdigest(b"a b c", 42)) == r.h


def test_keep_one(awkward):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    want = {c for _, _, c in _brute_components([(i, t) for i, t in enumerate(AWKWARD)])}
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


# --- 6 secrets


def test_secret_base_spans_equal_the_plain_rules(docs):
    texts = [r.text for r in docs.collect()] + AWKWARD + [
        'password = "abc", passwd:secret1 token="aaaaaa" Api_Key: "x" APIKEY="abcdef123"', "AKIA" * 10, "AKIAabc AKIA" + "Z" * 16, "a" * 24 + "g" + "0" * 23, "token = token = abcdefg",
    ]
    for t in texts:
        assert secrets.scan(t)[0] == secrets.brute_base(t)


def test_weak_parts_are_reported_only_together():
    secret = "Ab3dEf6hIj9lMn2pQr5t"
    assert secrets.scan(f"noise {secret} noise")[1] == []
    assert secrets.scan(f"user = bob1 {secret}")[1] == []
    whole = f"host = db.example.com user = bob1 value {secret} end"
    assert [k for _, _, k in secrets.scan(whole)[1]] == ["endpoint", "identifier", "weak_secret"]
    apart = f"host = db.example.com user = bob1 {'far ' * 200} {secret}"
    assert secrets.scan(apart)[1] == []


@pytest.mark.parametrize("secret", ["Ab3dEf6hIj9lMn2pQr5t", "ab3def6hij9lmn2pqr5t", "AB3DEF6HIJ9LMN2PQR5T", "AbcdEfghIjklMnopQrst", "Ab3d" * 40, "zb3d" * 5_000, "Ab3dEf6hIj9lMn2pQr5t=="])
@pytest.mark.parametrize("before", ["", "sig=", "AUTH=", "https://db.example.com/get?sig="])
def test_weak_secrets_of_every_class(secret, before):
    text = f"host = db.example.com user = bob1 {before}{secret} end"
    assert (text.index(secret), text.index(secret) + len(secret), "weak_secret") in secrets.scan(text)[1]


def test_base_secrets_take_part_in_the_join():
    kinds = lambda text: [(k, text[a:b]) for a, b, k in secrets.scan(text)[1]]
    token = f'token = "{"0123456789abcdef" * 2}89abcdef"'
    both = [("identifier", "client_id = app-17"), ("endpoint", "https://api.example.com")]
    assert kinds(f"client_id = app-17, {token} https://api.example.com/v1") == both
    assert kinds(f"client_id = app-17, {'0123456789abcdef' * 2} https://api.example.com/v1") == both
    assert kinds(f"client_id = app-17, {'far ' * 80} {token} {'far ' * 80} https://api.example.com/v1") == []
    assert kinds(f"user = bob1 {token}") == [("identifier", "user = bob1")]
    # parts that overlap a base span complement others; an access key may be long
    weak = "Ab3dEf6hIj9lMn2pQr5t"
    assert ("weak_secret", weak) in kinds(f"account = {'0123456789abcdef' * 2} https://api.example.com {weak}")
    assert ("weak_secret", weak) in kinds(f"AKIA{'Z' * 900} https://api.example.com {weak}")


def test_plain_runs_are_no_secrets():
    for run in ("counterrevolutionaries", "COUNTERREVOLUTIONARIES", "state-of-the-art-approach", "2024-01-15/2024-02-16", "short1Ab=", "_" * 30):
        assert secrets.scan(f"host = db.example.com user = bob1 {run} end")[1] == []


def test_secrets_awkward(awkward):
    r = secrets.digest(secrets.find_secrets(awkward))
    assert r.count() == awkward.count() and r.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").count()


# --- 7 archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/\r\nX: y", "x" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "ü", "é" * 100 + "\r\n\r\nWARC/1.1\r\n"), (None, "u", "x" * 200), (None, "n", "z" * 150), (None, "n", "z" * 150), (1, "again", "x" * 200)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    listed = warc.write_archives(p, f"file://{tmp_path}/w", archive_bytes=500)
    got = warc.read_archives(listed).collect()
    assert len(got) == len(rows) and listed.count() > 1
    by = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert by == sorted([(1, "response", None, 200), (1, "response", None, 200), (2, "revisit", 1, 200), (None, "revisit", 1, 200), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5), (7, "response", None, 214), (None, "response", None, 150), (None, "response", None, 150)], key=str)
    texts = {r.page_id: r.payload.decode() for r in got if r.record_type == "response" and r.page_id}
    assert texts[7] == rows[6][2] and texts[1] == rows[0][2]
    with open(listed.first().path.removeprefix("file://"), "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.SKIPPABLE
    assert warc.round_trip(p.limit(0)).count() == 0


def test_payloads_are_not_shuffled(spark):
    """A digest that a third of all pages share, broadcasts off: no exchange or sort holds payloads."""
    p = spark.range(3000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("same " * 60)).otherwise(F.concat(F.lit("page " * 30), F.col("id").cast("string"))).alias("html"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decided = warc.decide(p, "page_id", "url", "html", 100)
        assert plans.moved(decided) and not plans.moved(decided) & {"html", "url"}
        kinds = {r.record_type: r["count"] for r in decided.groupBy("record_type").count().collect()}
        assert kinds == {"response": 2001, "revisit": 999}
        assert decided.where("record_type = 'revisit' and refers_to = 0").count() == 999
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- 8 URLs


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "http://a.com/x", "http://EXAMPLE.com/en/1?q", "http://www.example.com/en/2", "http://x.www.example.com/en/2", "http://example.com/en", "http://notexample.com/en/", "http://b.net/es/", "http://net/fr/#x", "http://net/de/", "a://b://c.net/es/x", "http://.com/", "http://com./", "http://user@a.com:80/", "http://" + "a." * 5_000 + "net/es/" + "x/" * 5_000, "http://a.net/es/\nmore"]
    p = spark.createDataFrame(list(enumerate(urls)) + [(1, "http://a.com/x")], "page_id long, url string").withColumn("rule", F.lit("clash"))

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + q), len(h), h + q, v) for h, q, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    got = {(r.page_id, r.host): (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(p).collect()}
    for i, u in enumerate(urls):
        assert got[i, judge(u)[0]] == judge(u), u
    odd = (("a.com", "/x", "block"), ("com", "", "block"), ("a.com", "/xy/z", "allow"))
    q = spark.createDataFrame([(1, "http://a.com/xy"), (2, "http://a.com/xy/z1"), (3, "http://b.com")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_filter.judge_urls(q, odd).collect()} == {1: "a.com/x", 2: "a.com/xy/z", 3: "com"}


# --- 9 exact search


@pytest.mark.parametrize("seed", range(4))
def test_dual_tree_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, 8))
    c = (centres[rng.integers(6, size=700)] + rng.integers(-3, 4, (700, 8))).astype(float)
    c[100:160] = c[99]
    q, ids = c[::20], np.arange(700)
    got = cover_tree.search(q, ids[::20], c, ids, 5)
    s = q @ c.T
    for row in range(len(q)):
        order = sorted((-(s[row, j]), j) for j in range(700) if j != 20 * row)[:5]
        assert [(b, v) for a, b, v in got if a == row] == [(j, int(-v)) for v, j in order]


def test_scores_beyond_doubles_are_exact():
    a, b = 2.0**40 + 1, 2.0**40 + 3
    assert cover_tree.search(np.array([[a, 3.0]]), np.array([0]), np.array([[b, 5.0]]), np.array([1]), 1) == [(0, 0, (2**40 + 1) * (2**40 + 3) + 15)]
    rng = np.random.default_rng(3)
    c = 2.0**30 * rng.choice([-1, 1], (600, 4)) + rng.integers(-2, 3, (600, 4))
    q, ids = c[:9], np.arange(600)
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in c] for u in q]
    got = cover_tree.search(q, ids[:9], c, ids, 5)
    for row in range(9):
        order = sorted((-exact[row][j], j) for j in range(600) if j != row)[:5]
        assert [(j, v) for a, j, v in got if a == row] == [(j, -v) for v, j in order]


def test_dual_tree_prunes_clustered_data():
    rng = np.random.default_rng(1)
    c = (np.eye(8)[rng.integers(8, size=4000)] * 1000 + rng.integers(-2, 3, (4000, 8))).astype(float)
    tree = cover_tree.build(c)
    stack, leaves = [tree], 0
    while stack:
        n = stack.pop()
        assert (np.sqrt(((c[n.points] - n.centre) ** 2).sum(axis=1)) <= n.radius + 1e-9).all()
        leaves += not n.children
        stack += n.children
    assert leaves >= 8


def test_topk_query_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 0.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in cover_tree.exact_topk(t, F.col("vec_id") % 50 == 0, cand_block=3, query_block=1).collect())
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 2, 32768), (0, 4, 50, 32768), (50, 1, 1, 65536), (50, 2, 2, 65536), (50, 3, 2, 65536), (50, 4, 0, 32768)]
    assert cover_tree.exact_topk(t.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- 10 packing


def _check_packing(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids = {k: np.array([*tok.encode(v or "", add_special_tokens=False).ids, 0], "<u4") for k, v in docs}
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {k: len(v) for k, v in ids.items()}
    total = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert max(total.values()) <= 1024
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in total.values()) / sum(total.values())


def test_packing_covers_every_id_once(spark, docs):
    odd = ["  a  b \n c\n\n d \t e", "x<|endoftext|>y z", "a \n\n  b", "\n b", " lead", "trail ", "a\u00a0 b", "a \u2003b", "a\x1c b"]
    texts = [t for t in AWKWARD if t is None or len(t) < 200_000]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate([*odd, *texts], 10_000)), "doc_id long, text string"))
    rows = packing.pack(d, queries.vocabulary("byte_bpe_50k.json")).collect()
    assert _check_packing(rows, [tuple(r) for r in d.collect()]) < 0.02
    assert packing.pack(d.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=20), st.sampled_from([0.0, 0.01, 0.2, 1.0]))
def test_plan_places_every_rank_once(counts, gap):
    plan = packing.Plan(counts, 64, gap)
    used = {}
    for n, c in counts.items():
        for rank in range(c):
            parts = plan.place(n, rank)
            assert sum(p[1] for p in parts) == n
            for _, length, seq, offset in parts:
                for k in range(offset, offset + length):
                    assert used.setdefault((seq, k), 1) and (seq, k) in used
                    used[seq, k] += 1
    assert all(v == 2 for v in used.values())
    fill = {}
    for seq, k in used:
        fill[seq] = max(fill.get(seq, 0), k + 1)
    assert sum(fill.values()) == len(used)  # gapless from 0
    if gap == 0.0:  # everything else is cut into powers of two: at most one sequence has a gap
        assert sum(1 for n in fill.values() if n & (n - 1)) <= 1


def test_cached_chunks_equal_whole_texts(docs):
    tok = packing.ByteTokenizer(queries.vocabulary("byte_bpe_50k.json"))
    for r in docs.limit(80).collect():
        assert tok.encode(r.text) == tok.plain(r.text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1.\n\t'sé\u00a0\u2003\x1c", max_size=40))
def test_cutting_at_spaces_never_parts_pretokens(text):
    tok = test_cutting_at_spaces_never_parts_pretokens.__dict__.setdefault("tok", packing.ByteTokenizer(queries.vocabulary("byte_bpe_50k.json")))
    assert tok.encode(text) == tok.plain(text)


# --- oracles


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
