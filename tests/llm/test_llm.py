"""Small fixtures against brute force, and the odd rows: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from streetspark.llm import fingerprints, line_dedup, links, mixing, ngram_jaccard, pii, quality_rules, sentencepieces, toxicity, url_filters, warc

SPACE = "[\\x20\\x09-\\x0D]+"
LONG = "long words here and there " * 3000
BASE = "the quick brown fox jumps over the lazy dog while seven grey geese fly south across a cold and very quiet lake at dawn"
NEAR = BASE.replace("lazy", "sleepy")
DOCS = [
    (1, BASE, "en", "src1", 5),
    (2, BASE, "en", "src1", 5),
    (3, NEAR, "en", "src2", 5),
    (4, None, None, None, None),
    (5, "", "en", "src1", 0),
    (6, "two words", "de", "src9", 9),
    (7, LONG, "en", "src17", len(LONG)),
    (7, LONG, "en", "src17", len(LONG)),
    (8, "Mail me: a.b@c.example.org or +1 (212) 555-0101, host 10.0.0.1 card 4111 1111 1111 1111!\x01\x02", "fr", "src0", 9),
    (9, "A line that is long enough to be classed, number one here.\nshort\nA line that is long enough to be classed, number ane here.", "es", "other", 9),
    (None, "a null id with a few words of text in it for everyone", "en", "src1", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names that operators use
    return spark.createDataFrame(DOCS, SCHEMA).withColumn("n", F.lit(1)).withColumn("id", F.lit("x")).withColumn("kept", F.lit("k")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\\x20\\x09-\\x0D]+", t or "")


def repeats(w):
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(g)
    return len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(5)})


def test_quality_figures(docs, none):
    rows = quality_rules.score(docs, ["doc_id"]).collect()
    assert len(rows) == len(DOCS)
    by = {r["row"]["doc_id"]: r for r in rows}
    for i, t, *_ in DOCS:
        w, t, r = words(t), t or "", by[i]
        lines = [x for x in t.split("\n") if words(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeats(w)
        assert r["base_failed"] == (len(w) < 10 or 100 * repeats(w) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.score(none, ["doc_id"]).count() == 0


def test_quality_rejects_what_stands_out(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "s", 1) for i in range(80)]
    bad = [(100, " ".join(f"b{j}#$%" for j in range(40)), "en", "s", 1)]
    kept = {r["doc_id"] for r in quality_rules.keep_good(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert kept == set(range(80))


def test_within_is_edit_distance(spark):
    import random

    random.seed(3)
    rows = [("", ""), ("", "ab"), ("abc", ""), ("abcdef", "bcdefg"), ("héllo😀", "hllo😀x")]
    for _ in range(400):
        s = [random.choice("ab ") for _ in range(random.randint(0, 60))]
        t = list(s)
        for _ in range(random.randint(0, 4)):
            k, i = random.randint(0, 2), random.randint(0, len(t))
            t[i : i + (k > 0)] = random.choice("ab ") if k < 2 else ""
        rows.append(("".join(s), "".join(t)))
    df = spark.createDataFrame(rows, "a string, b string")
    tau = line_dedup.TAU
    side = lambda c: F.struct(F.length(c).alias("n"), F.size(line_dedup.words_of(F.col(c))).alias("m"), line_dedup.word_parities(line_dedup.word_codes(line_dedup.words_of(F.col(c)))).alias("p"))
    flat = lambda c: F.struct(F.col(f"{c}.n").alias("n"), F.col(f"{c}.m").alias("m"), F.col(f"{c}.p.p0").alias("p0"), F.col(f"{c}.p.p1").alias("p1")).alias(c)
    keys = F.arrays_overlap(line_dedup.index_rows(F.col("a"), F.length("a")), line_dedup.probe_rows(F.col("b"), F.length("b")))
    df = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b")).alias("w"), (F.levenshtein("a", "b") <= tau).alias("e"), side("a").alias("i"), side("b").alias("j"), keys.alias("k"))
    df = df.select("a", "b", "w", "e", "k", flat("i"), flat("j")).withColumn("may", line_dedup.may_link("i", "j"))
    for r in df.collect():
        assert r["w"] == r["e"]
        if r["e"] and len(r["a"]) > 6 and len(r["b"]) > 6:
            assert r["may"]
            if len(r["b"]) >= len(r["a"]):
                assert r["k"]


def test_line_dedup(spark, docs, none):
    gone = {(r["doc_id"], r["pos"]) for r in line_dedup.removed_lines(docs).collect()}
    assert (2, 0) in gone and (9, 2) in gone and (9, 0) not in gone and (1, 0) not in gone
    left = line_dedup.dedup(docs)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert 2 not in texts and texts[9].endswith("\nshort") and texts[4] is None and texts[5] == ""
    assert line_dedup.dedup(none).count() == 0
    chain = [(i, "a chain of lines that each differ by a little " + "x" * i, "en", "s", 1) for i in range(9)]
    assert {r["doc_id"] for r in line_dedup.dedup(spark.createDataFrame(chain, SCHEMA)).collect()} == {0}


def jaccard(docs):
    def grams(t):
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [(i, grams(t)) for i, t, *_ in docs]
    part = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i][1] and s[j][1] and 100 * len(s[i][1] & s[j][1]) >= 75 * len(s[i][1] | s[j][1]):
                part = [part[j] if p == part[i] else p for p in part]
    out = []
    for k, (i, g) in enumerate(s):
        ids = [s[m][0] for m in range(len(s)) if part[m] == part[k] and s[m][0] is not None]
        out.append((i, len(g), min(ids, default=None)))
    return sorted(out, key=str)


def test_jaccard_groups(spark, docs, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.groups(docs).collect()), key=str)
    assert got == jaccard(DOCS)
    import random

    random.seed(5)
    vocabulary, rows = [f"v{i}" for i in range(400)], []
    for i in range(40):
        w = [random.choice(vocabulary) for _ in range(random.choice((3, 5, 8, 30, 90, 200)))]
        for _ in range(4):
            v = list(w)
            for _ in range(random.randint(0, 4)):
                v[random.randrange(len(v))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(v), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.groups(df).collect()), key=str)
    assert got == jaccard(rows)
    assert ngram_jaccard.groups(none).count() == 0


def test_one_of_each(spark, docs):
    big = 2**53 + 1
    more = [(big, "x y z", "en", "s", 1), (None, "x y z", "en", "s", 1), (None, BASE, "en", "s", 1), (None, "q r s t u v", "en", "s", 1), (None, "q r s t u v", "en", "s", 1)]
    out = ngram_jaccard.one_of_each(docs.drop("n", "id", "kept").union(spark.createDataFrame(more, SCHEMA)))
    assert out.columns == docs.columns[:5]
    got = sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str)
    wanted = [(1, BASE), (3, NEAR), (4, None), (5, ""), (6, "two words"), (7, LONG), DOCS[8][:2], DOCS[9][:2], DOCS[10][:2], (big, "x y z"), (None, "q r s t u v")]
    assert got == sorted(wanted, key=str)


def test_jaccard_schemes_are_each_complete(spark, monkeypatch):
    """No set is left alone outside a largest component, so all that stay apart go through every scheme; small chunks make followers."""
    import random

    monkeypatch.setattr(ngram_jaccard, "APART", 0)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 300)
    random.seed(11)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = [f"u{random.randrange(10**6)}" for _ in range(random.choice((0, 6, 14, 19, 25, 60)))] + common
        for _ in range(2):
            v = list(w)
            v[random.randrange(len(v))] = "new"
            rows.append((len(rows), " ".join(v), "en", "s", 1))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == jaccard(rows)


def test_signatures_of_sets_within_the_bound_meet():
    import random

    import numpy as np

    random.seed(2)
    rng = np.random.default_rng(2)
    for scheme in range(len(ngram_jaccard.SCHEMES)):
        for _ in range(150):
            x = random.randint(3, 200)
            both = rng.integers(0, 2**63, x, dtype=np.uint64)
            cut, add = 0, 0
            while True:  # as many differences as a link allows
                c, a = (cut + 1, add) if random.random() < 0.5 else (cut, add + 1)
                if 100 * (x - c) < 75 * (x + a) or x - c < 3:
                    break
                cut, add = c, a
            f, g = both, np.concatenate([both[cut:], rng.integers(0, 2**63, add, dtype=np.uint64)])
            hot = None
            if random.random() < 0.5:
                hot = np.zeros(ngram_jaccard.HOT_BITS // 64, np.int64)
                for p in ngram_jaccard.hot_places(rng.choice(np.union1d(f, g), random.randint(0, x // 2), replace=False)).tolist():
                    hot[p >> 6] |= np.uint64(1 << (p & 63)).astype(np.int64)
            sig, of = ngram_jaccard.signatures([f, g], scheme, hot)
            assert set(sig[of == 0]) & set(sig[of == 1]), (scheme, x, cut, add)


def test_components_of_a_path(spark):
    rows = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (101, 102)]
    got = {r["id"]: r["component"] for r in links.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in (100, 101, 102)}


def test_mixing_shares_shortages_with_siblings_first(spark, docs, none):
    rows = [(i, "w " * n, "en", s, 1) for i, (n, s) in enumerate([(10, "src1")] * 4 + [(10, "src2")] * 40 + [(10, "src8")] * 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, (1, 2), 1)
    budget = {r["source"]: (r["leaf_tokens"], r["leaf_budget"]) for r in got.collect()}
    # of 420 tokens web has 5 of 7 parts; src1 has 40 only, so src2 takes its rest
    assert budget == {"src1": (40, 40), "src2": (400, 260), "src8": (400, 120)}
    taken = got.groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    assert all(budget[r["source"]][1] - 10 < r["t"] <= budget[r["source"]][1] for r in taken)
    assert mixing.mixed_docs(docs, (9, 10)).columns == docs.columns
    assert mixing.mix(none, (1, 2), 2).count() == 0


def test_fingerprints(spark, docs, none):
    a = "One sentence here. Two there!\nA second paragraph? Yes.\n\nA new section."
    b = a.replace("second", "changed")
    r = spark.createDataFrame([(a, b)], "a string, b string")
    t = r.select(fingerprints.tree(F.col("a")).alias("x"), fingerprints.tree(F.col("b")).alias("y"))
    d = t.select(fingerprints.differing_branches(F.col("x"), F.col("y"))).collect()[0][0]
    assert [(x["section"], x["paragraph"], x["leaf"]) for x in d] == [(0, 1, 1)]
    x = fingerprints.with_next(docs).collect()
    order = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0))
    follow = {order[i][0]: order[(i + 1) % len(order)][1] or "" for i in range(len(order))}
    assert len(x) == len(DOCS)
    assert all(r["next_text"] == follow[r["doc_id"]] for r in x if r["doc_id"] != 7)
    e = spark.createDataFrame([("abcdefgh", "XYZ"), ("abcdefgh", "X"), ("", "X"), ("é😀ab", "ü")], "a string, b string")
    assert [r[0] for r in e.select(fingerprints.edited(F.col("a"), F.col("b"))).collect()] == ["abcdefXY", "abcdefX", "", "é😀aü"]
    assert fingerprints.with_next(none).count() == 0
    far = [(i, f"text {i}") for i in range(3000)] + [(10**17, "far")] + [(7, f"seven {i}") for i in range(2000)] + [(None, f"null {i}") for i in range(700)]
    far = spark.createDataFrame(far, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    sizes = [r["count"] for r in far.withColumn("b", fingerprints.bucket_of(far)).groupBy("b").count().collect()]
    assert max(sizes) < 1000 and sum(sizes) == 5701
    x = fingerprints.with_next(far).collect()
    rows = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]) for r in far.collect()])
    follow = {r[3]: rows[(i + 1) % len(rows)][3] for i, r in enumerate(rows)}
    assert len(x) == len(rows) and all(follow[r["text"]] == r["next_text"] for r in x)


def test_pii_base(spark, docs, none):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    spans = [(s["kind"], s["start"], s["end"]) for s in got[8]["base"]]
    t = DOCS[8][1]
    assert [(k, t[a:b]) for k, a, b in spans] == [("email", "a.b@c.example.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0101")]
    assert set(map(str, got[8]["base"])) <= set(map(str, got[8]["spans"]))
    odd = ["a@b.c_d@e.f", "300.1.2.3 1.2.3.4.5.6.7.8", "1" * 5000, "a" * 5000 + "@", "+1 2 3", "a.a" * 2000, "4111111111111111 5"]
    x = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.find(spark.createDataFrame([(i, s, None, None, None) for i, s in enumerate(odd)], SCHEMA)).collect()}
    assert x[0] == [("email", 0, 5), ("email", 5, 11)]
    assert x[1] == [("ip", 10, 17), ("ip", 18, 25)]
    assert all(x[i] == [] for i in (2, 3, 4, 5))
    assert pii.find(none).count() == 0


def test_toxicity(spark, none):
    docs = [(i, f"word{i} plain text {'idiotic' if i % 2 else 'kindly'} other{i} more", "en", "s", 1) for i in range(200)] + [(900, None, None, None, None), (901, "an idiotix here", "en", "s", 1)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(d, labels)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert min(score[i] for i in range(1, 200, 2)) >= toxicity.THRESHOLD > max(score[i] for i in range(0, 200, 2))
    assert score[900] < 0.5
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(d, labels.limit(0))[0] == []
    trie = toxicity.build_trie(["moron", "clown$"])
    assert toxicity.near("mor0n", trie) and toxicity.near("morrons", trie) and not toxicity.near("melon", trie) and not toxicity.near("clowning", trie)


def test_url_filters(spark):
    urls = [
        "https://www.example.com/en/742?x=1", "http://EXAMPLE.com/en/1", "http://example.net/de/80", "http://a.b.example.net/de/9#x", "http://notorg/es/1", "http://x.org/es/", None, "no scheme",
        "http://spam-farm.example.org/fr/1", "http://com/en", "ftp://u.com?/en/", "http://a.com/EN/1",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("verdict", F.lit(1))
    rules = url_filters.rule_table(spark, url_filters.host_rules() + url_filters.pattern_rules())
    rows = url_filters.judge(pages, rules).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == ("www.example.com", "/en/742", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow")
    assert got[4][2:] == (None, "allow") and got[5][2:] == ("org/es/", "block") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow") and got[10] == ("u.com", "", None, "allow") and got[11][2] is None
    assert {r["verdict"] for r in url_filters.judge(pages, url_filters.rule_table(spark, [])).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_warc_round_trip(spark, tmp_path):
    import base64

    rows = [(1, "http://a/", b"same"), (2, "http://b/", b"same"), (2, "http://b/", b"same"), (3, None, b""), (4, "x\r\ny", b"WARC/1.1\r\n\r\n\r\n"), (None, "http://n/", b"\xff\x00"), (5, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary").withColumn("head", F.lit(0))
    heads, blobs = warc.read_archive(spark, warc.write_archive(pages, str(tmp_path / "a")))
    assert blobs.count() == 4 and heads.count() == len(rows)
    warc.export_files(heads, blobs, str(tmp_path / "w"))
    back = warc.import_files(spark, str(tmp_path / "w")).collect()
    assert len(back) == len(rows)
    for r in back:
        if r["warc_type"] == "response":
            assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
        else:
            assert (r["page_id"], r["payload"]) in (("1", b""), ("3", b""))
    assert sorted(r["page_id"] for r in back if r["warc_type"] == "revisit") == ["1", "3"]
    h, b = warc.read_archive(spark, warc.write_archive(pages.limit(0), str(tmp_path / "e")))
    assert warc.records(h, b).count() == 0


def test_sentencepiece_is_the_library(spark, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        model = sentencepieces.read_model()
    except OSError:
        pytest.skip("no model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL), sentencepieces.Codec(model)
    texts = [t or "" for _, t, *_ in DOCS] + ["  two  spaces\n\tand tabs ", "日本語 é😀 \0\0x <0x0A> </s>", "aaaaaaaaaaaaaaaaa", " ", "def f(x):\n        return x"]
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == sp.encode(t)
        assert c.decode(ids.tolist()) == t
    got = sentencepieces.encoded(docs)
    assert got.columns == [*docs.columns, "token_ids", "n_tokens"]
    assert {r["doc_id"]: r["token_ids"] for r in got.collect()}[6] == sp.encode("two words")


def test_pipeline_stages(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.createDataFrame(DOCS, SCHEMA)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, "")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
        d = spark.createDataFrame(out.collect(), out.schema)
    ids = [r["doc_id"] for r in d.collect()]
    assert 1 in ids and 2 not in ids and 6 not in ids


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def brute_removed(rows):
    """(doc_id, pos) of the lines that go, by comparing all lines with each other."""
    at = sorted((i, p, x) for i, t, *_ in rows if t is not None for p, x in enumerate(t.split("\n")) if words(x) and len(x) >= line_dedup.EXACT_CHARS)
    lines = sorted({x for *_, x in at})
    part = {x: k for k, x in enumerate(lines)}
    for k, a in enumerate(lines):
        for b in lines[:k]:
            u, v = words(a), words(b)
            t = min(len(u), len(v)) // line_dedup.WORD_SHARE
            near = abs(len(a) - len(b)) <= line_dedup.TAU and word_distance(a, b) <= line_dedup.TAU
            near = near or (abs(len(u) - len(v)) <= t and word_distance(u, v) <= t)
            if min(len(a), len(b)) >= line_dedup.NEAR_CHARS and near and part[a] != part[b]:
                part = {x: part[b] if p == part[a] else p for x, p in part.items()}
    seen, gone = set(), set()
    for i, p, x in at:
        if part[x] in seen:
            gone.add((i, p))
        seen.add(part[x])
    return gone


def test_line_dedup_links_lines_with_replaced_words(spark):
    import random

    random.seed(7)
    vocabulary = ["".join(random.choice("abcdeéß") for _ in range(random.randint(1, 12))) for _ in range(300)]
    rows = []
    for _ in range(25):
        w = [random.choice(vocabulary) for _ in range(random.choice((9, 10, 14, 20, 38, 42, 60, 130)))]
        for e in (0, 1, 1, 2, 4, 7):
            v = list(w)
            for _ in range(e):
                k = random.randrange(len(v))
                v[k : k + 1] = random.choice(([random.choice(vocabulary)], [], [v[k], random.choice(vocabulary)], [v[k] + "x"]))
            rows.append((len(rows), "some other line " + str(len(rows)) + "\n" + " ".join(v), "en", "s", 1))
    got = {(r["doc_id"], r["pos"]) for r in line_dedup.removed_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_removed(rows)
    a, b = " ".join(vocabulary[:60]), " ".join([*vocabulary[:30], "otherwordhere", *vocabulary[31:60]])
    two = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1)], SCHEMA)
    assert [(r["doc_id"], r["pos"]) for r in line_dedup.removed_lines(two).collect()] == [(2, 0)]


def test_toxicity_learns_beside_copies_of_one_document(spark):
    copy = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}copied" for i in range(2500)) + " idiotic"
    docs = [(i, f"word{i} plain text {'idiotic' if i % 2 else 'kindly'} other{i} more", "en", "s", 1) for i in range(200)]
    docs += [(1000 + i, copy, "en", "s", 1) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, i % 2 if i < 1000 else 1) for i, *_ in docs], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(d, labels)
    assert any("idiotic$".startswith(t) for t in model[0]) and not any("copied" in t for t in model[0])
    score = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert min(score[i] for i in range(1, 200, 2)) >= toxicity.THRESHOLD > max(score[i] for i in range(0, 200, 2))


def test_lexicon_asks_the_automaton_for_every_word_within_one_edit():
    import string

    for term in ("clown$", "moron", "scoundrels$", "scoundrelly$", "good-for-nothings$".replace("-", "")):
        lexicon, t = toxicity.Lexicon([term]), term.removesuffix("$")
        for i in range(len(t) + 1):
            for c in string.ascii_lowercase:
                for w in (t[:i] + c + t[i:], t[:i] + c + t[i + 1 :], t[:i] + t[i + 1 :]):
                    assert (lexicon.kind(w) > 0) == bool(toxicity.near(w, lexicon.fuzzy)), (term, w)


def test_line_dedup_classes_short_lines(spark):
    lines = ["Les.", "Of, edti oner.", "a line of 20 letters", "a line of 2o letters", "x", " "]
    rows = [(i, "\n".join([f"{i * 7919}", *lines[: 3 - i], *lines[3 - i :]]), "en", "s", 1) for i in range(2)]
    got = {(r["doc_id"], r["pos"]) for r in line_dedup.removed_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, 4), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5)} == brute_removed(rows)


def test_likeness_is_one_measure_at_every_size(spark):
    w = [f"word{i}" for i in range(400)]
    run = "".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(60))
    pairs = [(" ".join(w[:n]), " ".join(x if i % 20 else "new" for i, x in enumerate(w[:n]))) for n in (40, 100, 400)] + [(run, run[:9] + "x" + run[9:])]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.select(fingerprints.fingerprint(F.col("a")).alias("x"), fingerprints.fingerprint(F.col("b")).alias("y"))
    rows = df.select(fingerprints.likeness(F.col("x"), F.col("y")), fingerprints.as_string(F.col("x"))).collect()
    assert all(0.9 < r[0] < 1 for r in rows), rows
    assert all(r[1].count(":") == 2 for r in rows)


def test_pii_adds_what_base_patterns_leave_out(spark):
    import random

    random.seed(4)
    token = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    card = "4111 1111 1111 1111"
    rows, planted = [], {}
    for i in range(120):
        kind = ("secret", "email", "phone", "none", "digits")[i % 5]
        what = {"secret": token(), "email": f"anna{i} (at) mail.example.org", "phone": "01 23 45 67 89", "none": "nothing", "digits": str(10**15 + 7919 * i)}[kind]
        before = {"secret": 'some text with token = "', "email": "please mail ", "phone": "telefon ", "none": "x ", "digits": "y "}[kind]
        text = f"{before}{what}\" and more; {card} and a.b{i}@c.org"
        rows.append((i, text, "en", "s", 1))
        if kind not in ("none", "digits"):
            planted[i] = (kind, len(before), len(before) + len(what))
    of = lambda r, c: [(s["kind"], s["start"], s["end"]) for s in r[c]]
    got = {r["doc_id"]: [s for s in of(r, "spans") if s not in of(r, "base")] for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, *_ in rows:
        assert got[i] == ([planted[i]] if i in planted else []), (i, rows[i][1], got[i])


def test_ids_beside_nulls_stay_exact(spark):
    big = 2**53 + 1
    d = spark.createDataFrame([(big, BASE, "en", "s", 1), (None, BASE, "en", "s", 1)], SCHEMA).coalesce(1)
    assert [r["doc_id"] for r in toxicity.score(d, ([], [0.0] * 5 + [-5.0])).collect()] == [big, None]
    assert {(r["doc_id"], r["component_id"]) for r in ngram_jaccard.groups(d).collect()} == {(big, big), (None, big)}


def test_warc_reads_compressed_files_and_numbers_repeated_rows(spark, tmp_path):
    rows = [(1, "http://a/", b"x"), (1, "http://a/", b"x"), (1, "http://b/", b"y"), (2, "http://a/", b"")]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    heads, blobs = warc.read_archive(spark, warc.write_archive(pages, str(tmp_path / "a")))
    warc.export_files(heads, blobs, str(tmp_path / "w"), "gzip")
    back = warc.import_files(spark, str(tmp_path / "w")).collect()
    assert len({r["record_id"] for r in back}) == len(rows) == len(back)
    assert sorted((r["page_id"], r["payload"]) for r in back) == [("1", b"x"), ("1", b"x"), ("1", b"y"), ("2", b"")]


def test_pipeline_run_against_brute_force(spark, tmp_path):
    """Base rules, line dedup and near copies by brute force, mixing by its operator on that, tokens by the library."""
    import random

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sentencepiece = pytest.importorskip("sentencepiece")
    random.seed(9)
    vocabulary = ["".join(random.choice("abcdefghiklmnoprstu") for _ in range(random.randint(2, 9))) for _ in range(500)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    shared = line(25)
    rows = []
    for i in range(24):
        text = "\n".join([line(30), shared if i % 3 == 0 else line(20), line(25)])
        rows.append((i, text, ("en", "de")[i % 2], f"src{i % 4}", len(text)))
    for i, of in ((100, 1), (101, 2)):  # one word of 75 replaced, in a line by itself, so that lines differ and documents do not
        words_ = rows[of][1].split(" ")
        words_[len(words_) // 2] = "replacedword"
        rows.append((i, " ".join(words_), "en", "src1", 1))
    rows += [(200, "too few words", "en", "src1", 1), (201, "again and " * 40, "en", "src1", 1), (202, None, "en", "src1", 0), (203, rows[4][1], "de", "src0", 1)]
    at = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, at).collect()}

    kept = [r for r in rows if r[1] and len(words(r[1])) >= 10 and 100 * repeats(words(r[1])) <= 20 * len(words(r[1]))]
    gone = brute_removed(kept)
    left = []
    for i, t, lang, source, n in kept:
        cut = [p for p in range(t.count("\n") + 1) if (i, p) in gone]
        u = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut)
        if not cut or words(u):
            left.append((i, u, lang, source, len(u) if cut else n))
    alone = {c for _, n, c in jaccard(left)}
    left = [r for r in left if r[0] in alone]
    mixed = {r["doc_id"]: r["text"] for r in mixing.mixed_docs(spark.createDataFrame(left, SCHEMA), corpus_pipeline.MIX_FRACTION).collect()}
    assert {i: r["text"] for i, r in out.items()} == mixed and 0 < len(mixed) <= len(left)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    assert all(r["token_ids"] == sp.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"]) for r in out.values())


def test_a_group_of_near_copies_costs_few_comparisons(spark):
    n = 60
    pairs = [(1000 * a + b, a, b) for a in range(n) for b in range(a)]  # each pair has a bucket of its own
    rows = [(k, x, b, 2) for k, a, b in pairs for x in (a, b)]
    sketch = spark.range(n).select(F.col("id").alias("node"), F.lit(1).alias("one"))
    seen = []

    def verify(p):
        seen.append(p.count())
        return p

    scheme = lambda crowded: spark.createDataFrame(rows, "key long, node long, center long, side int")
    got = links.linked_classes([scheme], sketch, lambda i, j: F.lit(True), verify, 64, thin=True).collect()
    assert {r["id"]: r["component"] for r in got} == dict.fromkeys(range(n), 0)
    assert sum(seen) <= 2 * n


def test_a_crowded_bucket_that_the_rows_allow_is_compared_at_once(spark):
    """Stars were drawn in it, and its lines asked for longer runs, each with all joins anew."""
    crowd, pairs = [(0, n, 0, n > 0) for n in range(100)], [(k, 1000 * k + i, 1000 * k, i > 0) for k in range(1, 61) for i in (0, 1)]
    b = [(k, n, c, line_dedup.WORDS, True) for k, n, c, _ in crowd + pairs]
    frame = links.stored(spark.createDataFrame(b, "key long, node long, center long, side int, whole boolean"), "b")
    sketch = links.stored(frame.select("node").distinct().withColumn("x", F.lit(1)), "s")
    asked, found = [], []

    def verify(pairs):
        found.append(pairs.count())
        return links.stored(pairs.where("a = 50 AND b = 90"), "v")

    later = lambda crowded: (asked.append(crowded.count()), frame)[1]
    got = links.linked_classes([lambda crowded: frame, later], sketch, lambda i, j: F.lit(True), verify, 64).collect()
    assert {r["id"]: r["component"] for r in got} == {50: 50, 90: 50}
    assert asked == [] and found == [99 + 60, 99 * 98 // 2]


def test_keys_of_words_meet_within_edits_of_characters(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        a = " ".join(rnd.choice(["a", "bc", "def", "ghij", "kl mn"]) for _ in range(rnd.randint(6, 24)))
        b = a
        for _ in range(2):
            i = rnd.randrange(len(b))
            b = rnd.choice([b[:i] + b[i + 1 :], b[:i] + rnd.choice(" xa") + b[i:], b[:i] + rnd.choice(" xa") + b[i + 1 :]])
        rows.append((a, b))
    lines = [(i, j, s, len(s)) for i, r in enumerate(rows) for j, s in enumerate(r) if s.strip()]
    x = spark.createDataFrame(lines, "doc_id long, pos int, line string, n int")
    for gram in line_dedup.GRAMS:
        keys = line_dedup.keyed_lines(x, gram).collect()
        most = [len([k for k in keys if k["doc_id"] == i and k["side"] != line_dedup.WORDS]) for i, r in enumerate(rows) if min(len(s.split()) for s in r) >= 17]
        assert most and max(most) == 0  # no segments of lines with many words
        by = {}
        for k in keys:
            by.setdefault(k["doc_id"], {}).setdefault(k["node"], set()).add((k["side"], k["key"]))
        for sides in by.values():
            if len(sides) == 2:
                p, q = sides.values()
                assert any((s, k) in q if s == 2 else (1 - s, k) in q for s, k in p)


def test_words_that_share_a_code_stay_apart(spark, monkeypatch):
    rows = [("a b c d e f g h i j k l", "a b c d e f g h i j k x"), ("a b c d e f g h i j k l", "a b c d e f g h i j y x"), ("a b c d e f g h i j", "j i h g f e d c b a")]
    for bits in (1, 19):
        monkeypatch.setattr(line_dedup, "CODE_BITS", bits, raising=False)
        got = spark.createDataFrame(rows, "a string, b string").select(line_dedup.words_within(F.col("a"), F.col("b")).alias("w")).collect()
        assert [r["w"] for r in got] == [True, False, False]


def test_a_stage_deletes_what_earlier_ones_stored(spark, tmp_path):
    """Stages that are run one by one, each written, left all their tables behind; what a stage still reads stays."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import os

    from streetspark.llm.common import WRITTEN

    of = lambda p: p.removeprefix("file://").removeprefix("file:")
    before = set(WRITTEN)
    docs = spark.createDataFrame([(i, f"some {i} words that are here for number {i} and not more than that again", "en", "s", 9) for i in range(12)], SCHEMA)
    lazy = corpus_pipeline.quality(spark, docs, "")
    mine = set(WRITTEN) - before
    assert mine and all(os.path.isdir(of(p)) for p in mine)
    corpus_pipeline.mixture(spark, lazy, "")  # reads what quality stored
    assert any(os.path.isdir(of(p)) for p in mine) and lazy.count() == 12
    lazy.write.parquet(str(tmp_path / "0"))
    corpus_pipeline.mixture(spark, spark.read.parquet(str(tmp_path / "0")), "")
    assert not any(os.path.exists(of(p)) for p in mine)


def test_signing_memory_goes_with_signatures():
    import math

    subsets = [math.comb(n2, k2) for k2, n2 in ngram_jaccard.SCHEMES]
    made = [ngram_jaccard.chunk(i) * s for i, s in enumerate(subsets)]
    assert max(made) <= ngram_jaccard.CHUNK * subsets[0]


def test_pairs_of_many_shared_keys_are_made_once(spark, monkeypatch):
    keys = {n: [k for k in range(40) if (n * 7919 + k * 104729) % 11 < 6] for n in range(12)}
    main = {k: max(n % 4 for n in keys if k in keys[n]) for k in range(40)}
    rows = spark.createDataFrame([(k, n, 2, n % 4, main[k], 1) for n in keys for k in keys[n]], "key long, node long, side int, c long, main long, rest long")
    sketch = spark.createDataFrame([(n, 0) for n in keys], "node long, z int")
    want = {(a, b) for a in keys for b in keys if a < b and a % 4 != b % 4 and set(keys[a]) & set(keys[b])}
    monkeypatch.setattr(type(rows), "distinct", lambda self: self)
    got = [(r["a"], r["b"]) for r in links.one_by_one(rows, sketch, lambda i, j: F.lit(True)).collect()]
    assert set(got) == want
    assert len(got) < 1.1 * len(want)
    monkeypatch.setattr(links, "SEEN", 64)
    assert sorted((r["a"], r["b"]) for r in links.one_by_one(rows, sketch, lambda i, j: F.lit(True)).collect()) == sorted(want)


def test_keys_of_the_same_lines_are_one_bucket(spark):
    docs = spark.createDataFrame([(1, BASE), (2, NEAR), (3, " ".join(BASE.split()[:12]) + " and words that stand in no other line of this table at all")], "doc_id long, text string")
    lines = line_dedup.lines_of(docs)
    held = collections.defaultdict(set)
    for r in line_dedup.buckets(line_dedup.keyed_lines(lines, 3), 3).collect():
        held[r["key"]].add((r["node"], r["side"], r["center"]))
    assert len(held) > 1
    assert len({frozenset(v) for v in held.values()}) == len(held)
