"""Corpus operators on small tables: brute force, planted cases, nulls, repeats, empty tables."""

import collections
import gzip
import hashlib
import html.parser
import itertools
import math
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import decontamination, html_text, jaccard, language_model, licenses, pieces, quality, sharding, topk, warc
from tidewake.llm.common import ROW, new_path, with_row_key, words
from tidewake.llm.graph import components

DOC = "doc_id long, text string, n_words string, extra int"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, ids=None):
    """Documents with a column whose name clashes with results, and one more."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "mine", 7) for i, t in zip(ids, texts, strict=True)], DOC)


def odd_texts(rng):
    """Null, empty, wordless, one word, repeated, very long and equal texts."""
    same = prose(rng, 60)
    return [None, "", " \n!? ", "one", same, same, prose(rng, 20_000), "É ÀÉ 漢字 emoji 🙂 text", prose(rng, 80)]


# --- language model


def test_language_model_counts_and_odd_rows(spark):
    rng = random.Random(1)
    texts = odd_texts(rng) + [prose(rng, 30) for _ in range(30)]
    docs = documents(spark, texts, [None, *range(1, len(texts))]).withColumnRenamed("extra", "score")
    train = docs.where("doc_id % 3 <> 0 or doc_id is null")
    corpus, net = language_model.fit(train, most_places=50, frequent_share=200, rounds=2)
    got = {r["doc_id"]: r for r in language_model.score(docs, corpus, net).collect()}
    assert len(got) == len(texts)
    toks = {i: (t or "").encode().lower().split() + [b""] for i, t in zip([None, *range(1, len(texts))], texts, strict=True)}
    c = collections.Counter(w for i, ws in toks.items() if i is None or i % 3 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_language_model_probabilities_sum_to_one_and_gradients_are_right():
    rng = np.random.default_rng(0)
    net = language_model.Network.begin(np.array([5.0, 40, 30, 9, 7, 4, 3, 2, 1, 1])).prepared()
    net.weights = [w.astype(np.float64) + rng.normal(0, 0.2, w.shape) for w in net.weights]
    states = np.c_[rng.uniform(-1, 1, (3, language_model.HIDDEN)), np.ones(3)]
    total = sum(np.exp(net.log_likelihood(states, np.full(3, k))) for k in range(10))
    assert np.allclose(total, 1, atol=1e-5)
    inputs, targets = rng.integers(0, 10, (5, 3)), rng.integers(0, 10, (5, 3))
    keep, real = np.ones((5, 1, 3)), np.ones((5, 3), bool)
    keep[2, 0, 1] = 0
    zero = np.zeros((language_model.HIDDEN, 3))

    def loss():
        s, _, _ = net.run(inputs, keep, zero)
        return -float(net.log_likelihood(net.by_token(s), targets.reshape(-1)).astype(np.float64).mean())

    grads, rows, _ = net.gradients(inputs, targets, keep, real, zero)
    for w, some, k in zip(net.weights, grads, rows, strict=True):
        g = np.zeros_like(w)
        g[k] = some
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_language_model_state_crosses_windows():
    net = language_model.Network.begin(np.arange(1.0, 20)).prepared()
    rng = np.random.default_rng(2)
    for w in net.weights:
        w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    texts = [rng.integers(0, 19, n).astype(np.int32) for n in (100, 3, 0, 70, 33)]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], rtol=1e-4)
    one = net.run(np.r_[0, texts[0]][:, None], np.ones((101, 1, 1), np.float32), np.zeros((language_model.HIDDEN, 1), np.float32))[0]
    assert together[0] == pytest.approx(float(net.log_likelihood(net.by_token(one), np.r_[texts[0], 0]).sum()), rel=1e-4)


def test_language_model_trains_long_texts_with_one_state(monkeypatch):
    assert language_model.EMBED >= 16 and language_model.HIDDEN >= 24
    net = language_model.Network.begin(np.arange(1.0, 20)).prepared()
    begun, whole = [], language_model.Network.gradients

    def watched(self, inputs, targets, keep, real, state, steep):
        begun.append(int((keep == 0).sum()))
        return whole(self, inputs, targets, keep, real, state, steep)

    monkeypatch.setattr(language_model.Network, "gradients", watched)
    texts = [np.arange(n, dtype=np.int32) % 18 + 1 for n in (3000, 1500, 40)]
    assert net.train(texts, net.blank_moments(), [0], 0.01) == 4543
    assert sum(begun) == 3  # the state begins anew once for each text


def test_language_model_places_follow_the_counts(spark):
    docs = documents(spark, [" ".join(f"w{k}" for k in range(12000) if k < 9000 or i == 0) for i in range(40)])
    corpus = language_model.Corpus(language_model.count_words(docs, "text"), 2_000_000)
    assert len(corpus.placed) == 9000 and set(corpus.placed) == {b"w%d" % k for k in range(9000)}
    assert corpus.unplaced_share == pytest.approx(3000 / 363000)
    net = language_model.Network.begin(corpus.place_counts)
    assert len(net.starts) - 1 > 48
    small = language_model.Corpus(language_model.count_words(docs.limit(1), "text"), 2_000_000, 50)
    assert len(small.placed) == 50


def test_language_model_updates_the_rows_with_gradients():
    rng = np.random.default_rng(5)
    net = language_model.Network.begin(rng.integers(1, 1000, 5000).astype(float)).prepared()
    inputs, targets = rng.integers(0, 5000, (2, 8, 3)).astype(np.int32)
    _, rows, _ = net.gradients(inputs, targets, np.ones((8, 1, 3), np.float32), np.ones((8, 3), bool), np.zeros((language_model.HIDDEN, 3), np.float32))
    assert set(rows[0]) == set(inputs.reshape(-1))
    classes = {net.class_of[t] for t in targets.reshape(-1)}
    assert set(net.rank_class[rows[-1]]) == {c for c in classes if net.starts[c + 1] - net.starts[c] > 1}


def plain_score(net, text):
    """Log probability of one text, a token at a time and over all words."""
    embed, into, recur, bias, class_w, word_w = (w.astype(np.float64) for w in net.weights)
    h = net.weights[2].shape[0]
    state, total = np.zeros(h), 0.0
    for given, wanted in zip([0, *text], [*text, 0], strict=True):
        x, pulled = embed[given] @ into + bias, state @ recur
        r, z = (1 / (1 + np.exp(-(x[k * h : (k + 1) * h] + pulled[k * h : (k + 1) * h]))) for k in (0, 1))
        new = np.tanh(x[2 * h :] + r * pulled[2 * h :])
        state = new + z * (state - new)
        seen = np.r_[state, 1]
        of_class = np.exp(class_w @ seen)
        c = net.class_of[wanted]
        of_word = np.exp(word_w[net.starts[c] : net.starts[c + 1]] @ seen)
        total += np.log(of_class[c] / of_class.sum()) + np.log(of_word[net.rank[wanted] - net.starts[c]] / of_word.sum())
    return total


def test_language_model_against_a_plain_version():
    rng = np.random.default_rng(3)
    net = language_model.Network.begin(rng.integers(1, 1000, 900).astype(float)).prepared()
    texts = [rng.integers(0, 900, n).astype(np.int32) for n in (0, 1, 31, 32, 33, 200, 5)]
    net.train([rng.integers(0, 900, 300).astype(np.int32) for _ in range(20)], net.blank_moments(), [0], 0.02)
    assert np.allclose(net.scores(texts), [plain_score(net, t.tolist()) for t in texts], rtol=1e-4)


def test_language_model_work_follows_tokens_not_calls(monkeypatch):
    rng = np.random.default_rng(6)
    net = language_model.Network.begin(rng.integers(1, 1000, 300).astype(float)).prepared()
    inputs, targets = rng.integers(0, 300, (2, 32, 200)).astype(np.int32)
    grads, rows, _ = net.gradients(inputs, targets, np.ones((32, 1, 200), np.float32), np.ones((32, 200), bool), np.zeros((language_model.HIDDEN, 200), np.float32))
    assert isinstance(rows[-1], slice) and len(grads[-1]) == rows[-1].stop - rows[-1].start  # all at hand: no row is looked up
    calls, whole = [], language_model.Network.log_likelihood
    monkeypatch.setattr(language_model.Network, "log_likelihood", lambda self, states, *a, **b: calls.append(len(states)) or whole(self, states, *a, **b))
    net.scores([rng.integers(0, 300, 3199).astype(np.int32) for _ in range(4)])
    assert calls == [12800]  # of 100 windows at once


def test_language_model_slices_of_rows_with_missing_classes():
    rng = np.random.default_rng(7)
    net = language_model.Network.begin(rng.integers(1, 1000, 900).astype(float)).prepared()
    states = np.c_[rng.uniform(-1, 1, (900, language_model.HIDDEN)), np.ones(900)].astype(np.float32)
    gone = len(net.starts) // 2
    targets = np.flatnonzero(net.class_of != gone)
    weight = rng.uniform(0, 1, len(targets)).astype(np.float32)
    states = states[: len(targets)]
    _, back, class_grad, word_grad, rows = net.log_likelihood(states, targets, weight)
    assert isinstance(rows, slice)
    wanted_word, wanted_class, wanted_back = np.zeros_like(net.weights[5]), np.zeros_like(net.weights[4]), np.zeros_like(states)
    for x, t, u, b in zip(states, targets, weight, wanted_back, strict=True):  # chances less one at the target
        c, at = net.class_of[t], net.rank[t]
        lo, hi = net.starts[c], net.starts[c + 1]
        for w, out, k in ((net.weights[4], wanted_class, c), (net.weights[5][lo:hi], wanted_word[lo:hi], at - lo)):
            p = np.exp(w @ x)
            p /= p.sum()
            p[k] -= 1
            out += u * p[:, None] * x
            b += u * (p @ w)
    got = np.zeros_like(wanted_word)
    got[rows] = word_grad
    assert not got[net.starts[gone] : net.starts[gone + 1]].any()
    for x, y in ((got, wanted_word), (class_grad, wanted_class), (back, wanted_back)):
        assert np.allclose(x, y, rtol=1e-3, atol=1e-5)


def test_language_model_steep_scores_of_class_and_word():
    net = language_model.Network.begin(np.arange(1.0, 200)).prepared()
    net.weights[4][:, -1], net.weights[5][:, -1] = 1, 1
    target = int(np.flatnonzero(net.class_of == 3)[0])
    net.weights[4][3, -1] = net.weights[5][net.rank[target], -1] = 45  # each is far ahead of the others
    states = np.c_[np.zeros((1, language_model.HIDDEN)), 1].astype(np.float32)
    assert net.log_likelihood(states, np.array([target]))[0] == pytest.approx(0, abs=1e-4)


def test_language_model_learns_beyond_counts(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(3000):  # each word follows from the one before, but for one in ten
        at, text = rng.randrange(40), []
        for _ in range(60):
            at = rng.randrange(40) if rng.random() < 0.1 else (at * 7 + 3) % 40
            text.append(WORDS[at])
        texts.append(" ".join(text))
    docs = documents(spark, texts)
    corpus, net = language_model.fit(docs.where("doc_id < 2800"))
    r = language_model.score(docs.where("doc_id >= 2800"), corpus, net).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] * 0.5


def test_language_model_empty_tables(spark):
    docs = documents(spark, ["a b"])
    corpus, net = language_model.fit(docs.where("false"))
    r = language_model.score(docs, corpus, net).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"])
    assert language_model.score(docs.where("false"), corpus, net).count() == 0


# --- WARC


def test_warc_round_trip(spark):
    rng = random.Random(2)
    copy = "<p>" + prose(rng, 400)
    pages = [(1, "http://a", copy), (2, "http://b", copy), (2, "http://b", copy), (9, "http://c\r\nX: y", copy), (3, None, None), (4, "u", ""), (5, "u", "é漢" * 40_000 + "\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 999), (7, "u", "x" * 999), (None, "u", copy)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc")
    warc.write_warc(df, path, segment_bytes=1000, records_per_file=50)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(pages) and all(r["complete"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[re.sub(";.*>", ">", r["record_id"])].append(r)
    assert {r["type"] for k in ("1", "2", "null") for r in by[f"<urn:page:{k}>"]} == {"revisit"}
    assert by["<urn:page:9>"][0]["type"] == "response" and by["<urn:page:1>"][0]["refers_to"] == by["<urn:page:9>"][0]["record_id"]
    assert len({r["record_id"] for r in got}) == len(pages)
    for k, _, body in pages:
        for r in by[f"<urn:page:{'null' if k is None else k}>"]:
            raw = (body or "").encode()
            assert r["payload_bytes"] == len(raw) and r["digest"] == hashlib.sha1(raw).hexdigest()
            assert r["type"] == "revisit" or bytes(r["payload"]) == raw
    empty = new_path(spark, "warc")
    warc.write_warc(df.where("false"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_long_pages_with_repeated_and_null_ids(spark):
    rng = random.Random(4)
    same = prose(rng, 900)
    pages = [(k, "u", prose(rng, 900)) for k in (1, 1, 1, 2, None, None, None)] + [(3, "u", same), (3, "u", same), (None, "v", same + "."), (None, "w", same + ".")]
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path, segment_bytes=1000, records_per_file=50)
    got = warc.read_warc(spark, path).collect()
    assert all(r["complete"] and r["type"] == "response" for r in got)
    wanted = collections.Counter((f"<urn:page:{'null' if k is None else k}>", u, x) for k, u, x in pages)
    assert collections.Counter((re.sub(";.*>", ">", r["record_id"]), r["uri"], bytes(r["payload"]).decode()) for r in got) == wanted
    assert {r["payload_bytes"] for r in got} == {len(x) for _, _, x in pages}
    files = [bytes(x) for (x,) in spark.read.format("binaryFile").load(path).select("content").collect()]
    records = [f for x in files for f, _ in warc.parse_archive(warc.inflated(x))]
    assert len({f["warc-record-id"] for f in records}) == len(records) > len(pages)
    assert sum(len(gzip.decompress(x)) for x in files) == sum(len(y) for x in files for y in warc.inflated(x))
    members = 0
    for x in files:
        while x:
            d = zlib.decompressobj(31)
            assert d.decompress(x).count(b"WARC/1.1") == 1
            x, members = d.unused_data, members + 1
    assert members == len(records)  # each record is a member of its own


def test_warc_reads_any_compression():
    members = [m + b"\0" for k in range(40) for m in warc._records(f"<urn:page:{k}>", "u", "response", None, "00", b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * 5000 * k, 1 << 20)]
    plain = b"".join(zlib.decompress(m, 31) for m in members)
    for archive in (b"".join(members), plain, gzip.compress(plain), gzip.compress(plain[:1000]) + gzip.compress(plain[1000:])):
        assert [len(b) for _, b in warc.parse_archive(warc.inflated(archive, 100))] == [19 + 5000 * k for k in range(40)]
    for bad in (b"".join(members)[:-30], plain[:-9], b"x" + plain):
        with pytest.raises(ValueError):
            list(warc.parse_archive(warc.inflated(bad)))


def test_warc_missing_segment_is_incomplete(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"z" * 500, 100)
    parts = list(warc._records("<urn:page:1>", "u", "response", None, "00", block, 150))
    assert len(parts) > 3

    def read(some):
        path = pathlib.Path(new_path(spark, "warc"))
        path.mkdir(parents=True)
        (path / "part-0").write_bytes(b"".join(p + b"\0" for p in some))
        return warc.read_warc(spark, str(path)).collect()

    assert [bytes(r["payload"]) for r in read(parts[::-1])] == [b"z" * 500]
    assert [r["complete"] for r in read(parts[:1] + parts[2:])] == [False]
    assert [r["complete"] for r in read(parts[:-1])] == [False]
    assert [r["complete"] for r in read(parts + parts[1:2])] == [False]


def test_chunked_framing():
    for n in (0, 1, 99, 100, 101, 1000):
        data = bytes(range(256)) * 4
        assert warc.dechunked(warc.chunked(data[:n], 100)) == data[:n]
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


# --- row keys


def test_row_keys_hold_when_later_jobs_split_the_input_otherwise(spark):
    rng = random.Random(12)
    texts = [prose(rng, 30) for _ in range(60)]
    passage = " ".join(texts[7].split()[5:20])
    path = new_path(spark, "input")
    documents(spark, texts + texts[:3]).repartition(12).write.parquet(path)
    docs = spark.read.parquet(path)
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    corpus, net = language_model.fit(docs, most_places=20, rounds=1)
    results = [decontamination.contamination(docs, items), language_model.score(docs, corpus, net), jaccard.one_of_each_group(docs)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        hit, scored, kept = (x.collect() for x in results)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["doc_id"] for r in hit if r["contaminated"]} == {r["doc_id"] for r in hit if passage in r["text"]} and len(hit) == 63
    assert all(r["n_tokens"] == len(r["text"].split()) + 1 for r in scored) and len(scored) == 63
    assert sorted(r["text"] for r in kept) == sorted(texts)


# --- HTML

PARA = "This is a paragraph of the article, which is long enough to count, and has commas, too."


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Title &amp; all</h1><p>{PARA}<p>Second  one,\n\t{PARA}</article><footer>foot</footer>", f"Title & all\n{PARA}\nSecond one, {PARA}"),
        (f"<body><div id=cookie-notice><p>{PARA}{PARA}</p></div><div class=content><p>{PARA}</p><p>short</p></div><div class='sidebar'><p>{PARA}{PARA}</p></div><section id=comments><p>{PARA}{PARA}</p></section></body>", f"{PARA}\nshort"),
        (f"<header><h1>Site</h1><p>{PARA}</p></header><main><p>{PARA} <b>bold</b>&nbsp;x</p><form><p>{PARA}</p></form><script>var a='</p>';</script><style>p{{}}</style></main>", f"{PARA} bold x"),
        (f"<div><ul><li><a href=a>{PARA}</a><li><a href=b>{PARA}</a></ul></div><div><p>{PARA}</p><p>{PARA}</p></div>", f"{PARA}\n{PARA}"),
        ("<p>only</p>", "only"),
        ("plain text, no tags", "plain text, no tags"),
        ("", ""),
        ("<script>x", ""),
        ("<!-- never closed", ""),
        (f"<article><p>{PARA}<br>line &lt;two&gt; &#233;&#x20AC; &am</p></article>", f"{PARA} line <two> é€ &am"),
        (f"<ARTICLE CLASS=\"a>b\"><P>{PARA}</P><DIV CLASS=ad>Buy</DIV><aside>more</aside></ARTICLE>", PARA),
    ],
)
def test_main_text(page, expected):
    assert html_text.main_text(page) == expected


def test_sections_without_an_article():
    long = "".join(f"<p>{c * 74}, {c * 73}, {c * 73}, {c * 73}</p>" for c in "abcde")
    texts = [f"{c * 74}, {c * 73}, {c * 73}, {c * 73}" for c in "abcde"]
    links = "<ul><li><a href=a>one more page</a><li><a href=b>and another page</a></ul>"
    rest = f"<section><h3>Part two</h3><p>{PARA}</p></section><h3>Steps</h3><ul><li>first<li>second</ul><pre>x = 1</pre><table><tr><td>cell</table><p>end</p>"
    wanted = "\n".join([*texts, "Part two", PARA, "Steps", "first", "second", "x = 1", "cell", "end"])
    assert html_text.main_text(f"<nav>menu</nav><div class=content><section>{long}</section>{rest}{links}</div><footer>foot</footer>") == wanted
    assert html_text.main_text(f"<body><nav>menu</nav><section>{long}</section>{rest}{links}</body>") == wanted


def test_extract_text_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, "<p>é🙂</p>", 4)], "page_id long, url string, html string, n_chars int")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("None", "é🙂", 2)]
    assert html_text.extract_text(df.where("false")).count() == 0


class PlainTree(html.parser.HTMLParser):
    """Nodes (tag, attributes, parent) and blocks (node, text, characters in links) of a well-formed page."""

    def __init__(self, page):
        super().__init__()
        self.at, self.nodes, self.blocks, self.buffer = ("#root", {}, None), [], [], []
        self.feed(page)
        self.flush()
        self.leave_out()

    def up(self, x):
        return [] if x is None else [x, *self.up(x[2])]

    def dropped(self, x):
        line = self.up(x)
        for k, (tag, _, _) in enumerate(line):
            inner = any(y[0] in ("article", "main") for y in line[k + 1 :])
            if tag in ("nav", "aside", "footer") or (tag == "header" and not inner):
                return True
        return False

    def doubted(self, x):
        return x[1].get("class") == "sidebar" and x[0] not in (*html_text.INLINE, "main")

    def leave_out(self):
        """Without the sidebars, but for those that hold an article or most of the text of a page with no other article."""
        size = lambda x: sum(len(b) - k for o, b, k in self.blocks if any(y is x for y in self.up(o)))
        some = lambda x: any(y is x for o, _, _ in self.blocks for y in self.up(o))
        articles = [x for x in self.nodes if x[0] in ("article", "main") and some(x) and not self.doubted(x)]
        whole = sum(len(b) - k for _, b, k in self.blocks)
        clear = any(not any(map(self.doubted, self.up(x))) for x in articles)
        bad = []
        for x in filter(self.doubted, self.nodes):
            holds = any(y is x for a in articles for y in self.up(a)[1:])
            if clear or size(x) <= whole / 2 or (articles and not holds):
                bad.append(x)
        self.blocks = [b for b in self.blocks if not any(y is x for x in bad for y in self.up(b[0]))]

    def flush(self):
        body = " ".join("".join(t for t, _ in self.buffer).split())
        if body:
            owner = next(x for x in self.up(self.at) if x[0] not in html_text.INLINE)
            self.blocks.append((owner, body, min(len(body), sum(len(t.strip()) for t, link in self.buffer if link))))
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.INLINE:
            self.flush()
        self.at = (tag, dict(attrs), self.at)
        self.nodes.append(self.at)

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.flush()
        self.at = self.at[2]

    def handle_data(self, data):
        if not self.dropped(self.at):
            self.buffer.append((data, any(x[0] == "a" for x in self.up(self.at))))

    def density(self, x):
        mine = [(len(b), k) for o, b, k in self.blocks if any(y is x for y in self.up(o))]
        return sum(k for _, k in mine) / max(1, sum(n for n, _ in mine))

    def points(self, x):
        total, found = 0.0, False
        for o, b, k in self.blocks:
            if o[0] not in html_text.PARAGRAPHS and o[0] not in ("#root", "body"):
                continue
            line = self.up(o[2] if o[0] in ("p", "pre", "td", "li", "dd", "blockquote") else o)
            line = [y for y in line if y[0] != "#root"][:6] or [o]
            for share, y in zip((1, 2, 6, 9, 12, 15), line):
                if y is x:
                    total, found = total + (1 + b.count(",") + min(len(b) / 100, 3)) * (1 - k / len(b)) / share, True
        return total, found

    def main_text(self):
        ranks = {}
        for x in [*self.nodes, self.up(self.at)[-1]]:
            points, found = self.points(x)
            names = set(re.findall("[a-z]+", x[1].get("class", "")))
            wanted = x[0] in ("article", "main") or (x[0] not in (*html_text.INLINE, "html", "body") and bool(names & html_text.WANTED))
            if found:
                ranks[id(x)] = ((points + 25 * (x[0] in ("article", "main")) + 5 * wanted) * (1 - self.density(x)), x)
        if not ranks:
            return ""
        best = max(r for r, _ in ranks.values())
        tops = [x for r, x in ranks.values() if r > best - 1e-9]
        best = next((y for y in self.up(tops[0]) if y[0] == "article"), tops[0])
        while best[0] not in ("article", "main", "body", "#root") and best[2][0] not in ("html", "body", "#root") and self.density(best[2]) < 0.25:
            best = best[2]
        least = max(10, 0.2 * ranks[id(best)][0]) if id(best) in ranks else 10
        out = []
        for o, b, _ in self.blocks:
            line = self.up(o)
            below = list(itertools.takewhile(lambda y: y is not best and y[2] is not best[2], line))
            rest = line[len(below) :]
            if not rest or (len(rest) == 1 and rest[0] is not best):
                continue
            x = rest[0]
            if x is not best:
                high = id(x) in ranks and ranks[id(x)][0] >= least
                if best[0] == "article":
                    own, whole = (self.points(y)[0] * (1 - self.density(y)) for y in (x, best))
                    if x[0] != "article" or not own or own < 0.2 * whole:
                        continue
                elif best[0] in ("body", "#root") or not (x[0] in ("h1", "h2") or (best[0] != "main" and self.density(x) < 0.25) or high):
                    continue
            if best[0] != "article" and any(y[0] in ("ul", "ol", "div", "table", "section", "dl") and self.density(y) > 0.6 for y in below):
                continue
            out.append(b)
        return "\n".join(out), len(tops)


def random_page(rng, depth=0):
    if depth > 4 or rng.random() < 0.35:
        body = " ".join(rng.choice(["word", "more, text", "and", "a &lt; b,", "é"]) for _ in range(rng.randint(1, 40)))
        return rng.choice([f"<p>{body}</p>", f"<p>{body} <b>{body}</b></p>", f"<a href=x>{body}</a>", body, f"<ul><li><a href=y>{body}</a></li><li>{body}</li></ul>", f"<h2>{body}</h2>"])
    tag = rng.choice(["div", "div", "div", "section", "article", "main", "nav", "aside", "header", "footer", "blockquote", "span"])
    named = rng.choice(["", "", " class=content", " class='post-body'", " class=sidebar", " id=x"])
    inner = "".join(random_page(rng, depth + 1) for _ in range(rng.randint(1, 5)))
    return f"<{tag}{named}>{inner}</{tag}>"


def test_main_text_against_a_plain_version():
    rng, compared, several = random.Random(12), 0, 0
    for _ in range(400):
        page = f"<html><body>{''.join(random_page(rng) for _ in range(rng.randint(1, 4)))}</body></html>"
        wanted = PlainTree(page).main_text()
        if wanted and wanted[1] > 1:
            continue  # a tie of two containers
        assert html_text.main_text(page) == (wanted and wanted[0])
        compared += 1
        several += page.count("<article") > 1
    assert compared > 350 and several > 10


FULL = f"<h1>Heading</h1><p>{PARA}</p><p>{PARA} {PARA}</p>"
FULL_TEXT = f"Heading\n{PARA}\n{PARA} {PARA}"


@pytest.mark.parametrize(
    "page",
    [
        f"<div id='page' class='site has-sidebar'><nav>menu</nav><article>{FULL}</article><div class=sidebar><p>{PARA}</p></div></div>",
        f"<form id='aspnetForm'><input name=x><article>{FULL}</article><button>Go</button></form>",
        f"<body><form id='aspnetForm'><div>{FULL}</div><select><option>one</select></form></body>",
        f"<div class='social-science-paper'>{FULL}</div><div class=sidebar><p>{PARA}</p></div>",
        f"<div class='related-work section'>{FULL}</div><footer>{PARA}</footer>",
        f"<article><h1>Heading</h1><section id='notice-of-default'><p>{PARA}</p></section><p>{PARA} {PARA}</p></article>",
        f"<div class='post'><div class='entry-header'><h1>Heading</h1></div><p>{PARA}</p><p>{PARA} {PARA}</p></div><div class='site-header'>{PARA}</div>",
        f"<div class='ad'><article>{FULL}</article></div>",
        f"<div class='comments-open'><main>{FULL}<ol class='comment-list'><li>{PARA * 9}</li></ol></main></div>",
        f"<article>{FULL}<div class='share-buttons'>Share {PARA}</div><div class='newsletter-box'><form>{PARA}</form></div><article class='comment'>{PARA * 20}</article></article>",
        f"<div>{FULL}</div><div class='cookie-banner'>{PARA}</div><ul class='related-links'><li>{PARA}</ul><form>{PARA} <input></form><div class='social'>{PARA}</div>",
    ],
)
def test_names_weigh_but_do_not_delete_the_article(page):
    assert html_text.main_text(page) == FULL_TEXT


def test_articles_side_by_side_and_lists_in_articles():
    links = "<ul><li><a href=a>one source</a></li><li><a href=b>another source</a></li></ul>"
    big = "".join(f"<p>{PARA}, and, so, on</p>" for _ in range(6))
    page = f"<main><article>{big}{links}</article><article>{big}</article><article><p>tiny</p></article></main>"
    one = "\n".join([f"{PARA}, and, so, on"] * 6)
    assert html_text.main_text(page) == f"{one}\none source\nanother source\n{one}"
    assert html_text.main_text(f"<article><p>&am<b>p;</b> {PARA}</p></article>") == f"&amp; {PARA}"


def test_open_quotes_are_read_by_one_rule():
    """However many tags before have quotes that never close, a > inside closed quotes ends no tag."""
    for n in (1, 31, 32, 40):
        page = "<p title='>x</p>" * n + f'<p title="a > b">{PARA}</p>'
        assert html_text.main_text(page).split("\n")[-1] == PARA
    began = time.perf_counter()
    html_text.main_text("<p a=\"'" * 50_000 + ">" + "<b '\"" * 50_000)
    html_text.main_text("<p a='>" * 50_000)
    html_text.main_text("<p a='" * 50_000 + "'")
    assert time.perf_counter() - began < 5


def test_deep_and_long_html():
    assert html_text.main_text("<div>" * 3000 + f"<p>{PARA}</p>") == PARA
    assert len(html_text.main_text("<article>" + f"<p>{PARA}</p>" * 3000 + "</article>")) == 3000 * (len(PARA) + 1) - 1
    began = time.process_time()
    for page in ("<div><p>word, word" * 100_000, '<a href="x' * 100_000 + ">", "<p>a<span '\">x" * 100_000, "<b>" * 200_000 + "x" + "</b>" * 200_000):
        html_text.main_text(page)
    assert time.process_time() - began < 60


# --- near copies


def brute_pairs(texts, t=0.8):
    sets = {}
    for x in {x for x in texts if x is not None}:
        w = words(x.encode())
        n = min(5, len(w))
        sets[x] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12]


def brute_links(texts, t=0.8):
    return collections.Counter(x for pair in brute_pairs(texts, t) for x in pair)


def least_of_each(pairs):
    parent = {x: x for e in pairs for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def near_copies(rng):
    base = [prose(rng, 120) for _ in range(12)]
    out = []
    for b in base:
        w = b.split()
        out += [b, b]
        for _ in range(rng.randint(0, 6)):
            v = list(w)
            for _ in range(rng.randint(1, 6)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            out.append(" ".join(v))
        out.append(b.upper() + " !")
    return out


@pytest.mark.parametrize("block", [256, 5])
def test_jaccard_against_brute_force(spark, block):
    rng = random.Random(5)
    texts = near_copies(rng) + odd_texts(rng) + [None]
    docs = with_row_key(documents(spark, texts))
    got = sorted(jaccard.jaccard_join(docs, block=block).collect(), key=lambda r: r[ROW])
    links = brute_links(texts)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t if t is not None else ("null", i), i)
    assert [r["n_links"] for r in got] == [links[t] for t in texts]
    assert [r["text_id"] for r in got] == [first[t if t is not None else ("null", i)] for i, t in enumerate(texts)]
    kept = jaccard.one_of_each_group(documents(spark, texts), block=block)
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    left = [r["text"] for r in kept.collect()]
    assert not brute_links(left) and left.count(None) == 2
    assert {r["class_id"] for r in got} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    least = least_of_each([(first[a], first[b]) for a, b in brute_pairs(texts)])
    assert [r["class_id"] for r in got] == [least.get(r["text_id"], r["text_id"]) for r in got] and len(least) > 30


def test_jaccard_of_many_different_near_copies(spark):
    rng = random.Random(8)
    words_ = prose(rng, 200).split()
    texts = [" ".join([*words_[:k], rng.choice(WORDS), *words_[k + 1 :]]) for k in range(200)] + [prose(rng, 200) for _ in range(20)]
    docs = with_row_key(documents(spark, texts))
    got = sorted(jaccard.jaccard_join(docs, block=16, block_shingles=2000).collect(), key=lambda r: r[ROW])
    links = brute_links(texts)
    assert [r["n_links"] for r in got] == [links[t] for t in texts]
    assert len({r["class_id"] for r in got[:200]}) == 1 and len({r["class_id"] for r in got}) == 21


def test_jaccard_empty_and_null_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f"], [None, 3])
    assert jaccard.one_of_each_group(docs).count() == 1
    assert jaccard.one_of_each_group(docs.where("false")).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    for n in (16, 48, 96):
        m = jaccard.fewest_matches(n, 0.8, 1e-7)
        tail = lambda m, n=n: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(m) >= 1e-7 and (m == 0 or tail(m - 1) < 1e-7)


def test_components(spark):
    rng = random.Random(1)
    path = list(range(300, 600))
    mixed_path = rng.sample(range(700, 900), 200)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + list(itertools.pairwise(path)) + list(itertools.pairwise(mixed_path)) + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = least_of_each([e for e in edges if e[0] != e[1]])
    assert set(got) == set(least)
    roots = collections.defaultdict(set)
    for x, r in got.items():
        roots[least[x]].add(r)
    assert all(len(r) == 1 and least[next(iter(r))] == x for x, r in roots.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


# --- segmentation


@pytest.fixture(scope="module")
def lattices():
    p, b = pieces.load_pieces(pieces.default_model())
    return pieces.Lattices(p, b), pieces.Decoder(p, b)


def test_samples_follow_the_lattice(lattices):
    own, _ = lattices
    atoms = pieces.ATOM.findall("▁then,▁ab")
    own.add(atoms)
    nodes = np.array([own.start[a] for a in atoms])

    def paths(n):
        if n < 0:
            return [((), 1.0)]
        return [((e, *rest), own.share[e] * p) for e in own.others(int(own.first[n]), set()) for rest, p in paths(int(own.goal[e]))]

    every = {sum((x[0] for x in combo), ()): math.prod(x[1] for x in combo) for combo in itertools.product(*(paths(int(n)) for n in nodes))}
    assert sum(every.values()) == pytest.approx(1)
    trials = 4000
    first, second = collections.Counter(), collections.Counter()
    for found, cut in pieces.top_segmentations(own, [nodes] * trials, np.arange(trials, dtype=np.uint64) * np.uint64(7919), 3):
        keys = [tuple(f.edges.tolist()) for f in found]
        assert len(set(keys)) == 3 and found[0].value >= found[1].value >= found[2].value >= cut
        assert all(math.log(every[k]) == pytest.approx(f.log_prob) for k, f in zip(keys, found, strict=True))
        first[keys[0]] += 1
        second[keys[1]] += 1
    follow = collections.Counter()
    for a, b in itertools.permutations(every, 2):
        follow[b] += every[a] * every[b] / (1 - every[a])
    for k in every:
        assert first[k] / trials == pytest.approx(every[k], abs=0.03)
        assert second[k] / trials == pytest.approx(follow[k], abs=0.03)


def test_all_segmentations_are_found_and_no_more(lattices):
    own, _ = lattices
    own.add(["▁an"])
    found, cut = pieces.top_segmentations(own, [np.array([own.start["▁an"]])], np.array([3], np.uint64), 100)[0]
    assert cut == -math.inf and sum(math.exp(f.log_prob) for f in found) == pytest.approx(1)


def test_round_trips_and_odd_rows(spark):
    rng = random.Random(3)
    texts = odd_texts(rng) + ["two  spaces\n\nlines\t", " lead", "trail ", "é ² x² 1.2²."]
    docs = documents(spark, texts, [None, *range(1, len(texts))]).withColumnRenamed("extra", "samples")
    got = pieces.sample_segmentations(docs, k=3)
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = r["samples"]
        assert all(x["round_trip"] for x in s)
        assert len({tuple(x["pieces"]) for x in s}) == len(s) and (len(s) == 3 or len(r["text"] or "") < 8)
        assert all(0 <= x["inclusion"] <= 1 for x in s) and [x["perturbed"] for x in s] == sorted((x["perturbed"] for x in s), reverse=True)
    again = {r["doc_id"]: r["samples"] for r in pieces.sample_segmentations(docs.repartition(3), k=3).collect()}
    for r in rows:
        for x, y in zip(r["samples"], again[r["doc_id"]], strict=True):
            assert x["pieces"] == y["pieces"] and x["perturbed"] == pytest.approx(y["perturbed"]) and x["log_prob"] == pytest.approx(y["log_prob"])
    back = pieces.decode_pieces(got.select("text", F.explode("samples").alias("s")).select("text", "s.pieces"))
    assert back.where("coalesce(text, '') <> decoded").count() == 0
    assert pieces.sample_segmentations(docs.where("false")).count() == 0


# --- benchmark passages


def brute_hits(text, items):
    w = words((text or "").encode())
    hit, found = set(), set()
    for i, body in items:
        iw = words((body or "").encode())
        m = min(10, len(iw))
        for s in range(len(iw) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == iw[s : s + m]:
                    hit.update(range(p, p + m))
                    found.add(i)
    return len(w), len(hit), found


def test_contamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 40, 12, 10, 9, 5, 3, 1, 0])] + [(20, None), (21, ""), (2, prose(rng, 30))]
    items.append((30, items[0][1]))
    texts = odd_texts(rng)[:6] + [prose(rng, 100) for _ in range(5)]
    for _, body in items:
        if body:
            part = body.split()
            cut = part[rng.randrange(max(1, len(part) - 15)) :]
            texts += [f"{prose(rng, 8)} {body.upper()}! {prose(rng, 8)}", f"{prose(rng, 3)} {', '.join(cut)}", " ".join(part[:9])]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"], r["extra"]) == (n, hit, len(found), hit > 0, 7)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    clean = decontamination.contamination(docs, bench.where("false"))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(texts)
    assert decontamination.contamination(docs.where("false"), bench).count() == 0


# --- licenses


def test_licenses(spark):
    rng = random.Random(7)
    t = licenses.TEMPLATES
    broken = t["mit-permission"].split()
    broken[30] = "altered"
    texts = [*odd_texts(rng)[:6], "x " * 300 + t["apache-2.0-header"] + " y" * 50, prose(rng, 40) + "\n" + t["mit-notice"], "#" + "\n# ".join(t["gpl-header"].split()), " ".join(broken), " ".join(t["mit-permission"].split()[:35])]
    docs = documents(spark, texts).withColumnRenamed("extra", "matches")
    got = {r["doc_id"]: {m["name"] for m in r["matches"]} for r in licenses.scan_licenses(docs).collect()}
    split = lambda x: [w.decode() for w in words((x or "").encode())]
    grams = lambda x: {tuple(w[i : i + 5]) for w in [split(x)] for i in range(len(w) - 4)}
    for i, x in enumerate(texts):
        assert got[i] == {k for k, v in t.items() if len(grams(v) & grams(x)) >= 0.8 * len(grams(v))}
    assert licenses.scan_licenses(docs.where("false")).count() == 0
    assert all(not r["matches"] for r in licenses.scan_licenses(docs, {"short": "two words"}).collect())


def test_damaged_full_licenses_are_found(spark):
    rng = random.Random(17)
    grams = lambda x: {tuple(w[i : i + 5]) for w in [words(x.encode())] for i in range(len(w) - 4)}
    texts, wanted = [], []
    for name, body in licenses.TEMPLATES.items():
        for share in (0, 0.01, 0.02, 0.04):
            w = body.split()
            for k in range(len(w)):
                if rng.random() < share:
                    w[k] = rng.choice(WORDS)
            texts.append(f"{prose(rng, rng.randint(5, 300))} {' '.join(w)} {prose(rng, 60)}")
            wanted.append(len(grams(texts[-1]) & grams(body)) >= 0.8 * len(grams(body)))
    got = {r["doc_id"]: {m["name"] for m in r["matches"]} for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    names = [n for n in licenses.TEMPLATES for _ in range(4)]
    assert [names[i] in got[i] for i in range(len(texts))] == wanted and sum(wanted) > 100


def test_license_bands_collide_with_high_probability():
    # a template just over half its class, at the least containment, in the widest window
    worst = min((0.8 * n) / (1.5 * m + n - 0.8 * n) for m in (1, 2, 4, 8, 64) for n in (m // 2 + 1,))
    assert 1 - (1 - worst) ** licenses.BANDS > 0.999


# --- shards


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("bits", [(2, 1), (12, 6)])
def test_minimax_cuts_against_brute_force(spark, bits):
    rng = random.Random(8)
    for groups, shards in ((200, 7), (30, 12), (5, 9), (1, 3)):
        h = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(groups)})
        sizes = [rng.randint(16, 3000) for _ in h]
        df = spark.createDataFrame([(a, b) for a, b in zip(h, sizes, strict=True)], "h long, size long")
        capacity, cuts = sharding.minimax_cuts(df, shards, *bits)
        assert capacity == max(least_capacity(sizes, shards), -(-sum(sizes) // shards))
        loads = collections.Counter()
        for a, b in zip(h, sizes, strict=True):
            loads[sum(c is not None and a >= c for c in cuts)] += b
        assert max(loads.values()) <= capacity and len(cuts) <= shards - 1


@pytest.mark.parametrize(("sizes", "shards"), [([30, 1, 30, 1], 3), ([5000, 20] * 25, 40), ([20] * 300 + [600_000] * 39, 40), ([600_000, 20, 20] * 30, 40), ([7, 600_000], 5)])
def test_heavy_groups_are_atoms_of_one_search(spark, sizes, shards):
    """However many groups are heavier than an even share, shards stay in range and as light as can be."""
    rng = random.Random(len(sizes))
    for order in (sizes, rng.sample(sizes, len(sizes))):
        h = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in order})
        df = spark.createDataFrame(list(zip(h, order, strict=True)), "h long, size long")
        capacity, cuts = sharding.minimax_cuts(df, shards, 4, 3)
        shard = [sum(a >= c for c in cuts) for a in h]
        assert shard == sorted(shard) and set(shard) == set(range(len(cuts) + 1)) and len(cuts) < shards
        loads = collections.Counter()
        for b, k in zip(order, shard, strict=True):
            loads[k] += b
        assert capacity == max(least_capacity(order, shards), -(-sum(order) // shards)) and max(loads.values()) <= capacity


@pytest.mark.parametrize("heavy", [25, 39])
def test_shards_of_huge_texts_between_small_ones(spark, heavy):
    rng = random.Random(heavy)
    texts = [f"{k} " * 400_000 for k in range(heavy)] + [prose(rng, rng.randint(1, 9)) for _ in range(200)] + ["copy"] * 50
    got = sharding.shard_documents(documents(spark, texts), 40, cells=4).select("doc_id", "size", "shard", "slot").collect()
    by_hash = {r["doc_id"]: r["h"] for r in documents(spark, texts).select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert len(got) == len(texts) and {r["shard"] for r in got} <= set(range(40))
    groups, loads, slots = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in got:
        groups[by_hash[r["doc_id"]]] += r["size"]
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    in_order = sorted(got, key=lambda r: by_hash[r["doc_id"]])
    assert [r["shard"] for r in in_order] == sorted(r["shard"] for r in got)  # contiguous
    sizes = [groups[k] for k in sorted(groups)]
    assert max(loads.values()) <= max(least_capacity(sizes, 40), -(-sum(sizes) // 40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards(spark):
    rng = random.Random(9)
    hot = prose(rng, 90)
    texts = odd_texts(rng) + [prose(rng, rng.randint(1, 90)) for _ in range(200)] + [hot] * 120 + [None, None]
    ids = [None, None, *range(2, len(texts))]
    got = sharding.shard_documents(documents(spark, texts, ids), 8, cells=4).collect()
    assert len(got) == len(texts)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and set(shards) <= set(range(8))
    by_crc = collections.defaultdict(set)
    for r in got:
        if r["size"] > 16:
            by_crc[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for v in by_crc.values())
    own = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in zip(ids[2:], texts[2:], strict=True):
        raw = (t or "").encode()
        assert (own[i]["size"], own[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert sharding.shard_documents(documents(spark, texts).where("false"), 8).count() == 0


# --- quality


def test_quality_tells_junk_and_takes_odd_rows(spark):
    rng = random.Random(10)
    good = [prose(rng, 80).replace("w1", "W1") + "." for _ in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(60)]
    texts = good + junk + odd_texts(rng)
    docs = documents(spark, texts, [*range(len(texts) - 1), None]).withColumnRenamed("extra", "score")
    labels = spark.createDataFrame([(i, 1 if i < 120 else 0) for i in range(180) if i % 3] + [(1, 1), (5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    voters = quality.fit_voters(docs, labels, most_labelled=100)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, voters).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == (1 if i < 120 else 0) for i in range(0, 180, 3))
    assert quality.score_quality(docs.where("false"), voters).count() == 0


def test_quality_cosines_are_exact_votes():
    rng = np.random.default_rng(1)
    v = quality.Voters(np.ones(quality.TERMS, np.float32), rng.normal(size=(quality.TERMS, 6)).astype(np.float32), np.zeros((0, 6), np.float32), rng.integers(0, 2, 40), (1.0, 2.0), 5, 3.0)
    known = rng.random((40, quality.TERMS)).astype(np.float32)
    v.vectors = v.latent(known)
    asked = rng.random((7, quality.TERMS)).astype(np.float32)
    prior = 2.0 * v.labels.sum() / (2.0 * v.labels.sum() + (v.labels == 0).sum())
    for x, s in zip(v.latent(asked), v.scores(asked), strict=True):
        near = sorted(((float(x @ y), int(c)) for y, c in zip(v.vectors, v.labels, strict=True)), reverse=True)[:5]
        pull = [(max(a, 0) ** 3 * (2.0 if c else 1.0), c) for a, c in near]
        assert s == pytest.approx((sum(p for p, c in pull if c) + 1e-6 * prior) / (sum(p for p, _ in pull) + 1e-6), rel=1e-4)


def test_quality_without_labels(spark):
    docs = documents(spark, ["a b c", None])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.fit_voters(docs, labels)).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]


# --- top k


def brute_topk(rows, k):
    out = {}
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_topk_against_brute_force(spark):
    rng = random.Random(11)
    vec = lambda: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(8)]
    rows = [(i, vec()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2020, []), (2040, [None] * 8), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [0.0] * 8), (None, vec()), (2120, vec()[:3]), (2121, vec()[:3])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want = brute_topk(rows, 20)
    for block in (16384, 50):
        got = collections.defaultdict(list)
        for r in sorted(topk.exact_topk(df, item_block=block, query_block=block).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert dict(got) == {q: v for q, v in want.items() if v}
    assert topk.exact_topk(df.where("false")).count() == 0


def test_topk_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 1.0]), (20, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.exact_topk(df, k=2).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1), (20, 1, 0), (20, 2, 0)]  # each row is a query, and a candidate of the other


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(3)
    items = np.floor(rng.pareto(1.5, (5000, 4)) * 64)
    queries = np.floor(rng.random((5, 4)) * 64)
    scores, where, scored = topk.threshold_topk(queries, np.full(5, -1), items, 10)
    assert scored < 5 * 5000 * 0.5
    for q, s in zip(queries, scores, strict=True):
        assert s.tolist() == sorted((items @ q).astype(int).tolist(), reverse=True)[:10]
