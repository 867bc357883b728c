"""The other operators on small fixtures, against brute force, round trips or held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, chat, decontam, html, langid, registry, urlfilter

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokens():
    import tiktoken

    ours = bpe.ByteBPE.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return ours, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def test_bpe_equals_the_library(tokens):
    ours, theirs = tokens
    rng = random.Random(7)
    texts = ["", " ", "a" * 5000, "<|endoftext|>", "日本語 テスト", "\x00\x01", "it's we'll", "\u200b🎉" * 9]
    texts += ["".join(rng.choice(["a", "ab", " ", "\n", "é", "12", "!!", "ing", "the", "'s"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        ids = ours.encode(t)
        assert list(ids) == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_compatibility_equals_merging(tokens):
    ours, rng = tokens[0], random.Random(3)
    ids = sorted(ours.whole.values())
    for most in (300, 2000, len(ids)):
        for _ in range(3000):
            a, b = rng.choice(ids[:most]), rng.choice(ids[:most])
            assert ours.compatible(a, b) == (ours._merged(ours.tokens[a] + ours.tokens[b])[0] == [a, b])


def test_bpe_memory_may_be_emptied(tokens, monkeypatch):
    ours, theirs = tokens
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    assert list(ours.encode("several quite different words here")) == theirs.encode_ordinary("several quite different words here")


def test_bpe_over_a_table(docs, rows, tokens):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.encode_documents(docs, path, P.PATTERN, decoded="back")
    assert got.columns == [c for c in docs.columns if c != "token_ids"] + ["token_ids", "back"]
    out = {r["doc_id"]: (r["token_ids"], bytes(r["back"])) for r in got.collect()}
    assert all(out[i][1] == (t or "").encode() and out[i][0] == tokens[1].encode_ordinary(t or "") for i, t in rows)
    assert bpe.token_digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_bytes_that_are_not_utf8(spark):
    import hashlib

    given = {1: b"\xff\xfeok \xe2\x82", 2: b"plain", 3: b"\x80" * 700, 4: b"a\xed\xa0\x80b"}
    df = spark.createDataFrame([(k, v.hex()) for k, v in given.items()], "doc_id bigint, h string").selectExpr("doc_id", "cast(unhex(h) AS string) AS text")
    got = {r["doc_id"]: r for r in bpe.token_digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert all(got[k]["decoded_sha256"] == hashlib.sha256(v).hexdigest() for k, v in given.items())
    assert len(langid.predict(df, langid.Model(langid.Votes([]), {})).collect()) == 4


def test_every_label_is_learned_from_a_bounded_sample(spark, monkeypatch):
    rng = random.Random(4)
    # Seventy labels with letters of their own, one of them on most rows and some on two only.
    letters = {k: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for k in range(70)}
    rows = [(k * 1000 + i, " ".join("".join(rng.choices(letters[k], k=6)) for _ in range(30)), f"l{k:02d}") for k in range(70) for i in range(300 if k == 7 else 2 if k > 60 else 6)]
    drawn = []
    monkeypatch.setattr(langid.Votes, "fit", classmethod(lambda cls, x, y, f=langid.Votes.fit.__func__: (drawn.append(len(x)), f(cls, x, y))[1]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, per_language=40)
    assert model.families.names == [f"l{k:02d}" for k in range(70)]
    assert drawn[0] < 70 * 6 + 80  # the frequent label gave about 40 of its rows
    got = langid.predict(df.where("doc_id % 1000 = 1"), model).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 63


def test_language_of_long_repeated_and_clashing_rows(spark):
    rows = [(i, f"word{i % 7} text {'abc'[i % 3] * 5}", f"l{i % 3}") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    odd = [(1, "bbbbb word1 text " * 20_000), (2, "bbbbb word1 text"), (2, "bbbbb word1 text"), (3, None), (4, "")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string").selectExpr("*", "'x' AS lang_pred", "1 AS score", "'y' AS lang", "'z' AS t")
    got = langid.predict(df, model)
    assert sorted(got.columns) == sorted(df.columns) and got.dtypes[-1] == ("score", "double")
    by = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got.collect())
    assert by[0][1] == by[1][1] == "l1" and by[1] == by[2] and [b[1:] for b in by[3:]] == [("und", 0.0)] * 2
    assert langid.predict(df.limit(0), model).count() == 0


def test_settings_stay_as_they_are(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    bpe.token_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


URLS = [(1, "http://WWW.X.net/en/a?q"), (2, "https://example.net/en/1"), (3, "https://a.example.net/en"), (4, "http://example.com/de/x#y"), (5, "http://notexample.com/de/x"), (6, "ftp://b.org/fr/1"), (7, "no scheme"), (8, None), (9, "http://net"), (10, "http://x.net?a://b.org/fr/"), (11, "http://a.net:80/x"), (11, "http://a.net:80/x"), (12, "://net/"), (13, "")]


def slow_judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    m = min([rest.find(c, n) for c in "?#" if rest.find(c, n) >= 0], default=len(rest))
    path = rest[n:m]
    fits = [(h + p, v) for h, p, v in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("s", F.lit(1))
    rules = spark.createDataFrame([*registry.URL_RULES, ("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect()]
    assert sorted(got, key=str) == sorted(((i, *slow_judge(u)) for i, u in URLS), key=str)
    assert urlfilter.judge(pages, rules.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def test_nearest_finds_most_and_skips_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, [2.0] * 3)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9006, [float("inf")] * 16), (9007, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1))
    got: dict[int, list] = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = np.arange(0, 3001, 20)
    x = np.vstack([x, np.array([2.0] * 3 + [0.0] * 13, np.float32)])  # a shorter vector ends in zeros
    scores = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    hits = 0
    for row, q in zip(scores, asked, strict=True):
        row[q] = -np.inf
        mine = sorted(got[int(q)])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(row[v] - s) < 1e-9 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len(set(np.lexsort((np.arange(3001), -row))[:20].tolist()) & {m[1] for m in mine})
    assert set(got) == set(asked.tolist()) and hits / (20 * len(asked)) >= 0.9


def test_nearest_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])], "vec_id bigint, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 2 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (2, 1, 0, 0.5), (2, 2, 1, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_nearest_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [5.0, 0.0]), (0, [3.0, 0.0]), (7, [1.0, 0.0]), (0, [1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    lists = Counter()
    for r in got:
        lists[r["query_id"], r["rank"], r["vec_id"], r["score"]] += 1
    one = [(1, 1, 5.0), (2, 0, 3.0), (3, 1, 2.0), (4, 0, 1.0), (5, 7, 1.0)]  # of [1, 0], which is there twice
    two = [(1, 1, 15.0), (2, 1, 6.0), (3, 0, 3.0), (4, 0, 3.0), (5, 7, 3.0)]  # of [3, 0]
    assert lists == Counter([(0, *x) for x in one] * 2 + [(0, *x) for x in two])


def test_nearest_ties_go_to_the_smaller_id(spark, monkeypatch):
    def whole(model, *_):
        model.used, model.reach = 1, len(model.quantiles[0]) + 1

    monkeypatch.setattr(ann, "fit", whole)  # all candidates are met, whichever of many equal ones are nearer on a curve
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, float(i % 50), 0.0]) for i in rng.permutation(400).tolist()]
    got: dict[int, list] = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0, k=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, mine in got.items():
        want = sorted((-(1.0 + (q % 50) * (i % 50)), i) for i in range(400) if i != q)[:9]
        assert [(-s, v) for _, v, s in sorted(mine)] == want


def test_nearest_on_clusters_reads_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    models, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda m, *rest: (fit(m, *rest), models.append(m))[0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(got[20 * i] & set(n.tolist())) / 20 for i, n in enumerate(near)]) >= 0.9
    model = models[0]
    assert model.used >= 2 and model.used * (2 * model.reach + 1) < 0.4 * (len(model.quantiles[0]) + 1)


def test_hilbert_neighbours_are_one_step_apart():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, indexing="ij"), axis=-1).reshape(-1, 2)
    order = cells[np.argsort(ann.hilbert_keys(cells, 4))]
    assert sorted(ann.hilbert_keys(cells, 4).tolist()) == list(range(256))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo <|im_end|>"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo <|im_end|>"), (4, 0, None, None), (5, 1, "user", "b"), (5, None, "system", "a"), (None, 0, "user", "x"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("idx", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in chat.render(df).collect()}
    assert got == {
        2: (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo <| im_end|><|im_end|>"),
        4: (1, 1, "<|im_start|>unknown\n<|im_end|>"),
        5: (2, 1, "<|im_start|>system\na<|im_end|>\n<|im_start|>user\nb<|im_end|>"),
    }
    assert chat.render(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="x"><header><a href=/>Home</a></header><nav><ul><li>m</li></ul></nav>
<!-- <p>no</p> --><div class="cookie-notice">We use cookies</div><aside>side</aside><article><h1>Head &amp; line</h1><p>One <b>two
three<p>four<br>five &lt;x&gt;</p><script>var t="</p>";</script><div class="ad">buy</div><form><p>mail</p></form><ul><li>item<li>next</ul></article>
<section id="comments"><article class="comment"><p>reader</p></article></section><footer>foot</footer>"""


def test_html_main_text(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", "<article><p>short</p></article>"), (3, "http://h/3", None), (4, None, ""), (5, "http://m/1", "<main><p>in main</p></main><p>out</p>"), (6, "http://d/1", "<div id=menu>" + "<a>link</a>" * 9 + "</div><div class=c><p>the body of text</p><p>more</p></div><p>x"), (7, "http://t/", "just text"), (8, "http://h/8", "<div id=nav>x</div><div><p>no article here</p></div>"), (1, "http://h/1", PAGE)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()]
    text = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert text[1] == "Head & line\nOne two three\nfour five <x>\nitem\nnext"
    assert (text[2], text[3], text[4], text[5], text[6], text[7]) == ("short", "", "", "in main", "the body of text\nmore", "just text")
    assert text[8] == "no article here"
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_article_parts_with_telling_names():
    kept = ["<h2 id='social-costs'>x</h2>", "<h2 id='Related_work'>x</h2>", "<h2 id='comments-on-method'>x</h2>", "<section id='discussion'>x</section>", "<section id='search-algorithms'>x</section>", "<section id='side-effects'>x</section>", "<div class='entry-header'>x</div>", "<tr class='header'><td>x</td></tr>", "<div id='menu-engineering'>x</div>"]
    gone = ["<div class='ad'>x</div>", "<div class='c AdBox'>x</div>", "<div class='cookie-notice'>x</div>", "<div class='ad-300x250'>x</div>", "<li id='comment-123'>x</li>", "<div id=sidebar-left>x</div>", "<div class='social-share-buttons'>x</div>", "<section id='comments'>x</section>", "<section class='related'>x</section>", "<p class='newsletter'>x</p>"]
    for part in kept + gone:
        assert html.main_text(f"<article><p>a</p>{part}</article>", "article") == ("a\nx" if part in kept else "a"), part


def plain_pages(n, host):
    """Pages whose class names say nothing; the menu is longer than the article."""
    menu = " ".join(f"entry{i}" for i in range(60))
    rng = random.Random(8)
    out = []
    for i in range(n):
        more = f"<p>{rng.random()} more</p>" * (i % 3)
        note = "<p>A line that some pages have</p>" if i % 2 else ""
        out.append((i, f"http://{host}/{i}", f"<div class=q1><ul><li>{menu}<li>log in</ul></div><div class='q2 n{i}'><h1>Title {i}</h1><p>Body {rng.random()}</p>{note}{more}<p>Tell your friends about us</p></div><div class=q3><p>All rights reserved</p></div>"))
    return out


def test_alignment_tells_the_menu_from_the_article(spark):
    kinds = "page_id int, url string, html string"
    pages = plain_pages(14, "a.org")
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, kinds).repartition(5)).collect()}
    # Brute force: what every page says at a place is template; the rest of the group that holds most of it is the text.
    blocks = {i: [(t, path) for kind, t, path in html.blocks(h) if kind == "#"] for i, _, h in pages}
    fixed = set.intersection(*(set(b) for b in blocks.values()))
    assert {t for t, _ in fixed} >= {"log in", "Tell your friends about us", "All rights reserved"}
    assert got == {i: "\n".join(t for t, path in b if (t, path) not in fixed and path.startswith("/div.q2")) for i, b in blocks.items()}
    assert all("A line that some pages have" in got[i] for i in got if i % 2)
    # Alone, nothing but its length speaks for a group.
    alone = html.extract(spark.createDataFrame(pages[:1], kinds)).first()["text"]
    assert alone != got[0] and "entry5" in alone
    # Copies of one article keep their text: nothing tells data from template.
    copies = [(i, f"http://b.org/{i}", f"<article><p>The same article</p><p>again</p></article><p>{i}</p>") for i in range(20)]
    assert {r["text"] for r in html.extract(spark.createDataFrame(copies, kinds)).collect()} == {"The same article\nagain"}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 60])
def test_repeated_headings_stay_in_articles(spark, monkeypatch, n):
    monkeypatch.setattr(html, "GROUP", 4)
    monkeypatch.setattr(html, "FAN", 2)
    rng = random.Random(n)
    body = lambda i: f"<h1>Title {i}</h1><h2>Introduction</h2><p>{rng.random()} one</p><h2>Conclusion</h2><p>{rng.random()} two</p>"
    parts = [(i, body(i)) for i in range(n)]
    around = "<div class=zz><ul><li>a menu without a name<li>log in</ul></div>{}<div class=yy><p>All rights reserved</p></div>"
    rows = [(i, f"http://{host}/{i}", around.format(f"<{tag}>{b}</{tag.split()[0]}>")) for host, tag in (("a.org", "article"), ("b.org", "main"), ("c.org", "div class=q2")) for i, b in parts]
    got = {(r["url"].split("/")[2], r["page_id"]): r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i, b in parts:
        own = "\n".join(re.findall(r">([^<]+)<", b))
        assert got["a.org", i] == got["b.org", i] == own
        assert got["c.org", i] == own or n == 1


def test_no_text_of_an_article_is_lost(spark):
    """Brute force: an article's text is what stands between its tags, in order, whatever other pages say."""
    rng = random.Random(3)
    said = [f"Sentence {k} of them" for k in range(12)]
    rows = []
    for i in range(40):
        blocks = [f"<{t}>{rng.choice(said)}</{t}>" for t in rng.choices(["p", "h2", "blockquote", "h3"], k=rng.randrange(1, 9))]
        rows.append((i, "http://same.org/x", f"<div class=top><p>Site</p></div><article>{''.join(blocks)}</article>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: "\n".join(re.findall(r">(Sentence[^<]+)<", h)) for i, _, h in rows}


def test_wrappers_do_not_depend_on_how_pages_are_stored(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP", 3)
    rows = [(h, p) for host in ("a", "b") for _, h, p in [(0, host, x) for _, _, x in plain_pages(17, host)]]
    df = spark.createDataFrame(rows, "host string, html string")
    one, two = (sorted(map(str, html.wrappers(d).collect())) for d in (df.repartition(1), df.repartition(7, "html")))
    assert one == two and len(one) == 2


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 30_000 + "<p>at the bottom" + "</div>" * 30_000
    wide = "<article>" + "".join(f"<p>p{i}</p><h{i % 5 + 1}>h{i}</h{i % 5 + 1}>" for i in range(3000)) + "</article>"
    stray = "</b></p></x>" * 30_000 + "<article><p>x</article>"
    rows = [(i, "http://h/", t) for i, t in enumerate((deep, wide, stray, deep, "<article><p>y</p></article>"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[0] == got[3] == "at the bottom" and got[2] == "x" and got[4] == "y"
    assert got[1] == "\n".join(f"p{i}\nh{i}" for i in range(3000))


def test_wrapper_alignment():
    a, b = html.expression("<ul><li>1<li>2</ul><p>x</p>"), html.expression("<ul><li>1</ul><h2>t</h2><p>x</p><p>y</p>")
    both = html.align(a, b)
    assert [(g[0], g[1]) for g in both] == [("ul", ""), ("h2", "?"), ("p", "+")]
    assert [len(both[2][2][0][2]), len(both[0][2][0][2][0][2])] == [1, 1]  # "x" and "1" are in both, the rest is a slot
    assert both[0][2][0][:2] == ["li", "+"]
    assert html.align(both, a) == both


def test_decontamination(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(12, 40)))) for k in range(8)] + [(90, None), (91, ""), (92, "two words"), (93, "the the the the the the the the")]
    clean = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(10)]
    leak = lambda k, t: " ".join(rng.choices(vocabulary, k=30)) + "\n" + t + " " + " ".join(rng.choices(vocabulary, k=30))
    edited = items[3][1].split()
    edited[0] = "other"
    bad = [(100 + k, leak(k, t.upper())) for k, t in items[:8]] + [(120, items[0][1]), (121, leak(3, " ".join(edited))), (122, "we said two words here"), (123, " ".join(items[1][1].split()[1:]))]
    odd = [(200, None), (201, ""), (202, "the"), (203, "the " * 500), (120, items[0][1]), (None, items[2][1])]
    d = spark.createDataFrame(clean + bad + odd, "doc_id bigint, text string").withColumn("grams", F.lit(1)).withColumn("size", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("k", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(d, b).collect()}
    assert got == {(100 + k, k) for k in range(8)} | {(120, 0), (121, 3), (122, 92), (123, 1), (203, 93), (None, 2)}
    left = decontam.remove(d, b)
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == sorted([i for i, _ in clean] + [200, 201, 202])
    assert decontam.matches(d, b.limit(0)).count() == 0 and decontam.matches(d.limit(0), b).count() == 0
    assert decontam.remove(d, b.limit(0)).count() == d.count()


def best_windows(words, item):
    """(similarity, start) of the best item-sized window, by looking at every one."""
    k = min(5, len(item))
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    theirs, ours = Counter(grams(item)), grams(words)
    wide, mine, shared, best = len(item) - k + 1, Counter(), 0, (0.0, 0)
    for i, g in enumerate(ours):
        mine[g] += 1
        shared += mine[g] <= theirs[g]
        if i >= wide:
            old = ours[i - wide]
            shared -= mine[old] <= theirs[old]
            mine[old] -= 1
        if i >= wide - 1 or i == len(ours) - 1:
            has = min(wide, i + 1)
            best = max(best, (shared / (has + wide - shared), -max(0, i - wide + 1)))
    return best[0], -best[1]


def test_decontamination_equals_every_window(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: r["text"].lower().split() for r in bench.collect()}
    want = {}
    for r in docs.collect():
        words = (r["text"] or "").lower().split()
        for i, item in items.items():
            similarity, start = best_windows(words, item)
            if similarity >= 0.8:
                want[r["doc_id"], i] = (start, round(similarity, 9))
    for most, power in ((200_000, 25), (0, 25), (0, 8)):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", most)
        monkeypatch.setattr(decontam, "BITMAP", power)
        got = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in decontam.matches(docs, bench).collect()}
        assert got == want and want


def test_decontamination_of_moved_parts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    more = lambda n: rng.choices(vocabulary, k=n)
    items = {k: more(n) for k, n in enumerate((59, 59, 80, 120, 6, 12))}
    texts = {}
    for k, w in items.items():
        half, third = len(w) // 2, len(w) // 3
        texts |= {10 * k: more(40) + w[half:] + w[:half] + more(40), 10 * k + 1: w[half:] + w[:half], 10 * k + 2: more(9) + w[2 * third :] + w[third : 2 * third] + w[:third] + more(3)}
        texts |= {10 * k + 3: more(20) + w[1:], 10 * k + 4: w[3:] + w[:3] + more(7), 10 * k + 5: more(30) + w[: half + 1]}
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, t in texts.items():
        for k, w in items.items():
            at = []
            for s in range(max(1, len(t) - len(w) + 1)):
                a, b = grams(t[s : s + len(w)]), grams(w)
                at.append((-(a & b).total() / (a | b).total(), s))
            if -min(at)[0] >= 0.8:
                want[d, k] = (min(at)[1], round(-min(at)[0], 9))
    assert {(0, 0), (10, 1), (20, 2), (30, 3), (31, 3)} <= set(want)
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], f"{key} bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in decontam.matches(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want


def test_native_simhash_and_similarity(spark):
    grams = [3, 3, 5, -7, 1 << 62]
    df = spark.createDataFrame([(grams, [3, 5, 5]), ([], [1])], "a array<bigint>, b array<bigint>")
    rows = df.select(decontam.simhash("a").alias("f"), decontam.weighted_similarity("a", "b").alias("s")).collect()
    want = sum(1 << b for b in range(64) if 2 * sum((g >> b) & 1 for g in grams) > len(grams))
    assert rows[0]["f"] & (1 << 64) - 1 == want and rows[0]["s"] == 2 / 6 and rows[1]["s"] == 0
    other = df.select(decontam.simhash("a", 1).alias("f"), F.transform("a", lambda g: F.xxhash64(F.lit(1), g)).alias("g")).first()
    assert other["f"] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum((g >> b) & 1 for g in other["g"]) > len(grams))


def test_language_id_held_out(spark, sf):
    got = registry.op9_language_id(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    ids = [r[0] for r in got.where("held_out").select("doc_id").collect()]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_language_id_cases(docs, spark):
    labelled = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr"), (None, "en"), ("x", None)] * 4)], "doc_id bigint, text string, lang string")
    model = langid.fit(labelled)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert out[42] == out[43] == out[44] == out[47] == ("und", 0.0)
    assert out[45][0] in ("en", "de", "fr") and all(0 <= s <= 1 for _, s in out.values())
    assert model.predict("der hund und der hund")[0] == "de"
    nothing = langid.fit(labelled.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.fit(labelled.where("lang = 'en'")).predict("bonjour") == ("en", 1.0)
