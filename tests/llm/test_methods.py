"""The operators against brute force where size, markup, history or another parameter might have changed what they do."""

import hashlib
import json
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from pagewatch.llm import byte_bpe, chat, licenses, quality, queries, substring, vectors, word_ids, wrappers

LONG = "and so on for many more words than any menu has, " * 3


def host_texts(spark, pages, inferred=True):
    """The text of each page as pages of one host, or each by itself."""
    if not inferred:
        return [wrappers.main_text(x, None) for x in pages]
    df = spark.createDataFrame([(k, "https://a.example/x", x) for k, x in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in wrappers.extract_main_text(df).orderBy("page_id").collect()]


# 1


def test_threshold_against_every_cut():
    rng = random.Random(1)
    for _ in range(200):
        good, bad = ([rng.randrange(12) / 2 for _ in range(rng.randrange(1, 9))] for _ in range(2))
        cut = quality.threshold(np.array(good), np.array(bad))
        rate = lambda c: sum(x < c for x in bad) / len(bad) - sum(x < c for x in good) / len(good)  # noqa: E731, B023
        assert rate(cut) == pytest.approx(max(rate(c) for c in [*good, *bad, -1]))


def test_kept_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["the", "old", "man", "sea", "sun", "boat"] if k % 2 else ["buy", "now", "cheap", "pills", "win", "man"], k=60 + k))) for k in range(40)]
    rows += [(40, None), (41, ""), (41, "short text"), (3, "the old man"), (None, " ".join(["sea sun boat"] * 30))]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 40, 1)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = quality.fit(docs, labels)
    assert np.isfinite(model.threshold)
    want = Counter()
    for i, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = quality.hashed([[w.encode() for w in own]])[0]
        grams = [int(x) % quality.BUCKETS for x in quality.mix(h)] + [int(x) % quality.BUCKETS for x in quality.mix(h[:-1] * quality.P1 + h[1:])]
        mean = sum(int(model.weights[g]) for g in grams) / len(grams) if grams else 0.0
        windows = Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
        covered = {k + j for k in range(len(own) - 2) if windows[tuple(own[k : k + 3])] > 1 for j in range(3)}
        failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
        want[i, len(own), failed, not failed and mean >= model.threshold] += 1
    assert Counter(tuple(r) for r in quality.quality_rules(docs, model).select("doc_id", "n_words", "base_failed", "kept").collect()) == want


# 2 and 9: a pattern and a tokenizer that the quick ways aren't made for


def test_other_pattern():
    other = byte_bpe.ByteBpe(queries.BYTE_RANKS, "[A-Za-z]|[^A-Za-z]")
    for text in ("Hello, world 12", "naïve  café\n", "a"):
        want = other.tokenizer.encode(text, add_special_tokens=False).ids
        assert other.encode(text).tolist() == want
        assert other.decode(other.encode(text)) == text.encode()
    assert len(other.encode("Hello")) == 5 > len(byte_bpe.ByteBpe(queries.BYTE_RANKS, P.PATTERN).encode("Hello"))


def test_other_tokenizer(tmp_path):
    with open(queries.WORD_BPE, encoding="utf-8") as file:
        spec = json.load(file)
    assert word_ids.takes_words(spec)
    for change in (lambda s: s.update(normalizer=None), lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(pattern={"Regex": r"\S"}), lambda s: s["normalizer"]["normalizers"].append({"type": "NFKD"})):
        own = json.loads(json.dumps(spec))
        change(own)
        assert not word_ids.takes_words(own)
    words = Tokenizer(models.WordLevel({"a b": 0, "?": 1}, unk_token="?"))
    words.pre_tokenizer = pre_tokenizers.Split(Regex(r"\n"), "removed")
    words.save(str(tmp_path / "t.json"))
    ids = word_ids.WordIds(str(tmp_path / "t.json"))
    assert np.frombuffer(ids.encode("a b\na b\nc"), "<u4").tolist() == [0, 0, 1]


def test_odd_texts_have_the_tokenizers_ids():
    t = Tokenizer.from_file(queries.WORD_BPE)
    ids = word_ids.WordIds.get(queries.WORD_BPE)
    rng = random.Random(5)
    parts = ["It's", "we'll", "'s", "x1y22", "ÀÉß", "ł", "“q”", "<|endoftext|>", "<|", "é", " ", "\x1c", " ", "--'s", "''", "a" * 150, "日本", "\n", "\t", "  "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(400)]
    got = ids.encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# 4


def test_containers_with_unlucky_names_keep_the_article(spark):
    for frame in ('<div class="layout has-sidebar"><article>{}</article></div>', '<main class="with-sidebar">{}</main>', '<div id="search-results-page"><div class="y">{}</div></div>', '<div class="sidebar">{}</div>', '<form id="all"><div>{}</div></form>'):
        pages = [f"<body>{frame.format(f'<h1>Title {k}</h1><p>Hello {k} {LONG}</p>')}<footer>f</footer></body>" for k in range(4)]
        want = [f"Title {k}\nHello {k} {LONG.strip()}" for k in range(4)]
        assert host_texts(spark, pages) == host_texts(spark, pages, inferred=False) == want, frame


def test_names_inside_an_article():
    page = f'<article><p class="share-price">Up 3</p><p class="notice-board">On the board</p><p>{LONG}</p><div class="share-buttons">Share</div><p class="ad">Buy</p></article>'
    assert wrappers.main_text(page, None) == f"Up 3\nOn the board\n{LONG.strip()}"


@pytest.mark.parametrize("n", [2, 19, 20, 40])
def test_neutral_markup_by_what_varies(spark, n):
    """Menus and imprints that all pages have go at every number of pages; without wrappers they can't be told."""
    framed = [f'<body><div class="c1"><ul><li>Home</li><li>News</li></ul></div><div class="c2"><h1>Title {k}</h1><p>Text {k} {LONG}</p></div><div class="c3"><p>Imprint of the house</p></div></body>' for k in range(n)]
    flat = [f"<body><ul><li>Home</li><li>News</li></ul><h1>Title {k}</h1><p>Text {k} {LONG}</p><p>Imprint of the house</p></body>" for k in range(n)]
    bare = [f"<body><div><ul><li>Home</li><li>News</li></ul></div><div><h1>Title {k}</h1><div>Text {k} {LONG}</div></div><div>Imprint of the house</div></body>" for k in range(n)]
    want = [f"Title {k}\nText {k} {LONG.strip()}" for k in range(n)]
    for pages in (framed, flat, bare):
        assert host_texts(spark, pages) == want
    assert host_texts(spark, flat, inferred=False) != want


def test_near_copies_on_a_small_host_keep_their_text(spark):
    pages = [f'<body><div class="t"><h1>Title</h1><p>{LONG}</p><p>Only the last line differs: {k}</p></div></body>' for k in range(3)]
    assert host_texts(spark, pages) == [f"Title\n{LONG.strip()}\nOnly the last line differs: {k}" for k in range(3)]


def test_expression_tells_constants_and_slots():
    one, two = (wrappers.page_wrapper(f"<div><h2>Menu</h2></div><p>Text {k}</p>{'<p>more</p>' * k}") for k in (1, 2))
    assert wrappers.expression(wrappers.resolve(wrappers.align(one, two))) == "<div>h2><h2>=</></>(<p>#</>)+".replace("<div>h2>", "<div>h2>")


def test_broken_pages_take_linear_time():
    for part in ("<a ", '<a href="', "</script <script>", "<a b='>", "<p =\"' ", "<!--", "<div>", "<p><div class=x>", "<table><tr><td>"):
        times = []
        for n in (20_000, 160_000):
            began = time.perf_counter()
            wrappers.main_text("<p>x</p>" + part * n, None)
            times.append(time.perf_counter() - began)
        assert times[1] < 24 * times[0] + 0.5, (part, times)
    page = "<article><p>Before</p>" + "<a " * 350_000
    assert wrappers.main_text(page, None) == "Before"


def test_deep_menus_are_no_text():
    page = "<article><p>Text</p>" + "<div>" * 300 + "<nav>menu</nav>inner" + "</div>" * 300 + "</article>"
    assert wrappers.main_text(page, None) == "Text\ninner"


class Plain:
    """Another reader of pages, for well-formed ones: blocks of the article, by the standard library's parser."""

    BLOCKS = frozenset("p h1 h2 h3 li div section blockquote td pre".split())

    def read(self, page):
        from html.parser import HTMLParser

        out, run, state = [], [], {"in": 0, "off": 0}

        def end():
            if text := " ".join("".join(run).split()):
                out.append(text)
            run.clear()

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag == "article":
                    state["in"] += 1
                elif tag in ("nav", "aside", "footer", "script", "style", "form") or dict(attrs).get("class") in ("ad", "comments"):
                    state["off"] += tag not in ("br",)
                if tag in Plain.BLOCKS or tag == "article":
                    end()
                if tag == "br" and state["in"] and not state["off"]:
                    run.append(" ")

            def handle_endtag(self, tag):
                if tag in Plain.BLOCKS or tag == "article":
                    end()
                if tag == "article":
                    state["in"] -= 1
                elif tag in ("nav", "aside", "footer", "script", "style", "form") or tag == "section" and state["off"]:
                    state["off"] -= 1

            def handle_data(self, data):
                if state["in"] and not state["off"]:
                    run.append(data)

        reader = Reader(convert_charrefs=True)
        reader.feed(page)
        reader.close()
        end()
        return "\n".join(out)


def test_pages_against_another_parser(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["one", "two", "&amp;", "caf&eacute;", "&lt;x&gt;", "<b>bold</b>", "<a href='/u?a=1&amp;b=2'>link</a>", "  ", "\n"])
    text = lambda: " ".join(word() for _ in range(rng.randrange(1, 30))) + " end"
    pages = []
    for k in range(60):
        inner = "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li><li>x</li></ul>", "<blockquote>{}<br>y</blockquote>", "<section class='comments'>{}</section>", "<aside>{}</aside>", "<pre>{}</pre>"]).format(text()) for _ in range(rng.randrange(1, 12)))
        pages.append(f"<html><head><title>{k}</title><style>p{{}}</style></head><body><nav><ul><li>{text()}</li></ul></nav><article><h1>Title {k}</h1><p>{text()}</p>{inner}</article><footer>{text()}</footer></body></html>")
    assert host_texts(spark, pages) == [Plain().read(x) for x in pages]


# 5


def test_many_equal_rows_take_linear_time(spark):
    text = " ".join(f"w{k}" for k in range(2000))

    def took(n):
        df = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
        began = time.perf_counter()
        rows = substring.remove_repeats(df).groupBy("n_words", "n_removed").count().collect()
        assert [tuple(r) for r in rows] == [(2000, 2000, n)]
        return time.perf_counter() - began

    took(50)
    small, large = took(200), took(1600)
    assert large < 16 * small, (small, large)


def test_the_last_round_finds_most_windows():
    rng = random.Random(3)
    lists = [[str(rng.randrange(3000)).encode() for _ in range(500)] for _ in range(40)]
    words, starts = substring.hashed(lists)
    *_, lo, hi, _, kind, _ = substring.anchors(words, starts, 35)
    windows = np.bincount(kind + 2, weights=hi - lo + 1)
    assert substring.levels(35) == [1, 2, 4] and windows[-1] / windows.sum() > 0.95


def test_runs_of_one_word(spark):
    """Runs just as long as a window, longer ones, and one that ends a document as the next begins."""
    texts = ["x " + "a " * 35 + "y", "b " * 35, "b " * 36, "c " * 35, "d " * 80 + "e", "e " * 36 + "d " * 34, "f " * 34 + "g", "a " * 35]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect()}
    assert got == {0: (37, 35), 1: (35, 35), 2: (36, 36), 3: (35, 0), 4: (81, 80), 5: (70, 36), 6: (35, 0), 7: (35, 35)}


# 6


def test_recall_with_many_key_bits(spark):
    """Tables as planned for ten million vectors: 16 bits a key."""
    assert vectors.plan(10_000_000, 0.95)[0] == 16
    rng = np.random.default_rng(6)
    base = rng.standard_normal((500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((500, 64))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.95, 0.97, (500, 1))
    near = base * cosine + off * np.sqrt(1 - cosine**2)
    x = np.concatenate([base, near])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = vectors.embedding_groups(df, rows=10_000_000).toPandas().set_index("vec_id").n_links
    want = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    assert (got.loc[range(1000)].to_numpy() <= want).all()
    assert got.sum() >= 0.95 * want.sum() > 900


def test_dense_group_counts_every_link(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    x = base + rng.standard_normal((6000, 64)) * 0.02
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = vectors.embedding_groups(df).toPandas()
    assert (got.n_links == 5999).all() and (got.component_id == 0).all() and got.kept.sum() == 1


# 7


def test_a_late_rewrite_and_numbered_turns(spark):
    def late(turns):
        return "".join(f"[{'' if k == 0 and len(turns) > 70 else x}]" for k, (_, x) in enumerate(turns))

    def numbered(turns):
        return "".join(f"<{k}:{x}>" for k, (_, x) in enumerate(turns))

    df = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(150)], "conv_id long, turn long, role string, text string").repartition(2)
    out = chat.format_conversations(df, render=late, read=lambda s: ("user", s), mask=lambda s: (0, len(s)))
    assert out.where("rewrites").agg(F.min("seq")).first()[0] == 70
    out = chat.format_conversations(df, render=numbered, read=lambda s: ("user", s), mask=lambda s: (0, len(s))).orderBy("seq").collect()
    assert [r["span"] for r in out] == [f"<{k}:t{k}>" for k in range(150)]


def test_digests_by_the_templates_own_rules(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a\\nb")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df, render=lambda turns: "".join(f"[{x}]" for _, x in turns), read=lambda s: ("assistant", s[1:-1]), mask=lambda s: (1, len(s) - 1))
    assert chat.conversation_digests(out, plain=lambda s: s).first()["loss_sha256"] == hashlib.sha256(b"a\\nb").hexdigest()


def test_nested_groups_stay_within_the_stack():
    def nest(depth, twice):
        inner = "x" if not depth else nest(depth - 1, twice)
        return f"<h3>a</h3><div class=d>{inner}</div>" + "<h3>b</h3><div class=d>c</div>" * twice

    own = wrappers.align(wrappers.page_wrapper(nest(300, 0)), wrappers.page_wrapper(nest(300, 1)))
    # Repeats aren't gone down into: the main part is all of the page.
    assert wrappers.reading(own)["main"] == "" and "(<div.d>((<h3>=</>)?(<div.d>" in wrappers.expression(wrappers.resolve(own))
    assert json.loads(json.dumps(own)) == own


def nested(k, n):
    """An article and other stories, neutrally named, inside n plain divs."""
    inner = f"<article><h1>Title {k}</h1><p>Body {k} is long enough to be the main part of this page, {k * 7}.</p></article><div class='c9'><p>Other story {k}</p><p>More {k * 3}</p></div>"
    return f"<html><body>{'<div>' * n}{inner}{'</div>' * n}</body></html>"


@pytest.mark.parametrize("n", [5, 98, 99, 120, 1000, 12_000])
def test_no_depth_is_special(n):
    held = wrappers._Wrappers()
    for k in range(5):
        held.add_page(nested(k, n))
    again = wrappers._Wrappers()
    again.add_json(held.to_json())
    how = wrappers.reading(wrappers.from_flat(json.loads(again.to_json())["wrapper"]))
    assert how["article"]
    for k in range(5):
        want = f"Title {k}\nBody {k} is long enough to be the main part of this page, {k * 7}."
        assert wrappers.main_text(nested(k, n), how) == wrappers.main_text(nested(k, n), None) == want
    assert wrappers.expression(wrappers.resolve(again.stack[0][1])).count("<div") == n + 1


def test_wrappers_as_lists():
    own = wrappers.align(*(wrappers.page_wrapper(f"<div><h2>Menu</h2></div><p>Text {k}</p>{'<p>more</p>' * k}<ul><li>a<li>b</ul>") for k in (1, 2)))
    assert wrappers.from_flat(json.loads(json.dumps(wrappers.flat(own)))) == own


def test_near_dedup_of_repeated_ids(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(300)]
    t, u, v = (" ".join(words[a : a + 90]) for a in (0, 100, 200))
    near = t + " and one more word"
    rows = [(3, t), (5, u), (5, t), (7, v), (7, v), (9, near), (9, u), (5, u), (None, v), (None, "all alone here"), (None, "all alone here"), (11, None), (12, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("3", t), ("5", u), ("7", v), ("None", "all alone here"), ("11", None)])


def test_near_dedup_of_an_id_with_groups_of_its_own(spark):
    import corpus_pipeline

    t, u = (" ".join(f"{c}{k}" for k in range(90)) for c in "ab")
    docs = spark.createDataFrame([(5, x, None, None, 1) for x in (t, u, t, u)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted([t, u])


def test_a_window_that_is_too_small_is_an_error():
    numbered = lambda turns: "".join(f"[{k}:{r}]{t}\n" for k, (r, t) in enumerate(turns))
    forgets = lambda turns: "".join(f"<{r}>{t}\n" for r, t in turns) if len(turns) < 8 else "short"
    last_two = lambda turns: "".join(f"<{r}|{turns[k - 1][0] if k else ''}>{t}\n" for k, (r, t) in enumerate(turns))
    turns = [(f"r{k}", f"t{k}") for k in range(40)]
    for render, window, fits in ((chat.chatml, 4, True), (last_two, 4, True), (numbered, 8, False), (forgets, 7, False)):
        spans = chat.Spans(render, window)
        if fits:
            assert "".join(spans.add(t) for t in turns) == render(turns) and not spans.rewrites
        else:
            with pytest.raises(ValueError, match="looks back further"):
                for t in turns:
                    spans.add(t)


def test_whole_licenses_of_a_table(spark, monkeypatch):
    rng = random.Random(13)
    license_ = lambda k: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(900 + 300 * k))
    texts = {f"L{k}": license_(k) for k in range(6)}
    table = spark.createDataFrame([*texts.items(), ("L1", "zzz"), (None, "x"), ("none", None)], "template string, text string")
    altered = texts["L3"].split()
    altered[::40] = ["changed"] * len(altered[::40])  # each takes five shingles: seven of eight stay
    docs = [(1, f"before {texts['L2']} after"), (2, " ".join(altered)), (3, texts["L4"][: len(texts["L4"]) // 2]), (4, texts["L0"].upper() + texts["L5"]), (5, None)]
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert sorted((r["doc_id"], r["template"], r["containment"] > 0.99) for r in got) == [(1, "L2", True), (2, "L3", False), (4, "L0", True), (4, "L5", True)]
    monkeypatch.setattr(licenses, "MAX_TEMPLATES", 3)
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()


def _grammar(node):
    """A wrapper as a regular expression over tokens that end in a NUL."""
    own = "".join(map(_grammar, node[wrappers.PARTS]))
    if node[wrappers.KEY] == wrappers.SLOT:
        own = "#\0"
    elif node[wrappers.KEY] not in ("", wrappers.GROUP):
        own = re.escape(f"<{node[wrappers.KEY]}\0") + own + "/\0"
    optional, repeated = node[wrappers.OPTIONAL], node[wrappers.REPEATED]
    return f"(?:{own})" + ("*" if optional and repeated else "?" if optional else "+" if repeated else "")


def _tokens(page):
    out = []
    for event in wrappers._parse(page):
        token = f"<{event[1]}\0" if event[0] == "open" else "/\0" if event[0] == "close" else "#\0" if event[1].strip() else ""
        if token and (token != "#\0" or not out or out[-1] != token):
            out.append(token)
    return "".join(out)


def test_wrappers_generate_their_pages():
    one, two = "<p>one</p><ul><li>a</ul><h2>t</h2>", "<h2>t</h2><ul><li>a</ul><p>two</p>"
    own = wrappers.align(wrappers.page_wrapper(one), wrappers.page_wrapper(two))
    assert all(re.fullmatch(_grammar(x), _tokens(page)) for x in (own, wrappers.resolve(own)) for page in (one, two))
    # A third page that has one of the two orders makes the wrapper no longer.
    assert wrappers._count(wrappers.align(own, wrappers.page_wrapper(one))) == wrappers._count(own)
    rng = random.Random(6)
    blocks = ["<p>{}</p>", "<p>{}<p>more", "<ul><li>{}<li>b</ul>", "<h2>{}</h2>", "<div class=x>{}</div>", "<section><h2>t</h2><p>{}</section>", "{}", "<hr>"]
    for _ in range(300):
        pages = ["".join(x.format(rng.choice("abc")) for x in rng.choices(blocks, k=rng.randrange(1, 6))) for _ in range(rng.randrange(2, 5))]
        own = wrappers.page_wrapper(pages[0])
        for page in pages[1:]:
            own = wrappers.align(own, wrappers.page_wrapper(page))
        for x in (own, wrappers.resolve(own)):
            for page in pages:
                assert re.fullmatch(_grammar(x), _tokens(page)), (pages, wrappers.expression(x))


def test_an_article_that_stands_in_two_places_is_found():
    def page(k):
        parts = [f"<article><h1>Story {k}</h1><p>{LONG}{k}</p></article>", f"<div class=teasers>{'<p>Another story %d' % k * (1 + 30 * (k % 3 == 0))}</div>"]
        return f"<body>{''.join(parts if k % 2 else parts[::-1])}</body>"

    pages = [page(k) for k in range(12)]
    assert host_texts(None, pages[:1], inferred=False)[0]
    how = wrappers.page_wrapper(pages[0])
    for x in pages[1:]:
        how = wrappers.align(how, wrappers.page_wrapper(x))
    how = wrappers.reading(how)
    assert [wrappers.main_text(x, how) for x in pages] == [f"Story {k}\n{LONG}{k}" for k in range(12)]
