"""Toxicity network, main text of pages, and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tapewise.llm import html, toxicity
from tapewise.llm.common import read

SF = "/root/testdata/sf0.01"


def test_words_and_windows():
    texts = [b"", b"One, two's \xc3\xa9t\xc3\xa9!", b"x" * 300, b"one one TWO"]
    words = toxicity.words_of(texts)
    assert words.begins.tolist() == [0, 6, 16, 23, 32]
    own = [words.which[a + 3:b - 3] for a, b in zip(words.begins, words.begins[1:])]
    assert own[1][0] == own[3][0] == own[3][1] and own[3][2] == own[1][1]
    assert [words.sizes[w].tolist() for w in own] == [[], [3, 3, 1, 5], [300], [3, 3, 3]]
    assert (words.sizes[words.which[:6]] == 1).all()
    for n in (0, 6, 7, 63, 64, 65, 112, 113, 1000):
        first, size, text = toxicity.windows_of(np.array([0, n, n]))
        seen = {i for f, s in zip(first.tolist(), size.tolist()) for i in range(f, f + s)}
        assert seen == set(range(n if n > 6 else 0)) and (text == 0).all()
        assert all(b - a <= toxicity.STRIDE for a, b in zip(first, first[1:]))


def test_words_by_slices():
    texts = [b"", b"One, two's \xc3\xa9t\xc3\xa9!", b"x" * 300, b"one one TWO", b"", b"three ets"]
    whole, parts = toxicity.words_of(texts), toxicity.all_words(texts, 5)
    assert whole.begins.tolist() == parts.begins.tolist() and whole.which.tolist() == parts.which.tolist()
    assert whole.hashes.tolist() == parts.hashes.tolist() and whole.grams.tolist() == parts.grams.tolist()


def test_gradients_are_those_of_the_loss():
    words = toxicity.words_of([b"an idiot is here now", b"all good words here", b"x"])
    net = toxicity.Network.new(words.hashes[:3], 5, 4, 3)
    net.p = {k: a.astype(float) for k, a in net.p.items()}
    first, size, _ = toxicity.windows_of(words.begins)
    steps = np.arange(size.max())
    mask, index = steps < size[:, None], words.which[np.minimum(first[:, None] + steps, len(words.which) - 1)]
    numbers, y = net.numbers(words.hashes), np.array([1, 0, 1.0])

    def loss():
        logit, _ = net.forward(net.inputs(numbers, words.sizes, words.grams), index, mask)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    found, rng = net.gradients(numbers, words.sizes, words.grams, index, mask, y), np.random.default_rng(0)
    for name, a in net.p.items():
        flat, g = a.reshape(-1), found[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(g) if name in ("gram", "word") else np.arange(flat.size), 3):
            kept, flat[i] = flat[i], flat[i] + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6 + 1e-4 * abs(g[i]), name


def labelled(seed, n):
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "ke", "lu", "sen", "dar", "o"]
    plain = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randint(20, 250)), i % 4 == 0
        if toxic:       # endings vary: characters have to tell
            for _ in range(3):
                words[rng.randrange(len(words))] = "grub" + "".join(rng.choices(syllables, k=2))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_network_on_held_out_texts(spark):
    rows = labelled(3, 900)
    long = " ".join(t for _, t, y in rows * 3 if not y)
    docs = spark.createDataFrame([(d, t, "x", 1.5) for d, t, _ in rows] + [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (5002, "!? --", "x", 1.0), (None, "ta ri", "x", 1.0),
                                  (5003, long, "x", 1.0), (5004, long + " grubtari lu grubsen", "x", 1.0)],
                                 "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == 906
    held = [(got[d], y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for d, r in got.items() if d is not None and d < 900) == len(held)
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert [got[i].score for i in (5000, 5001, 5002)] == [0, 0, 0]
    assert got[5003].predicted == 0 and got[5004].predicted == 1      # the last window of a long text counts
    nobody = toxicity.judge(docs, labels.limit(0)).collect()
    assert {r.score for r in nobody} == {0.0}
    assert toxicity.judge(docs.limit(0), labels).count() == 0


PAGES = [
    ("<html><body><div class='page-with-sidebar'><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><article><header class='entry-header'><h1>My title</h1></header>"
     "<p>First  para &eacute; with <a href='u'>link</a> text.</p><p><a href=z>Only link</a></p><aside>Related stuff here</aside><div class='comments'><article class='comment'>"
     "<p>Nice post really I like it so much yes</p></article></div><form>Sign up <input name=a></form></article><footer>(c) x</footer></div></body></html>",
     "My title\nFirst para é with link text.\nOnly link"),
    ("<article><p>a < b and 5 > 3 &lt;x&gt; &amp;amp; &am", "a < b and 5 > 3 <x> &amp; &am"),
    ("<article>broken <p title='x>y'>q</p> <a href=\"/abc", "broken\nq"),
    ("<div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><p>Body text that goes on and on with enough words to be seen as the main text of page.</p>"
     "<p>Second paragraph, also with a good number of words in it to read.</p><div>Copyright us</div></div>",
     "Body text that goes on and on with enough words to be seen as the main text of page.\nSecond paragraph, also with a good number of words in it to read."),
    ("<article><p>one<br>two&nbsp;three\n\n four</p><script>if(a<b){'</p>'}</script><p>five<!-- <p>x</p> --></p><style>p{}</style><p>e.</p></article>", "one two three four\nfive\ne."),
    ("<!DOCTYPE html><head><title>T</title><meta charset=x><body><div class=\"ad\">Buy this very good thing now, it is cheap, and everybody else has one already.</div><article>"
     "<h1>T</h1><p><b>unclosed<br><p>next</article><div>All of us reserve every right that we can think of here today</div>", "T\nunclosed\nnext"),
    ("", ""), (None, ""), ("no markup", ""), ("<p>" + "word " * 50_000, "word " * 49_999 + "word"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x", 9) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, `n.d` int")
    got = {r.page_id: r for r in html.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want) and got[i]["n.d"] == 9
    assert html.extract(df.limit(0)).count() == 0


def test_tree_agrees_with_its_table():
    table = html.labelled()
    assert html.classify(html.trained(), html.derived(table[:, :-1])).tolist() == (table[:, -1] > 0).tolist()


LONG = " ".join(f"word{i}" for i in range(60)) + "."
P = f"<p>{LONG}</p>"
NAV = "<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About</a></ul>"
THREE = "\n".join([LONG] * 3)
# Class names, tags and forms that mislead, and what is to come of them.
MISLEADING = {
    "a page in one form": (f"<body><form action=x><input type=hidden name=state value=1><input type=hidden name=v>{NAV}<div>{P * 3}</div><input name=q><button>Go</button></form></body>", THREE),
    "a form of controls": (f"<article>{P * 3}<form><p>Your name</p><input name=n><p>Your mail</p><input name=m><button>Send</button></form></article>", THREE),
    "an article about law": (f"<article class='post legal'>{P * 3}</article>", THREE),
    "an article with comments": (f"<body class='single comments-open'><article class='post has-comments'>{P * 3}</article></body>", THREE),
    "a widget area": (f"<main><div class='widget-area'>{P * 3}</div></main>", THREE),
    "a form guide": (f"<main><div class='form-guide'>{P * 3}</div><div class=ad>Buy one now</div></main>", THREE),
    "an advert amid an article": (f"<main>{P}<div class='ad'><p>Buy this very good thing now, it is cheap and everybody has one.</p></div>{P * 2}</main>", THREE),
    "a hidden inline": (f"<article><p>a <span style='display:none'>not <span>to</span> be</span>seen<b hidden>x</b> <i>b</i></p>{P}</article>", f"a seen b\n{LONG}"),
    "hidden elements": (f"<article>{P * 3}<div hidden><p>{LONG}</p></div><div aria-hidden='true'>{P}</div></article>", THREE),
    "responses": (f"<article>{P * 3}</article><section id='responses'>{P}</section><div class='user-feedback'>{P * 2}</div>", THREE),
    "responses in the article": (f"<main>{P * 3}<section id='responses'><p>I like it</p>{P}</section></main>", THREE),
    "a teaser in the only article": (f"<body><div>{P * 3}</div><article><h3>More</h3></article></body>", f"{THREE}\nMore"),
}


@pytest.mark.parametrize("case", MISLEADING)
def test_names_and_tags_that_mislead(case):
    page, want = MISLEADING[case]
    assert html.main_text(page, html.trained()) == want


def test_words_links_and_neighbours_decide():
    """The same tags and names: only words, link densities and neighbours differ, and so does the verdict."""
    tree = html.trained()
    taken = lambda page: html.main_text(page, tree).split("\n")
    for wrap in ("<div>{}</div>", "<main>{}</main>", "<div class='widget'>{}</div>"):
        inside = lambda body: taken(wrap.format(body))
        assert "News" not in inside(NAV + P * 3) and inside(NAV + P * 3)[-1] == LONG                       # amid a run of links
        items = [" ".join(f"{k}{i}" for i in range(15)) for k in "abc"]
        assert inside("<ul><li>" + "<li>".join(items) + f"</ul>{P * 3}")[:3] == items                       # a list without
        linked = f"<p><a href=x>{LONG}</a></p>"
        assert len(inside(P + linked * 4)) < 5 == len(inside(P * 5))                                       # the same words as links
    short, among = "<div>Copyright us</div>", taken(f"<div>{NAV}{P * 2}<div>Copyright us</div></div>")
    assert "Copyright us" not in among and taken(f"<div>{short}</div>") != among
    # Without these features the tree could not tell them apart.
    table = html.labelled()
    x, y = html.derived(table[:, :-1]), table[:, -1] > 0
    numbers = [html.FEATURES.index(f) for f in ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "link_run", "text_near")]
    blind = x.copy()
    blind[:, numbers] = 0
    assert (html.classify(html.train(blind, y), blind) != y).sum() > 20
    used = lambda n: set() if n.feature < 0 else {html.FEATURES[n.feature]} | used(n.low) | used(n.high)
    assert {"words", "link_density"} < used(tree) and used(tree) & {"words_before", "words_after", "link_run", "text_near"}


def test_deep_pages_and_repeated_rows(spark):
    import time

    start = time.perf_counter()
    tree = html.trained()
    deep = "<div>" * 100_000 + "x" + "</p>" * 100_000
    assert html.main_text(deep, tree) in ("", "x")
    assert html.main_text("<div><span hidden>" * 50_000 + "x" + "</div>" * 50_000 + P, tree) in ("", LONG)
    assert time.perf_counter() - start < 20
    rows = [(1, P), (1, P), (None, P), (None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted([("1", LONG), ("1", LONG), ("None", LONG), ("None", "")])


def alike(texts, width=5, similarity=0.8):
    """Pairs of texts whose sets of `width` words in a row, lower-cased, have the Jaccard similarity."""
    sets, where = [], {}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[k:k + width]) for k in range(len(words) - width + 1)})
        for s in sets[-1]:
            where.setdefault(s, []).append(i)
    shared = {}
    for holders in where.values():
        for a in range(len(holders)):
            for b in range(a):
                shared[holders[b], holders[a]] = shared.get((holders[b], holders[a]), 0) + 1
    return [(i, j) for (i, j), n in shared.items() if n >= similarity * (len(sets[i]) + len(sets[j]) - n)]


def by_force(rows, labels, network):
    """doc_id -> copies that reach the packing, and their texts, stage by stage."""
    from test_native import sql
    from test_pairs import fingerprint, reach

    docs = [r for r in rows if network.scores([(r[1] or "").encode()])[0] < toxicity.THRESHOLD]
    cleaned = {r.doc_id: r.text for r in sql("op2_line_windows", [r[:3] for r in docs]).itertuples()}
    docs = [(d, cleaned[d] if t is not None else None, s) for d, t, s in docs]
    docs.sort()
    prints = [fingerprint(t) for _, t, _ in docs]
    label = reach(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
                  + alike([t for _, t, _ in docs]))
    docs = [d for i, d in enumerate(docs) if label[i] == i]
    taken = {r.doc_id: (r.taken, r.size) for r in sql("op1_mix_sources", docs).itertuples()}
    return {d: (t, taken[d][0] // taken[d][1]) for d, t, _ in docs if taken[d][1]}


def test_pipeline_against_brute_force(spark):
    from tapewise.llm.queries import tokenizer
    from tapewise.llm.tokens import Encoder

    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table]
    network = toxicity.learn(read(spark, SF, "documents"), read(spark, SF, "labels"))
    want = by_force(rows, None, network)
    encoder = Encoder(tokenizer("word_bpe_49k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {d for d, (_, n) in want.items() if n} == {d for d, pieces in got.items()} - {d for d in got if d not in want}
    for d, (text, n) in want.items():
        if n:
            ids = [*encoder.library.encode(text or "", add_special_tokens=False).ids, 1]
            assert sum(p.length for p in got[d]) == n * len(ids)
            assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) for p in got[d])


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = [(1, "a\nb\nc", "en", "s", 5, 1, "q"), (1, "a\nb\nc", "en", "s", 5, 1, "q"), (2, None, None, None, None, None, None), (None, "a\nb\nc", None, "t", 5, 2, "r"),
            (4, "", "en", "", 0, 3, "s"), (5, "word " * 20_000, "en", "s", 100_000, 4, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, _tie string")
    out = stage(spark, docs, SF)
    assert out.count() > 0
    if k < 4:
        assert out.columns == docs.columns
        given = {(r[0], r[3], r[5], r[6]) for r in rows}
        assert all((r.doc_id, r.source, r.copies, r._tie) in given for r in out.collect())
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_pages_whose_only_article_is_no_article_and_whose_head_is_open():
    from tapewise.llm import html

    paragraph = "<p>" + " ".join(f"word{i}" for i in range(60)) + ".</p>"
    comment = "<article class='comment'><p>nice read, thanks a lot</p></article>"
    teaser = "<aside><article><h3>More</h3><p>another story in short</p></article></aside>"
    for page in (f"<html><body><div>{paragraph * 3}</div>{comment}</body></html>", f"<html><body><div>{paragraph * 3}</div>{teaser}</body></html>",
                 f"<html><head><meta charset=utf-8><title>t</title><div>{paragraph * 3}</div></html>"):
        text = html.main_text(page, html.trained())
        assert text.count("word59") == 3 and "nice read" not in text and "another story" not in text
