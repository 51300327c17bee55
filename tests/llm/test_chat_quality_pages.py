import random
import re

import pytest

from rowtide.llm import chat, pages, quality


def test_chat_keeps_maximal_conversations(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 1)):
        rows += [(conv, k, r, t, conv) for k, (r, t) in enumerate(talk[:n])]
    rows += [(5, 0, "user", "hello"), (5, 0, "user", "hello"), (6, 0, "user", "hello"), (7, 0, None, ""), (None, 3, "user", "x"), (None, None, "system", "first")]
    rows = [r if len(r) == 5 else (*r, 0) for r in rows]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns long").repartition(3)
    got = {r.conv_id: r for r in chat.render(turns).collect()}
    assert set(got) == {2, 5, 7, None}
    assert got[2].n_copies == 2 and got[2].n_turns == 4 and got[2].rendered.endswith("<|im_start|>assistant\n<|im_end|>\n")
    assert got[5].rendered == "<|im_start|>user\nhello<|im_end|>\n" * 2
    assert got[7].rendered == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[None].rendered == "<|im_start|>system\nfirst<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    assert chat.render(turns.limit(0)).collect() == []


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_hosts(spark):
    random.seed(2)
    texts = [None, "", " \n\t", "a b c d e f g h " * 5, "one\none\n one\n\n\x0b\n", "# $ é | x y", "w " * 40]
    texts += [" ".join(random.choice("ab") for _ in range(random.randint(1, 60))) for _ in range(30)]
    texts += [" ".join(str(random.random()) for _ in range(40)) + "\n" for _ in range(30)]
    rows = [(k, t, "bad" if k < 37 else "good", 1) for k, t in enumerate(texts)] + [(99, texts[-1], None, 1), (99, texts[-1], None, 1), (None, texts[-2], "bad", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host int").repartition(3)
    got = quality.score(docs, limit=0.7).collect()
    by_id = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        r = by_id[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert by_id[50].kept and by_id[99].kept and not by_id[None].kept and not by_id[None].base_failed
    kept = quality.keep_good(docs, limit=0.7)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.score(docs.limit(0)).collect() == [] and quality.keep_good(docs.limit(0)).collect() == []


def test_prior():
    a, b = quality.prior(0.2, 0.01)
    assert abs(a / (a + b) - 0.2) < 1e-9 and abs(a * b / (a + b) ** 2 / (a + b + 1) - 0.01) < 1e-9
    assert quality.prior(None, None) == quality.prior(0.0, 0.0) == (1.0, 1.0)


LONG = "Some words of the article, which go on for quite a while and then end here. " * 3
CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("<script>var x = '<p>no</p>'</script>", ""),
    ("<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T &amp; U</h1><p>a<b>b</b>\n c<br>d<p>e</article><footer>f</footer>", "T & U ab c d e"),
    (f"<body><header><h1>Site</h1></header><div class='cookie-notice'>We use</div><main><h2>Head</h2><p>{LONG}</p><form>Your mail<input></form><div class=ad>Buy</div><p>Ti.</p><section id=comments><h3>Comments</h3><p>{LONG}</p></section></main><aside>{LONG}</aside></body>", f"Head {' '.join(LONG.split())} Ti."),
    (f"<body><div id='top'><a href=a>A</a> <a href=b>B</a></div><div class='content'><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div><div id=footer>x</div></body>", f"Head {' '.join(LONG.split())} Short. {' '.join(LONG.split())}"),
    ("<!-- c --><article>a<!-- <p>b</p> -->c<svg><text>no</text></svg> &lt;d&gt; &#233;&nbsp;x</article>", "ac <d> é x"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><pre> q\n  r </pre></article>", "one two x y q r"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_main_text(html, want):
    assert pages.main_text(html) == want


def test_pages(spark):
    rows = [(k, "u", h, "text") for k, (h, _) in enumerate(CASES)] + [(None, None, CASES[4][0], None)] * 2
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got} == {k: w for k, (_, w) in enumerate(CASES)} | {None: CASES[4][1]}
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in pages.extract(real).collect()}
    import html as h

    for r in real.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(h.unescape(re.sub(r"</?(?:p|br|h1|div|ul|li)\b[^>]*>", " ", re.sub(r"</?(?:b|i|em|strong|a)\b[^>]*>", "", body))).split())
        assert texts[r.page_id] == want


def test_host_verdicts_act_beyond_the_base(spark):
    clean = " ".join(f"word{k}" for k in range(40))
    soft = clean + "\n***\n***\n***\n***\n" + " ".join("#$%&|" * 8 for _ in range(8))
    rows = []
    for host, failing, n in (("a", 0, 30), ("b", 1, 30), ("c", 6, 30), ("d", 27, 30)):
        rows += [(len(rows) + k, "short" if k < failing else clean, host) for k in range(n)]
        rows += [(1000 + len(rows), soft, host)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    kept = {h: {d for d, _, x in rows if x == h and got[d].kept} for h in "abcd"}
    softs = {h: next(d for d, t, x in rows if x == h and t == soft) for h in "abcd"}
    assert not any(got[d].base_failed for d in softs.values())
    assert softs["a"] in kept["a"] and softs["b"] in kept["b"] and len(kept["a"]) == 31 and len(kept["b"]) == 30
    assert softs["c"] in kept["c"] and len(kept["c"]) == 25  # below the prior's mean
    assert not kept["d"]  # rejected whole, clean documents too
    worse = docs.where("source <> 'd'")
    again = {r.doc_id: r.kept for r in quality.score(worse).collect()}
    assert not again[softs["c"]] and again[softs["a"]] and sum(again[d] for d, _, h in rows if h == "c") == 24  # suspect now
    assert {r.doc_id for r in quality.keep_good(worse).collect()} == {d for d, k in again.items() if k}


def test_quality_with_clashing_columns(spark):
    clean = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, clean, "h", True, 1), (2, "x", None, None, None)], "doc_id long, text string, source string, base boolean, `__q_words` int")
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == [(1, clean, "h", True, 1)]


WORDS = "Words that make up a sentence of the text, followed by others, as articles have them. "


@pytest.mark.parametrize("html,want", [
    ("<body><div><a href=a>one</a><a href=b>two</a></div><div><h1>Title</h1><p>" + WORDS * 4 + "<p>" + WORDS * 5 + "<p>Short end.</div><div><a href=c>three</a></div>", "Title " + WORDS * 9 + "Short end."),
    ("<body><div class='widget-free'><p>x</div><div class=story><p>" + WORDS * 6 + "</p><p>" + WORDS * 3 + "</p><aside>" + WORDS + "</aside></div>", WORDS * 9),
    ("<body><main class='sidebar-left ad'><p>" + WORDS * 3 + "<p>y</main><div class=comments><p>" + WORDS * 8 + "</div>", None),
    ("<div>" + "<p><i>a</i><b>b</b><u>c</u></p>" * 60 + "</div><section><p>" + WORDS * 9 + "</p><p>" + WORDS * 9 + "</p></section>", WORDS * 18),
])
def test_ratios_choose_the_region(html, want):
    got = pages.main_text(html)
    assert got == (want.strip() if want else (WORDS * 3).strip() + " y") or not want and got == ""


def test_nothing_without_text_per_tag(monkeypatch):
    html = "<article><p>" + WORDS * 3 + "</article>"
    assert pages.main_text(html)
    monkeypatch.setattr(pages, "smoothed", lambda v: [0.0] * len(v))
    assert pages.main_text(html) == ""


def test_a_very_long_page():
    html = "<nav><a href=x>x</a></nav><div>" + "".join(f"<p>{WORDS}{k}" for k in range(30_000)) + "</div>"
    text = pages.main_text(html)
    assert text.startswith(WORDS + "0 ") and text.endswith(" 29999") and len(text) > 30_000 * len(WORDS)
