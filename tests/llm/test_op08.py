import html
import random
import re

from millrace.llm import op08_html as op


def wrap(pages):
    out = op.Wrapper.of(pages[0])
    for page in pages[1:]:
        out.align(op.Wrapper.of(page))
    return out


def test_wrapper_generalises():
    pages = [
        "<ul><li>a</li><li>b</li></ul><p>x</p>",
        "<ul><li>a</li></ul><h2>new</h2><p>x</p><p>y</p>",
    ]
    want = "<ul> ( <li> # </li> )+ </ul> ( <h2> # </h2> )? ( <p> # </p> )+"
    assert wrap(pages).regex() == want
    assert op.Wrapper.loads(wrap(pages).dumps()).regex() == want
    turns = "<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"
    assert wrap([turns]).regex() == "<dl> ( ( <dt> # </dt> )? ( <dd> # </dd> )? )+ </dl>"
    assert "<div *> # </div>" in op.Rules(wrap([f"<div class=c{w}>{w}</div>" for w in ("sun", "moon", "star")])).wrapper.regex()


def test_main_without_semantic_tags():
    page = "<body><div class=menu><a>one</a><a>two</a></div><div class=left><p>%s</p></div><div class=x><h2>t</h2><p>a</p><p>b</p><p>c</p></div></body>"
    wrapper = wrap([page % "q", page % "r"])
    assert op.extract(page % "q", wrapper.dumps()) == "t\na\nb\nc"


def _host(layout, texts):
    return {i: layout.format(menu="".join(f"<a href=/{i}{k}>item {i} {k}</a> " for k in range(5)), title=f"Title {i}", one=f"First words of text {i} {t}", two=f"More words {t} {i}", notice="We keep small files on your device to count visits; go on if you agree with that.") for i, t in texts.items()}


def test_the_wrapper_extracts(spark):
    """No semantic tags, class names that say nothing and mean other things on
    other hosts: what is main follows from the hosts' own pages, so no constant
    wrapper and none of another host serves."""
    texts = {i: " ".join(f"w{i * k % 97}" for k in range(12)) for i in range(1, 7)}
    layouts = {
        "a": "<body><div class=k1><ul><li>{menu}</li></ul></div><div class=k2><h2>{title}</h2><p>{one}</p><p>{two}</p><div class=k4>{notice}</div></div><div class=k3>{notice}</div></body>",
        "b": "<body><div class=k2>{notice}</div><div class=k3><div class=k1>{notice}</div><h2>{title}</h2><p>{one}</p><p>{two}</p></div><div class=k4><ul><li>{menu}</li></ul></div></body>",
    }
    pages = {h: _host(layout, texts) for h, layout in layouts.items()}
    rows = [(1000 * (h == "b") + i, f"http://{h}.example/{i}", p) for h, some in pages.items() for i, p in some.items()]
    want = {1000 * n + i: f"Title {i}\nFirst words of text {i} {t}\nMore words {t} {i}" for n in (0, 1) for i, t in texts.items()}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r.page_id: r.text for r in op.main_texts(spark, df).collect()} == want
    own, other = (wrap(list(pages[h].values())).dumps() for h in "ab")
    for i, page in pages["a"].items():
        assert op.extract(page, own) == want[i] and op.extract(page, other) != want[i] and op.extract(page) != want[i]


def test_extract():
    page = """<html><head><title>T &amp; x</title><script>var t="</p><article>";</script></head><body><header>H</header><nav><ul><li><a>m</a></li></ul></nav>
    <div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>bold  text<br><p>one <i>two</i>three &eacute;&nbsp;</p><div class="cookie-notice">c</div><!-- <p>no</p> --><ul><li>x<li>y</ul>
    <form><p>f</p></form><section class="comments"><p>reader</p></section><p>a &lt; b</p></article><footer>f</footer></body></html>"""
    assert op.extract(page) == "A & B\nbold text\none twothree é\nx\ny\na < b"
    assert op.extract(None) == "" and op.extract("") == "" and op.extract("plain <b>text") == "plain text"


def test_all_pages(spark):
    """Against a plain reading of these pages' fixed layout."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op.op8_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(b for b in blocks if b)
        assert r.text == want and r.n_chars == len(want)


def test_long_and_odd_pages(spark):
    rng = random.Random(1)
    odd = ["<p>" * 300 + "x", "<" * 2000, "<div>" * 500 + "deep" + "</div>" * 200, "&#x41;&bogus;&amp", "".join(rng.choice(["<p>", "</p>", "<b>", "t ", "<li>", "</div>", "<div id='a>b'>"]) for _ in range(3000))]
    rows = [(i, "http://h.example/", h, "x") for i, h in enumerate(odd)] + [(90, None, None, "x"), (91, "", "", "x"), (91, "", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in op.main_texts(spark, df).collect())
    assert len(got) == len(rows) and dict(got)[3] == "A&bogus;&" and dict(got)[90] == "" and dict(got)[2] == "deep"
    assert op.main_texts(spark, df.where("false")).count() == 0


def test_labels_that_vary(spark):
    """Per-page ids and classes, two templates, and a header in an article that no label names."""
    page = "<body><div class=top>skip</div><%s><header><h1>T%d</h1></header><p>a%d</p><p>b</p></%s><div class=low>skip</div></body>"
    slugs = ["sun", "moon", "star", "tree"]
    opens = [f"article id=post-{i} class='post-{i} post'" for i in range(4)] + [f"article id={w} class='{w} x'" for w in slugs] + ["article class=long", "article class=short role=article", "main", "article"]
    pages = {f"h{h}": [(o, i) for i, o in enumerate(opens) if a <= i < b] for h, (a, b) in enumerate([(0, 4), (4, 8), (0, 12), (8, 10), (10, 12)])}
    rows = [(100 * k + i, f"http://{host}.example/{i}", page % (o, i, i, o.split()[0])) for k, (host, some) in enumerate(pages.items()) for o, i in some]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op.main_texts(spark, df).collect()}
    assert got == {i: f"T{i % 100}\na{i % 100}\nb" for i, _, _ in rows}


def test_slots_and_fallback():
    page = "<body><div id=left><p>what the site is about, the same on each page</p></div><div id=%s><p>text of %s</p></div></body>"
    wrapper = wrap([page % (w, w) for w in ("sun", "moon", "star")]).dumps()
    assert op.extract(page % ("tree", "tree"), wrapper) == "text of tree"
    assert op.extract("<header>site</header><article class=q><header><h1>T</h1></header><p>x</p></article>") == "T\nx"
    # A page without the main elements of its host gives what is no boilerplate.
    assert op.extract("<body><p>lone</p><footer>f</footer></body>", wrapper) == "lone"


def test_many_different_tags_stay_linear():
    """Ids and classes of their own, deep nesting, and a wrapper that stays small."""
    import time

    began = time.perf_counter()
    pages = ["".join(f"<p id=p{k}-{n}>t{k}</p>" for k in range(5000)) + "<div>" * 3000 + "deep" for n in range(3)]
    pages += ["".join(f"<div class='{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{n}x'>t</div>" for k in range(3000)) for n in range(3)]
    wrapper = wrap(pages)
    assert op.extract(pages[0], wrapper.dumps()).startswith("t0\nt1")
    assert time.perf_counter() - began < 20
