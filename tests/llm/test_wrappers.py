import html
import re

from hitgraph.llm import wrappers

A = "<html><body><nav><ul><li>x</li><li>y</li></ul></nav><article><h1>T &amp; U</h1><p>one <b>two</b>\n three<p>four</article><footer>f</footer>"
B = "<html><body><nav><ul><li>x</li></ul></nav><div class='ad'>buy</div><article><h1>V</h1><p>five</p></article><footer>f</footer></body></html>"


def text(page, *others):
    return wrappers.Host(wrappers.infer([*others, page])).main_text(page)


def test_inference_aligns_pages():
    w = wrappers.infer([A, B])
    shape = wrappers._shape(w)
    assert "+(<li>#</li>)" in shape and "?(<div~>#</div~>)" in shape and "+(<p>#</p>)" in shape
    assert wrappers.unpack(wrappers.pack(w)) == w
    host = wrappers.Host(w)
    for p in (A, B):
        assert wrappers.parse(w, wrappers.stream(p)) is not None
    assert wrappers.parse(w, wrappers.stream("<html><body><table><tr><td>1</table>")) is None
    assert host.main_text(A) == "T & U\none two three\nfour"
    assert text(B) == "V\nfive"


def test_the_text_is_what_the_wrapper_says():
    """The labels of the wrapper's nodes decide; a page that does not fit widens it for itself alone."""
    host = wrappers.Host(wrappers.infer([A, B]))
    odd = "<html><body><nav><ul><li>x</li></ul></nav><article><h1>V</h1><table><tr><td>cell</td></tr></table><p>six</p></article></body></html>"
    before = [host.main_text(p) for p in (A, B, odd)]
    assert before[2] == "V\ncell\nsix" and not host.read(odd)[0]
    assert [host.main_text(p) for p in (odd, odd, B, A)] == [before[2], before[2], before[1], before[0]]
    host.labels = [0] * len(host.labels)
    assert host.main_text(A) == host.main_text(B) == ""


def test_names_inside_an_article():
    keep = "<article><div class='share-price'>a</div><div class='menu-of-the-week'>b</div><p class='social'>c</p>%s</article>"
    for part in ("<div class='ad'>x</div>", "<div id='ad-slot-3'>x</div>", "<section class='post comments-list'>x</section>", "<div class='cookie-notice'>x</div>", "<p class='notice'>x</p>", "<div role='navigation'>x</div>"):
        assert text(f"<body>{keep % part}</body>") == "a\nb\nc", part
    # an article that has nothing else is no advert
    assert text("<body><article><div class='promo'><p>all</p></div></article></body>") == "all"


def test_deep_and_long_pages():
    deep = "<body><article>" + "<div>" * 5000 + "one" + "</div>" * 5000 + "<p>two</p></article></body>"
    deeper = deep.replace("<div>one", "<div><p>three</p>one")
    host = wrappers.Host(wrappers.infer([deep, deeper]))
    assert host.main_text(deep) == "one\ntwo" and host.main_text(deeper) == "three\none\ntwo"
    long = "<body><article>" + "".join(f"<p>word {i}</p>" for i in range(40_000)) + "</article></body>"
    assert text(long).count("\n") == 39_999


def test_parts_that_are_no_main_text():
    p = """<body><article><header>h</header><p>a</p><script>var t="</p>";</script><aside>s</aside><form>q</form><!-- c <p>no</p> -->
    <section class="comments"><p>reader</p></section><div class="notice">n</div><p>b&nbsp;&lt;c&gt; &am</p></article>"""
    assert text(p) == "a\nb <c> &am"


def test_query_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(x for x in want if x), r.page_id


def test_empty_null_repeated(spark):
    schema = "page_id long, url string, html string, host string, wrapper string, salt int"
    rows = [(1, None, None, "x", "y", 1), (2, "http://a.b/c", "", "x", "y", 1), (3, "http://a.b/d", A, "x", "y", 1), (3, "http://a.b/d", A, "x", "y", 1), (None, "nonsense", B, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    for most in (1 << 20, 0):
        got = sorted((r.page_id or -1, r.text, r.n_chars) for r in wrappers.extract(df, most=most).collect())
        assert got == [(-1, "V\nfive", 6), (1, "", 0), (2, "", 0), (3, "T & U\none two three\nfour", 24), (3, "T & U\none two three\nfour", 24)]
    assert wrappers.extract(df.limit(0)).count() == 0


def test_hosts_without_article(spark):
    page = lambda *ps: "<body>" + "".join(f"<div><p>{p}</p></div><section>s</section>" for p in ps) + "</body>"
    rows = [(0, "http://one/a", page("alone")), (1, "http://copies/a", page("same")), (2, "http://copies/b", page("same"))]
    # drawn pages may all hold "often", one page of the host does not
    rows += [(10 + i, f"http://many/{i}", page("site", "often" if i else "seldom", f"story {i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {0: "alone\ns", 1: "same\ns", 2: "same\ns"} | {10 + i: f"{'often' if i else 'seldom'}\nstory {i}" for i in range(40)}
    for most in (1 << 20, 0):
        assert {r.page_id: r.text for r in wrappers.extract(df, most=most).collect()} == want


def test_site_texts_are_those_of_one_node(spark):
    """A paragraph that equals a text of the site stays: the wrapper tells the two places apart.  File layout changes nothing."""
    page = lambda i: f"<body><section><p>Site</p></section><div><h2>story {i}</h2><p>{'Site' if i == 3 else f'more {i}'}</p></div></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)] + [(20, "http://h/20", "<body><table><tr><td>Site</td><td>else</td></tr></table></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"story {i}\n{'Site' if i == 3 else f'more {i}'}" for i in range(12)} | {20: "else"}
    for d in (df, df.orderBy(df.page_id.desc()).coalesce(1), df.repartition(7)):
        assert {r.page_id: r.text for r in wrappers.extract(d).collect()} == want
    assert {r.page_id: r.text for r in wrappers.extract(df, most=0).collect()} == want


def story(i, inside):
    return f"<body><article><h1>title {i}</h1><p>first {i}</p><p>second {i}</p>{inside}</article></body>"


def texts(inside, n=4):
    """Page 0 of a host whose pages differ, read by the host's wrapper; inside is a text or a function of the page."""
    pages = [story(i, inside(i) if callable(inside) else inside) for i in range(n)]
    return wrappers.Host(wrappers.infer(pages)).main_text(pages[0]).split("\n")[3:]


def test_vague_names_need_the_wrapper():
    for tag, end in (("section class='related'", "section"), ("div id='header'", "div"), ("div class='media-promo'", "div"), ("p class='comment'", "p"), ("div class='banner'", "div")):
        body = "own words %s" if end == "p" else "<p>own words %s</p>"
        assert texts(lambda i: f"<{tag}>{body % i}</{end}>") == ["own words 0"], tag  # what changes by page is the article's
        assert texts(f"<{tag}>{body % 'of the site'}</{end}>") == [], tag  # what never does is the site's
        assert texts(f"<{tag}>{body % 'alone'}</{end}>", n=1) == ["own words alone"], tag  # one page shows nothing
    # copies of one page show nothing either, and plain names need no wrapper
    same = story(1, "<section class='related'><p>kept</p></section><div class='notice'>gone</div>")
    assert text(same, same, same).endswith("second 1\nkept")


def test_the_wrapper_changes_results():
    page = story(0, "<section class='related'><p>Our shop</p></section>")
    host = wrappers.Host(wrappers.infer([page, *[story(i, "<section class='related'><p>Our shop</p></section>") for i in range(1, 4)]]))
    assert host.main_text(page) == "title 0\nfirst 0\nsecond 0"
    assert wrappers.Host([]).main_text(page) == "title 0\nfirst 0\nsecond 0\nOur shop"


def test_readers_comments_whatever_their_class():
    said = lambda i, k=2: "".join(f"<div class='reader-says'><p>reader {i}{j}</p><p>says {i}{j}</p></div>" for j in range(k))
    assert texts(lambda i: f"<section class='below'><h3>Your views</h3>{said(i, 2 + i)}</section>") == []
    assert texts(lambda i: f"<h3>Your views</h3><ol>{said(i).replace('div', 'li')}</ol>") == []
    # a heading of the page's own, text after it, or units with headings: the article's own parts
    assert len(texts(lambda i: f"<section><h3>Part {i}</h3>{said(i)}</section>")) == 5
    assert len(texts(lambda i: f"<section><h3>Your views</h3>{said(i)}</section><p>end {i}</p>")) == 6
    assert len(texts(lambda i: "<h2>Steps</h2>" + "".join(f"<div><h3>step {i}{j}</h3><p>do {i}{j}</p></div>" for j in range(3)))) == 7
    assert len(texts(lambda i: f"<h3>Sources</h3><ul><li>a{i}</li><li>b{i}</li></ul>")) == 3
    assert len(texts(lambda i: f"<section><h3>Your views</h3>{said(i)}</section>", n=1)) == 5
    # articles in an article are comments, articles in a main element are not
    assert texts(lambda i: f"<div>{said(i).replace('div', 'article')}</div>") == []
    cards = [f"<body><main><h1>news {i}</h1>" + "".join(f"<article><p>a{i}{j}</p><p>b{i}{j}</p></article>" for j in range(3)) + "</main></body>" for i in range(3)]
    assert text(cards[0], *cards[1:]).count("\n") == 6


def test_nesting_takes_time_in_proportion():
    import time

    deep = lambda x: "<body><article><h1>h</h1>" + "<div>" * 20_000 + x + "</div>" * 20_000 + "<p>two</p></article></body>"
    pages = [deep("one"), deep("<p>three</p>one")]
    start = time.process_time()
    host = wrappers.Host(wrappers.unpack(wrappers.pack(wrappers.infer(pages))))
    assert host.main_text(pages[0]) == "h\none\ntwo" and host.main_text(pages[1]) == "h\nthree\none\ntwo"
    assert time.process_time() - start < 5
