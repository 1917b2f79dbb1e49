import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavewright.llm import html_wrapper as hw


def article(source):
    """The blocks of the one article, cut by its tags."""
    m = re.search(r"<article>(.*?)</article>", source, re.S)
    blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\x00", m[1])).split("\x00")
    return "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def test_query(spark, sf):
    from wavewright.llm import queries

    found = queries.op2_wrapper_induction(spark, sf).toPandas()
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    assert sorted(found.page_id) == sorted(pages.page_id)
    expected = dict(zip(pages.page_id, pages.html.map(article), strict=True))
    assert all(expected[r.page_id] == r.text and r.n_chars == len(r.text) for r in found.itertuples())


def page(body):
    return f'<html><head><title>T</title></head><body><div class="top">My Site home about</div><div class="x"><h2>Head</h2>{body}</div><div class="z">Copyright all rights</div></body></html>'


def test_slot_without_marks():
    out = hw.extract_run([page(f"<p>{w * 30}</p><p>second {w}</p>") for w in ("alpha ", "beta ", "gamma ", "delta ")])
    assert [t.splitlines()[-1] for t in out] == ["second alpha", "second beta", "second gamma", "second delta"]
    assert all("Site" not in t and "Copyright" not in t for t in out)


@pytest.mark.parametrize("part", ['<nav>menu</nav>', '<header>menu</header>', '<footer>menu</footer>', '<aside>menu</aside>', '<form>menu</form>', '<script>menu</script>', '<style>menu</style>', '<div class="advert-box">menu</div>', '<div id="comments"><p>menu</p></div>', '<div class="cookie notice">menu</div>', '<section role="complementary">menu</section>', '<div hidden>menu</div>', '<!-- menu -->', '<noscript>menu</noscript>', '<p>a <span class="ad">menu</span></p>', '<div style="display: none">menu</div>'])
def test_left_out(part):
    text = hw.extract_run([f"<body>{part}<article><p>kept &amp; \n  clean</p>{part}<p>second<br>third</p></article>{part}</body>"])[0]
    assert "menu" not in text and text.splitlines()[0] == "kept & clean" and text.splitlines()[-2:] == ["second", "third"]


def test_odd_pages():
    assert hw.extract_run([None, "", "plain", "<div>a &lt; b</div>", "<p>one<p>two", "<" * 20 + "a", "<div>" * 3000 + "deep", "<p title='>'>x</p>", "<ul><li>a<li>b</ul>", "<script>var a = '</p>'"]) == ["", "", "plain", "a < b", "one\ntwo", "<" * 20 + "a", "deep", "x", "a\nb", ""]
    assert hw.extract_run([]) == []
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert hw.extract_run([long])[0].count("\n") == 19_999


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pdiv a\"'=&;!-", max_size=60))
def test_never_fails(source):
    hw.extract_run([source, source])


def test_tree_match():
    tree = lambda *nodes: (tuple(n[0] for n in nodes), tuple(n[1] for n in nodes))
    a = tree(("r", -1), ("x", 0), ("y", 0), ("z", 2))
    b = tree(("r", -1), ("y", 0), ("z", 1), ("w", 0))
    assert hw.tree_match(a, b) == {0: 0, 1: 2, 2: 3}
    assert hw.tree_match(a, tree(("q", -1))) == {}


def test_frame(spark):
    rows = [(1, "http://a.b/x", "<article><p>A</p></article>", "h"), (1, "http://a.b/x", "<article><p>A</p></article>", "h"), (2, None, None, "h"), (None, "nonsense", "<p>B</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = sorted(map(tuple, hw.extract(df).collect()), key=repr)
    assert found == sorted([(1, "http://a.b/x", "A", 1), (1, "http://a.b/x", "A", 1), (2, None, "", 0), (None, "nonsense", "B", 1)], key=repr)
    assert hw.extract(df.limit(0)).isEmpty()


def plain_score(a, b):
    kids = lambda t: [[k for k, up in enumerate(t[1]) if up == n] for n in range(len(t[0]))]
    ka, kb = kids(a), kids(b)

    def score(i, j):
        if a[0][i] != b[0][j]:
            return 0
        best = [[0] * (len(kb[j]) + 1) for _ in range(len(ka[i]) + 1)]
        for x, p in enumerate(ka[i], 1):
            for y, q in enumerate(kb[j], 1):
                best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + score(p, q))
        return 1 + best[-1][-1]

    return score(0, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 99)), max_size=16), st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 99)), max_size=16), st.sampled_from([1, 4, 1 << 20]))
def test_tree_match_is_largest(one, other, cells):
    a, b = ((("r", *(x for x, _ in nodes)), (-1, *(up % (k + 1) for k, (_, up) in enumerate(nodes)))) for nodes in (one, other))
    old, hw.TABLE_CELLS = hw.TABLE_CELLS, cells
    try:
        found = hw.tree_match(a, b)
    finally:
        hw.TABLE_CELLS = old
    assert len(found) == len(set(found.values())) == plain_score(a, b)
    assert all(a[0][i] == b[0][j] and (j == 0 or found[b[1][j]] == a[1][i]) for j, i in found.items())


def test_large_pages_are_aligned():
    def big(word, n):
        body = "".join(f"<p>{word} {k}</p><h3>{word} part {k}</h3>" for k in range(n))
        return f'<body><div class="top"><p>My Site</p><b>home</b></div><div class="x">{body}</div><div class="z"><p>Copyright</p></div></body>'

    pages = [big(w, n) for w, n in (("alpha", 900), ("beta", 910), ("gamma", 920), ("delta", 2500), ("eps", 3), ("zeta", 900))]
    texts = hw.extract_run(pages)
    assert all("Site" not in t and "Copyright" not in t for t in texts)
    assert [t.count("\n") for t in texts] == [1799, 1819, 1839, 4999, 5, 1799]


@pytest.mark.parametrize("depth", [10, 55, 58, 200, 5000])
def test_deep_elements_balance(depth):
    nested = "<div>" * 10 + "<p>inner</p>" + "</div>" * 10
    body = "<div>" * depth + f"<article>{nested}<p>after</p><aside>menu</aside></article><nav>menu</nav><div id='comments'>{nested}<p>said</p></div>" + "</div>" * depth
    assert hw.extract_run([f"<body>{body}</body>"] * 3) == ["inner\nafter"] * 3
    plain = "<div>" * depth + f"<p>text</p><nav>menu</nav><div id='comments'>{nested}<p>said</p></div>" + "</div>" * depth + "<p>end</p>"
    assert hw.extract_run([plain]) == ["text\nend"]


def test_many_open_tags():
    assert hw.extract_run(["<div>" * 20_000 + "</section></p><li>" * 20_000 + "x"])[0] == "x"


TEXT = "<p>" + "kept words of the story " * 20 + "</p>"


@pytest.mark.parametrize("wrapper", ["site has-sidebar", "sidebar", "widget", "elementor-widget elementor-widget-text-editor", "comments-enabled", "header", "share", "ad-free", "toc"])
def test_names_of_wrappers_keep_the_article(wrapper):
    source = f'<body><div class="{wrapper}"><div class="in"><article>{TEXT}</article></div><div class="advert">menu</div></div><div class="widget">menu</div></body>'
    assert hw.extract_run([source])[0] == " ".join(TEXT[3:-4].split())


@pytest.mark.parametrize("wrapper", ["elementor-widget elementor-widget-text-editor", "has-sidebar", "header-wide", "widget", "social"])
def test_names_inside_the_article(wrapper):
    source = f'<body><article><h1>Head</h1><div class="{wrapper}">{TEXT}</div><div class="widget">menu</div><div class="share">menu</div></article></body>'
    assert hw.extract_run([source])[0] == "Head\n" + " ".join(TEXT[3:-4].split())


@pytest.mark.parametrize("wrapper", ["elementor-widget", "sidebar", "layout-toc"])
def test_names_around_the_induced_slot(wrapper):
    pages = [f'<body><div class="top"><p>My Site</p></div><div class="{wrapper}"><p>{w * 60}</p><h2>{w}</h2></div><div class="sidebar">menu</div></body>' for w in ("alpha ", "beta ", "gamma ")]
    assert [t.splitlines()[-1] for t in hw.extract_run(pages)] == ["alpha", "beta", "gamma"]


def test_comments_marked_as_articles_stay_out():
    comment = '<article class="comment"><p>menu</p></article>'
    for source in (f'<article>{TEXT}<div id="comments">{comment * 50}</div></article>', f'<div class="story">{TEXT}</div><ol class="comments">{comment * 50}</ol><div class="related">{comment}</div>'):
        assert hw.extract_run([f"<body>{source}</body>"])[0] == " ".join(TEXT[3:-4].split())


def neutral(source):
    """The page with the marks, names and roles of its parts taken away."""
    source = source.replace("<article>", "<div>").replace("</article>", "</div>").replace('<div class="ad">', "<div>")
    return re.sub(r"(</?)(?:nav|footer)>", r"\1div>", source)


@pytest.mark.parametrize("partitions", [1, 5, 200])
def test_neutral_markup_is_induced_alike_on_any_partitions(spark, sf, partitions):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    bare = pages.assign(html=pages.html.map(neutral)).sample(frac=1, random_state=partitions)
    found = hw.extract(spark.createDataFrame(bare).repartition(partitions)).toPandas()
    hosts = pages.assign(host=pages.url.str.extract(r"//([^/]+)")[0], bare=pages.html.map(neutral)).groupby("host")
    expected = {i: t for _, g in hosts for i, t in zip(g.page_id, hw.extract_run(list(g.bare)), strict=True)}
    assert dict(zip(found.page_id, found.text, strict=True)) == expected
    right = dict(zip(pages.page_id, pages.html.map(article), strict=True))
    of_many = {i for _, g in hosts if len(g) >= 3 for i in g.page_id}
    assert of_many and all(expected[i] == right[i] for i in of_many)


def plain_wrapper(pages):
    """The text that varies over pages of one frame, told by hand: each page is (top, story, side, bottom)."""
    return ["\n".join(story) for _, story, _, _ in pages]


@pytest.mark.parametrize("n", [3, 7])
def test_constant_text_inside_the_content_is_template(n):
    frame = [((), [f"head {k}", *(f"told {k} {j} " + "word " * 20 for j in range(k % 3 + 1)), "Share this story"], (), ()) for k in range(n)]
    sources = [f"<body><div>My Site</div><div><h2>{s[0]}</h2>{''.join(f'<p>{x}</p>' for x in s[1:-1])}<h4>{s[-1]}</h4></div><div>News of today {k}</div></body>" for k, (_, s, _, _) in enumerate(frame)]
    cut = [[" ".join(x.split()) for x in page.split("\n")] for page in plain_wrapper(frame)]
    assert hw.extract_run(sources) == ["\n".join(x[:-1]) for x in cut]


def test_copies_do_not_turn_their_article_into_template():
    copy = "<body><div>Site {}</div><div><h2>one</h2><p>" + "same words " * 40 + "</p></div></body>"
    texts = hw.extract_run([copy.format(k) for k in range(20)] + [page(f"<p>{w * 30}</p>") for w in ("alpha ", "beta ")])
    assert texts[:20] == ["one\n" + ("same words " * 40).strip()] * 20


@pytest.mark.parametrize("part", ['<p class="side-effects">kept</p>', '<p id="share-price">kept</p>', '<div class="notice-board">kept</div>'])
def test_parts_of_names_leave_nothing_out(part):
    assert hw.extract_run([f"<body><article><p>{'words ' * 9}</p>{part}</article></body>"])[0].endswith("kept")


@pytest.mark.parametrize("unclosed", ['<svg><path d="x">', "<noscript>", "<object>", "<select>", "<iframe>"])
def test_nothing_is_lost_after_an_unclosed_element(unclosed):
    assert hw.extract_run([f"<body>{unclosed}<article><p>a</p>{unclosed}<p>b</p></article></body>"]) == ["a\nb"]
    assert hw.extract_run([f"<body><article><p>a</p><svg><svg>menu</svg>menu</svg><p>b</p></article>{unclosed}"]) == ["a\nb"]


def test_links_and_headings_break_ties_without_marks():
    source = "<body><div><a href=x>long list of many links to other pages</a></div><div><h1>Title</h1><p>short</p></div><div><p>about as long</p></div></body>"
    assert hw.extract_run([source]) == ["Title\nshort"]


@pytest.mark.parametrize("sizes", [[(3, 2, 1)], [(3, 1, 1), (9, 1, 1)], [(5, 1, 4), (7, 1, 1), (2, 1, 1)], [(4, 1, 9), (6, 2, 1)]])
def test_median_of_most_frequent(sizes):
    most = max(n for _, n, _ in sizes)
    spelled = sorted(size for size, n, trees in sizes if n == most for _ in range(trees))
    assert hw.median_of_most_frequent(sizes) == spelled[len(spelled) // 2]
