import pytest

from shopfloor.llm import html_extract
from shopfloor.llm.html_extract import main_text

SCHEMA = "page_id long, url string, html string, host string, low array<long>, text string"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain  text\n here", "plain text here"), ("a < b &lt; c &amp d &#x41;", "a < b < c & d A"),
    ("<p>one<p>two<br>three</p>four", "one\n\ntwo three\n\nfour"),
    ("<nav><a>x</a></nav><article><h1>T</h1><p><b>a.<br><p>b &amp; c</article><footer>f</footer>", "T\n\na.\n\nb & c"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut <b", "cut"),
    ("<body><div class='ad'>buy</div><p>keep</p><div class='comment-list'>me too</div><!-- <p>no</p> --></body>", "keep"),
    ("<div class='ad'>buy<article>kept though the ad is unclosed</article>", "kept though the ad is unclosed"),
    ("<script>var t='</p>';</script><style>p{}</style>x<textarea>y</textarea><form>z</form>", "x"),
    ("<main><p>a</p><aside>b</aside><div hidden>c</div><div style='display: none'>d</div></main>", "a"),
    ("<ul><li><a href=x>Home</a><li><a href=y>News</a></ul><ul><li>real item<li>another</ul>", "real item\n\nanother"),
    ("<header>site</header><article><header><h1>T</h1></header>x</article>", "T\n\nx"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<article>a</article><article class=comment>no</article><article>b</article>", "a\n\nb"),
    ("<p title=\"a>b\">x</p><p data='unclosed>y</p>", "x\n\ny"), ("</p></div>stray ends", "stray ends"),
    ("<![CDATA[no]]><?xml no?>yes\u00a0&nbsp; sir", "yes sir"),
])
def test_main_text(page, text):
    assert main_text(page) == text


def test_deep_and_long_markup_takes_linear_time():
    import time
    pages = ["<div>" * 30_000 + "deep", "<p><b>" * 30_000 + "x", "<ul><li>" * 20_000 + "y", "<div>" * 20_000 + "</span>" * 20_000,
             "<p " + "a" * 1_000_000 + ">z", "<p title='" + "b c=d " * 200_000 + "'>z", "<div><a>1</a><a>2</a>" * 10_000,
             "<table><tr><td><p>" * 10_000 + "t", "<p " + "hidden-" * 100_000 + ">z"]
    for p in pages:
        t = time.process_time()
        main_text(p)
        html_extract.style_nodes(p)
        assert time.process_time() - t < 2, p[:40]


def test_scopes_of_implied_end_tags():
    def tree(n):
        return (n.tag, [x if isinstance(x, str) else tree(x) for x in n.parts])

    assert tree(html_extract.parse("<p>a<table><tr><td><p>b<div>c</div><td>d</table>e"))[1] == [
        ("p", ["a"]), ("table", [("tr", [("td", [("p", ["b"]), ("div", ["c"])]), ("td", ["d"])])]), "e"]
    assert tree(html_extract.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>"))[1] == [
        ("ul", [("li", ["a", ("ul", [("li", ["b"]), ("li", ["c"])])]), ("li", ["d"])])]
    assert tree(html_extract.parse("<dl><dt>a<dd>b<dt>c</dl></x><i>d</p></i>"))[1] == [
        ("dl", [("dt", ["a"]), ("dd", ["b"]), ("dt", ["c"])]), ("i", ["d"])]


def page(k, menu="<div id=m><p>Start of every page</p></div>"):
    return f"<html><body>{menu}<div><p>Text number {k} is its own.</p></div></body></html>"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "h", [1], "t") for r in rows], SCHEMA)
    return {(r.page_id, r.url): r.text for r in html_extract.extract(df).collect()}


def test_low_importance_branches_of_a_host_are_removed(spark):
    rows = [(k, f"http://A.org:80/{k}", page(k, "<section><p>Same on every page</p></section>")) for k in range(8)]
    rows += [(100 + k, f"http://b.org/{k}", page(k, "<section><p>Same on every page</p></section>")) for k in range(2)]
    got = run(spark, rows)
    assert all(got[k, f"http://A.org:80/{k}"] == f"Text number {k} is its own." for k in range(8))
    assert got[100, "http://b.org/0"].startswith("Same on every page")  # too few pages to tell


def test_copies_of_a_page_do_not_make_its_text_boilerplate(spark):
    rows = [(k, "http://c.org/x", "<body><p>The very same article.</p></body>") for k in range(30)]
    assert set(run(spark, rows).values()) == {"The very same article."}


def test_near_copies_do_not_make_the_text_of_their_host_boilerplate(spark):
    def near(k, text):
        return (f"<html><head><title>T{k}</title></head><body><!-- {k} --><script>var id={k};</script>"
                f"<div class=c><p>{text}</p><p>And so on.</p></div></body></html>")

    rows = [(k, f"http://g.org/{k}", near(k, "The text of all the copies.")) for k in range(8)]
    rows += [(k, f"http://g.org/{k}", near(k, f"Own text number {k}.")) for k in (8, 9)]
    got = run(spark, rows)
    assert all(got[k, f"http://g.org/{k}"].startswith("The text of all the copies.") for k in range(8))
    assert all(got[k, f"http://g.org/{k}"].startswith(f"Own text number {k}.") for k in (8, 9))


def test_entropy_alone_never_takes_the_bulk_of_a_page():
    html = "<html><body><div class=x><p>one text</p><ul><li>a</li></ul></div><div class=y>menu</div></body></html>"
    assert main_text(html, frozenset(html_extract.style_nodes(html))) == "one text\n\na"


def test_prose_of_an_article_is_never_removed_by_entropy(spark):
    rows = [(k, f"http://d.org/{k}", f"<article><h1>{k}</h1><p>All say this.</p></article>") for k in range(9)]
    assert run(spark, rows)[3, "http://d.org/3"] == "3\n\nAll say this."


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "not a url", "<p>x</p>"), (3, "http://e/", ""), (3, "http://e/", ""), (None, "http://e/", "<b>y"),
            (4, "http://f/", "<div>" * 30_000 + "deep"), (5, "http://f/", "<p>" + "long " * 100_000)]
    got = run(spark, rows)
    assert got[1, None] == "" and got[2, "not a url"] == "x" and got[3, "http://e/"] == "" and got[None, "http://e/"] == "y"
    assert got[4, "http://f/"] == "deep" and len(got[5, "http://f/"]) == 499_999
    assert run(spark, []) == {}


def plain_page(k, own, extra=""):
    """No article, no class or id that tells anything: menus and texts in plain containers."""
    return (f"<html><body><div><div>Home</div><div>News of the day</div></div>{extra}<div><p>{own}</p><p>More on {k}.</p></div>"
            f"<table><tr><td>Our other sites</td><td>Terms of use</td></tr></table></body></html>")


def test_plain_containers_are_told_apart_by_the_tree(spark):
    own = [f"Page {k} says something of its own, at some length: {'word ' * (k % 5 + 3)}{k}." for k in range(12)]
    rows = [(k, f"http://p.org/{k}", plain_page(k, own[k])) for k in range(12)]
    got = run(spark, rows)
    assert all(got[k, f"http://p.org/{k}"] == f"{own[k]}\n\nMore on {k}." for k in range(12))
    # the same page alone on its host keeps everything
    alone = run(spark, [(1, "http://q.org/1", plain_page(1, own[1]))])[1, "http://q.org/1"]
    assert alone.startswith("Home") and alone.endswith("Terms of use")


def brute_low(pages):
    """Importance of every style path of a host, by the definition."""
    import math
    from collections import Counter, defaultdict
    seen = {}
    for page in pages:
        tree = html_extract.parse(page)
        copy = html_extract.page_text(tree)
        for path, (a, c) in html_extract.style_nodes(page).items():
            old = seen.get((path, copy))
            seen[path, copy] = (a, c) if old is None else (min(a, old[0]), min(c, old[1]))
    values = defaultdict(list)
    for (path, _), v in seen.items():
        values[path].append(v)

    def entropy(xs):
        return -sum(n / len(xs) * math.log(n / len(xs)) for n in Counter(xs).values()) / math.log(len(xs))

    return {path for path, v in values.items() if len(v) >= html_extract.MIN_PAGES
            and html_extract.PRESENTATION * entropy([a for a, _ in v])
            + (1 - html_extract.PRESENTATION) * entropy([c for _, c in v]) < html_extract.LOW}


def test_low_importance_matches_the_definition(spark):
    hosts = {"a": [plain_page(k % 7, f"Text {k % 7}", "<section>ad</section>" * (k % 3)) for k in range(20)],
             "b": [page(k, "<ul><li>one</li><li>two</li></ul>" if k % 2 else "<ul><li>one</li></ul>") for k in range(9)],
             "c": [page(k) for k in range(4)]}
    df = spark.createDataFrame([(h, p) for h, ps in hosts.items() for p in ps], "host string, html string")
    got = {r.host: set(r.low) for r in html_extract.low_importance(df).collect()}
    want = {h: brute_low(ps) for h, ps in hosts.items()}
    assert got == {h: low for h, low in want.items() if low} and got["a"] and got["b"]


def test_paths_tell_places_and_styles_apart():
    def paths(page):
        out, stack = [], [html_extract.parse(page)]
        while stack:
            n = stack.pop(0)
            out.append(n.path)
            stack = [x for x in n.parts if not isinstance(x, str)] + stack
        return out[1:]

    assert len(set(paths("<div>a</div><div>b</div><div class=x>c</div><div>d</div>"))) == 4
    assert len(set(paths("<p>a</p><p>b</p><p class=x>c</p>"))) == 2
    assert len(set(paths("<div>a</div>" * 20))) == html_extract.PLACES
