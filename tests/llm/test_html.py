import html
import random
import re

from ledgerline.llm.html import Folded, extract_text, main_text, match, parse, same_text
from tests.llm.conftest import SMALL


def text(page):
    return main_text(parse(page), set())


def wanted(page):
    """The article of a page of the test tables, by its known frame."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    blocks = [" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "")).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_pages_equal_their_frames(spark):
    pages = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    found = extract_text(pages).collect()
    assert len(found) == len(source)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (source[r.page_id].url, wanted(source[r.page_id].html), len(r.text))


def test_frames_of_many_kinds():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li>Menu</ul></nav><div class="sidebar">Side</div><div class='cookie-notice'>We use</div><main>
    <article><header><h1>Head</h1><p>by me</p></header><p>One&nbsp;two<br>three &amp; <i>four</i>.<p>Five
    <span class="ad">buy</span><ul><li>a<li>b</ul><script>"</p>"</script><table><tr><td>x<td>y</table>
    <form><p>Form</p><input></form><section id="comments"><article><p>Reader</article></section></article></main>
    <aside>Aside</aside><!-- <p>gone</p> --><div hidden>Hid</div><footer>Foot</footer></body></html>"""
    assert text(page) == "Head\n\nOne two three & four.\n\nFive\n\na\n\nb\n\nx\n\ny"
    assert text("<p>a &lt;b&gt; < c<p class=\"x>y\">d &amp;amp; e") == "a <b> < c\n\nd &amp; e"
    assert text("plain <b>text") == "plain text" and text("") == "" and text("<") == "<" and text("<p") == ""
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<ul class=menu><li>m</ul>" + "<p>w</p>" * 3000).count("w") == 3000


def test_tree_matching():
    a, b = Folded([parse("<h1>t</h1><p>x</p><p>y</p><div><p>z</p></div>")]), Folded([parse("<p>q</p><ul><li>i</ul><div><p>z</p></div>")])
    size, pairs = match(a, b)
    assert size == 4 and [(x.sign, y.sign) for x, y in pairs] == [("html", "html"), ("p", "p"), ("div", "div"), ("p", "p")]
    assert match(a, a)[0] == 5


def test_template_of_a_host(spark):
    page = "<body><p>Read our terms</p><div><h2>Title {0}</h2><section><p>Story {0}</p></section></div><h5>All rights</h5></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(20)]
    rows += [(100 + i, "http://few.org/", page.format(i)) for i in range(3)]
    rows += [(200 + i, "http://copies.org/", page.format("same")) for i in range(30)]
    rows += [(300, None, None), (301, "no host", ""), (302, None, "<p>x"), (None, None, None), (302, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as reference", "3 as text")
    found = {r.page_id: r for r in extract_text(pages).collect()}
    whole = "Read our terms\n\nTitle {0}\n\nStory {0}\n\nAll rights"
    assert found[7].text == "Title 7\n\nStory 7"
    assert found[101].text == whole.format(1) and found[205].text == whole.format("same")
    assert (found[300].text, found[300].n_chars, found[301].text, found[302].text) == ("", 0, "", "x")
    assert extract_text(pages).count() == len(rows) and extract_text(pages.limit(0)).collect() == []


def test_template_beside_like_siblings(spark):
    page = "<body><p>Read our terms</p>{1}<p>All rights</p><ul><li>Fixed<li>Item {0}</ul></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i, "".join(f"<p>Story {i}.{k}</p>" for k in range(1 + i % 3)))) for i in range(20)]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in found:
        i = r.page_id
        assert r.text == "\n\n".join([f"Story {i}.{k}" for k in range(1 + i % 3)] + [f"Item {i}"])


def test_alignment_of_siblings():
    assert same_text([1, 2, 3], [1, 9, 9, 3]) == [(0, 0), (2, 3)] and same_text([1, 2], [3]) == [] == same_text([], [1])
    assert same_text([5, 1, 2, 3], [1, 2, 3, 5]) == [(1, 0), (2, 1), (3, 2)] and same_text([7, 7], [7, 8, 7]) == [(0, 0), (1, 2)]


def test_class_words_yield_to_the_article():
    """A word that is part of a class is no reason to drop an article, what holds it, or most of a page."""
    assert text('<div class="content with-sidebar"><article><p>Story</article></div>') == "Story"
    assert text('<div class="layout-no-sidebar"><p>Story') == "Story"
    assert text('<article><p class="form-factor">A</p><div class="cookie-recipe">B</div><h2 id="social-history">C</h2></article>') == "A\n\nB\n\nC"
    assert text('<article><p>A</p><div class="share-buttons">x</div><div class="comments">y</div><span class="ad">z</span> B</article>') == "A\n\nB"
    assert text("<form><nav>menu</nav><article><p>Story</article></form>") == "Story" == text('<div class="search-results"><article>Story</article></div>')
    assert text("<form><p>all of the page</form>") == "all of the page" and text("<p>long enough a text</p><form><p>Name</form>") == "long enough a text"
    assert text("<article><p>A long story.</article><div class=comments><article><p>Reader</article></div>") == "A long story."
    assert text('<p>the text of a page</p><div class="site-footer">f</div><div class="left-sidebar">s</div>') == "the text of a page"
    assert text("<p>a<math><mi>x</mi></math> tail words") == "a tail words"


def test_long_rows_of_siblings():
    """Rows of siblings are aligned in about linear time, and pairs keep their order."""
    def tree(n, signs, extra=""):
        return Folded([parse("".join(f"<{signs[i % len(signs)]}>{i}</{signs[i % len(signs)]}>" + (extra if i == n // 2 else "") for i in range(n)))])

    assert match(tree(20_000, ["p", "h2"]), tree(19_990, ["p", "h2"], "<ul><li>x</ul>"))[0] > 19_000
    one, other = tree(30_000, ["p", "h2", "pre"]), tree(30_000, ["pre", "p", "h2", "p"])
    found, pairs = match(one, other)
    places = [{id(r): n for n, r in enumerate(t.runs)} for t in (one, other)]
    at = [(places[0][id(a)], places[1][id(b)]) for a, b in pairs[1:]]
    assert found > 5_000 and at == sorted(at) and len({j for _, j in at}) == len(at)


def test_table_equals_plain_matching():
    """The largest match, against trying every choice."""
    def plain(a, b):
        if a.sign != b.sign:
            return 0
        rows = [[0] * (len(b.runs) + 1) for _ in range(len(a.runs) + 1)]
        for i, x in enumerate(a.runs, 1):
            for j, y in enumerate(b.runs, 1):
                rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + plain(x, y))
        return 1 + rows[-1][-1]

    rng = random.Random(9)
    page = lambda d: "".join(f"<{t}>{page(d - 1) if d and t == 'div' else t}</{t}>" for t in rng.choices(["div", "p", "ul", "h2"], k=rng.randrange(5)))
    for _ in range(200):
        a, b = Folded([parse(page(3))]), Folded([parse(page(3))])
        found, pairs = match(a, b)
        assert found == plain(a, b) == len(pairs)
