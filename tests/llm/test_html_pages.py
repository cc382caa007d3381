"""Main text of pages written and labelled by hand, none from the templates that the model is trained on."""

import pytest

from tidemark.llm.html import TreeModel, forest, labelled_pages, main_text

#: (html, blocks of its main text).
PAGES = [
    (
        """<!doctype html><html><head><title>River</title></head><body class="home"><div id="page"><header class="site"><a href="/">The Valley Post</a></header>
        <nav role="navigation"><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav>
        <div class="layout"><div class="col-main"><article><h1>River floods three villages</h1><div class="meta-free"><div><div><p>The river rose by two metres overnight.</p>
        <p>Three villages were cut off until noon.</p></div></div></div><p><a href="/map">A map of the flooded roads is here.</a></p></article></div>
        <aside><h3>Most read</h3><ul><li><a href="/1">Council vote</a></li><li><a href="/2">New bridge</a></li></ul></aside></div>
        <footer><p>Copyright The Valley Post</p></footer></div></body></html>""",
        ["River floods three villages", "The river rose by two metres overnight.", "Three villages were cut off until noon.", "A map of the flooded roads is here."],
    ),
    (
        """<html><body><nav><a href="/">Home</a> <a href="/r">Recipes</a></nav><main><article><h1>Bean soup</h1><section class="summary"><p>A soup for four, ready in an hour.</p></section>
        <h2>What you need</h2><ul><li>Two cups of beans</li><li>One onion</li><li><a href="/stock">Vegetable stock</a></li></ul>
        <table><tr><th>Step</th><th>Minutes</th></tr><tr><td>Soak</td><td>30</td></tr><tr><td>Boil</td><td>25</td></tr></table>
        <dl><dt>Simmer</dt><dd>To cook just below the boil.</dd></dl><figure><img src="s.jpg"><figcaption>The soup after an hour.</figcaption></figure></article></main>
        <section id="comments"><h2>2 comments</h2><div class="comment"><p>I made this and it was good.</p></div><div class="comment"><p>Too much salt for me.</p></div></section>
        <footer>All rights reserved</footer></body></html>""",
        ["Bean soup", "A soup for four, ready in an hour.", "What you need", "Two cups of beans", "One onion", "Vegetable stock", "Step", "Minutes", "Soak", "30", "Boil", "25", "Simmer", "To cook just below the boil.", "The soup after an hour."],
    ),
    (
        """<html><body><div class="cookie-banner"><p>We use cookies to make this site work.</p><button>Accept</button></div><div class="topbar"><p>Sign in</p></div>
        <div class="wrap"><div class="inner"><div class="post-body"><h1>How to prune an apple tree</h1><p>Prune in late winter, when the tree is bare.</p>
        <div class="advert">Buy sharp shears today</div><div><div><div><div><p>Cut dead wood first.</p><blockquote><p>A tree forgives a careful cut.</p></blockquote></div></div></div></div>
        <pre>keep the leader, thin the rest</pre></div></div></div><form><label>Your mail</label><input><button>Join</button></form>
        <div class="related"><h3>More stories</h3><ul><li><a href="/a">Pear trees</a></li><li><a href="/b">Plum trees</a></li></ul></div></body></html>""",
        ["How to prune an apple tree", "Prune in late winter, when the tree is bare.", "Cut dead wood first.", "A tree forgives a careful cut.", "keep the leader, thin the rest"],
    ),
    (
        """<html><body><ul class="menu"><li><a href=/>Start<li><a href=/docs>Docs</ul><article><h1>Release notes</h1><p>Version two is out
        <p>It has <a href=/x>a new parser</a> and fewer bugs.<ol><li>Install it<li>Run it</ol><aside class="newsletter"><p>Get our weekly mail</p></aside>
        <div><h3>Known problems</h3><div><p>None so far.</p></div></div></article><div class="share"><a href=/t>Share this</a></div><footer><div><p>Made by us</p></div></footer></body></html>""",
        ["Release notes", "Version two is out", "It has a new parser and fewer bugs.", "Install it", "Run it", "Known problems", "None so far."],
    ),
    (
        """<html><body><header><div class="logo">Hill School</div></header><div id="content"><h2>Term dates</h2><p>The autumn term starts on Monday.</p>
        <table><tbody><tr><td>Autumn</td><td>September to December</td></tr><tr><td>Spring</td><td>January to March</td></tr></tbody></table><p>Parents will get a letter.</p></div>
        <div class="sidebar"><h3>Contact</h3><p>Write to the office for help.</p></div><div class="footer"><p>Hill School, North Road</p></div></body></html>""",
        ["Term dates", "The autumn term starts on Monday.", "Autumn", "September to December", "Spring", "January to March", "Parents will get a letter."],
    ),
]


@pytest.fixture(scope="module")
def model():
    return TreeModel.fit(labelled_pages())


def test_pages_labelled_by_hand(model):
    found = [x.split("\n\n") for x in model.extract([p for p, _ in PAGES])]
    hit = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, PAGES))
    f1 = 2 * hit / (sum(map(len, found)) + sum(len(b) for _, b in PAGES))
    assert f1 >= 0.95


def test_little_markup(model):
    said = ["The first thing that was said.", "Then there was nothing more to say about it"]
    assert model.extract(["\n ".join(said), "", "<p>".join(said), "<h2>A title</h2>" + "".join(f"<p>{x}</p>" for x in said)]) == ["\n\n".join(x) for x in ([" ".join(said)], [], said, ["A title", *said])]


@pytest.mark.parametrize("depth", [0, 1, 3, 6, 10, 20, 50, 200, 3000])
def test_wrappers_of_any_depth(model, depth):
    blocks = "<p>The first thing that was said.</p><p>The second thing, which is longer than the first.</p>"
    deep = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title</h1>{'<div>' * depth}{blocks}{'</div>' * depth}</article><footer>end</footer></body></html>"
    expected = ["A title\n\nThe first thing that was said.\n\nThe second thing, which is longer than the first."]
    assert model.extract([deep]) == expected
    stairs = "<article><h1>A title</h1>" + "".join(f"<div><p>Step {i} of the stairs.</p>" for i in range(depth)) + "</div>" * depth + "</article><footer>end</footer>"
    assert model.extract([stairs]) == ["\n\n".join(["A title", *(f"Step {i} of the stairs." for i in range(depth))])]


def test_work_grows_with_the_page(model):
    """Neither depth nor open items make a page quadratic: 100,000 nested elements and items."""
    f = forest(["<div>" * 50_000 + "<ul>" + "<li>x" * 50_000], model.known)
    assert sum(t is not None for t in f["text"]) == 50_000


def test_deep_page_through_the_operator(spark):
    d = spark.createDataFrame([(1, "u", "<article>" + "<div>" * 3000 + "<p>What stands deep.</p>")], "page_id long, url string, html string")
    assert main_text(d).first()["text"] == "What stands deep."
