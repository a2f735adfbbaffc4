import itertools
import random

from adatlas.llm import html_extract as H


def size_of_best(a, x, b, y):
    """Simple tree matching by its recursive definition over all order-keeping pairings."""
    if a.labels[x] != b.labels[y]:
        return 0
    p, q = a.children[x], b.children[y]
    best = 0
    for k in range(min(len(p), len(q)) + 1):
        for s in itertools.combinations(p, k):
            for t in itertools.combinations(q, k):
                best = max(best, sum(size_of_best(a, u, b, v) for u, v in zip(s, t)))
    return best + 1


def random_tree(r):
    labels, children = ["r"], [[]]
    for _ in range(r.randint(0, 8)):
        parent = r.randrange(max(0, len(labels) - 4), len(labels))
        children[parent].append(len(labels))
        labels.append(r.choice("ab"))
        children.append([])
    order, todo = [], [0]
    while todo:
        k = todo.pop()
        order.append(k)
        todo += reversed(children[k])
    to = {k: i for i, k in enumerate(order)}
    return H.Tree([labels[k] for k in order], [[to[c] for c in children[k]] for k in order])


def test_matching_is_largest_and_keeps_order():
    r = random.Random(4)
    for _ in range(300):
        a, b = random_tree(r), random_tree(r)
        got = H.matched(a, b)
        assert len(got) == size_of_best(a, 0, b, 0)
        pairs = sorted((y, x) for y, x in got.items())
        assert [x for _, x in pairs] == sorted(x for _, x in pairs)
        assert all(a.labels[x] == b.labels[y] for y, x in pairs)


def page(title, body, k):
    return f"""<html><head><title>{title}</title><script>var x = "<p>no</p>";</script><style>p {{}}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/{k}">menu {k}<li><a href="/x">other</ul></nav><div class="cookie-notice"><p>We use cookies {k}</div>
<div id=main-content><div class="strap">Daily facts from all over</div><h2>{title}</h2>{body}</div><div class="sidebar"><p>More {k}</p></div><form><p>Mail <input name=q></form>
<div class="ad">Buy {k}</div><section id="comments"><p>Reader {k} says no</p></section><footer>&copy; {k}</footer></body></html>"""


def test_article_text_without_what_surrounds_it(spark):
    rows = [(k, f"http://u@Host.example:80/p/{k}", page(f"Title {k}", f"<p>One &amp; {k}\n\t two<br>three<p>Four <b>b{k}</b>ld&nbsp;{k}</p><div>tail {k}", k), "e") for k in range(12)]
    rows += [(50, None, None, "n"), (51, "", "", "n"), (52, "http://one.example/", "<article><h1>A</h1><p><b>B<br><p>C &lt;d&gt;</article><footer>f", "n"), (53, "::", "plain < 3 text <p>and more", "n"), (54, "http://x.example", "<p>" * 3000 + "deep" + "<div>" * 3000, "n")]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    out = H.extract(pages).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    for k in range(12):
        assert got[k] == f"Title {k} One & {k} two three Four b{k}ld {k} tail {k}"
    assert got[50] == got[51] == "" and got[52] == "A B C <d>" and got[53] == "plain < 3 text and more" and got[54] == "deep"
    assert all(r.n_chars == len(r.text) for r in out)
    assert H.extract(pages.limit(0)).columns == ["page_id", "url", "html", "text", "n_chars"] and H.extract(pages.limit(0)).count() == 0


def test_copies_do_not_make_an_article_template(spark):
    rows = [(k, "http://c.example/a", "<body><article><h1>Same</h1><p>Text of all</p></article>") for k in range(30)]
    assert {r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same Text of all"}


def test_templates_of_large_and_of_deep_pages(spark):
    body = lambda k: "".join(f"<div><i>Part {i}</i><u>{k} {i}</u></div>" for i in range(250))
    rows = [(k, "http://large.example/", f"<body><div>Daily facts</div>{body(k)}</body>") for k in range(8)]
    rows.append((8, "http://large.example/none", "<body><em>No page</em></body>"))
    rows += [(20 + k, "http://deep.example/", "<div>" * 1500 + f"<i>Deep facts</i><u>page {k}</u>") for k in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == " ".join(f"{k} {i}" for i in range(250))
    assert got[8] == "No page" and all(got[20 + k] == f"page {k}" for k in range(6))


def test_the_wrapper_decides_where_nothing_tells_by_name(spark, monkeypatch):
    def plain(k, parts):
        story = "".join(f"<div>Part {i} of story {k} goes on for a while and tells of many things</div>" for i in range(parts))
        return f"<body><div><div>Facts of the day</div><div>Town {k % 3}</div></div><div><div><h2>Story {k}</h2>{story}<div>Read with care</div></div><div><u>Teaser {k}</u> <u>Teaser {k + 1}</u></div></div><div>Made by us</div></body>"

    rows = [(k, "http://bare.example/", plain(k, 2 + k % 4)) for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(frame).collect()}
    for k in range(20):
        assert got[k] == f"Story {k} " + " ".join(f"Part {i} of story {k} goes on for a while and tells of many things" for i in range(2 + k % 4))
    without = H.Page(rows[0][2]).text(frozenset())
    assert without != got[0] and "Facts of the day" in without and "Teaser" in without and "Made by us" in without


def test_content_is_the_deepest_element_with_most_of_the_varying_text():
    page = H.Page("<body><div class=x><section><p>a</p><p>b</p></section><div>c</div></div><div>d</div></body>")
    tree = H.unpacked(H.packed_tree(page))
    div = tree.labels.index("div")
    p = [k for k, label in enumerate(tree.labels) if label == "p"]
    assert content_label(tree, {p[0]: 40.0, p[1]: 40.0, div: 5.0}) == "section"
    assert content_label(tree, {p[0]: 90.0}) == "section"  # never within a paragraph
    assert content_label(tree, {p[0]: 40.0, div: 40.0}) == "div.x"
    assert content_label(tree, {}) == "#root"


def content_label(tree, mass):
    return tree.labels[H.content_root(tree, mass)]
