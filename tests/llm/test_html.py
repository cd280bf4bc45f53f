import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

from symgrid.llm import html as H

from .fixtures import DOCS, rows

SCHEMA = "page_id long, url string, html string"


def page(body, nav="<nav><a href='/a'>Start</a><a href='/b'>News</a></nav>", foot="<footer>All rights of the house</footer>"):
    return f"<html><head><title>T</title><style>p {{}}</style></head><body>{nav}<div><p>{body}</p></div>{foot}</body></html>"


def test_templates_go_and_bodies_stay(spark):
    pages = [(i, f"http://a.example.com/{i}", page(f"own words of page {i}")) for i in range(6)]
    pages += [(10 + i, f"http://b.example.com/{i}", page(f"elsewhere {i}")) for i in range(2)]
    got = {r["page_id"]: r for r in H.extract_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(got[i]["text"] == f"own words of page {i}" for i in range(6))
    assert got[10]["text"] == "Start News\nelsewhere 0\nAll rights of the house".replace("Start News", "StartNews")
    assert got[10]["n_removed"] == 0 and got[0]["n_removed"] > 0


def test_tree_with_implied_ends():
    got = {(t, "<b><p>x<p>y<div>z</div></b>"[s:e]) for t, s, e, _ in H.elements("<b><p>x<p>y<div>z</div></b>")}
    assert got == {("p", "<p>x"), ("p", "<p>y"), ("div", "<div>z</div>"), ("b", "<b><p>x<p>y<div>z</div></b>")}
    assert [t for t, *_ in H.elements("<ul><li>a<li>b</ul>")] == ["li", "li", "ul"]


def test_broken_markup():
    assert H.visible_text("a<p>b<!-- never ended <p>c") == "a\nb"
    assert H.visible_text("x &amp; y<br>&lt;z&gt;<script>if (a<b) {}</script>w") == "x & y\n<z>w"
    assert H.visible_text("a < b <c") == "a < b"
    assert H.visible_text("<script>never ended") == ""


def test_edge_cases(spark):
    rows_ = [(1, None, None), (2, None, ""), (None, "not a url", "<p>x"), (4, "http://a/", "<p>" + "y " * 200_000), (4, "http://a/", "<p>same"), (4, "http://a/", "<p>same")]
    df = spark.createDataFrame(rows_, SCHEMA).selectExpr("*", "'q' as host", "1 as hash", "2 as page", "'t' as text")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in H.extract_text(df).collect()), key=repr)
    assert got == sorted([(0, "x"), (1, None), (2, ""), (4, ("y " * 200_000).strip()), (4, "same"), (4, "same")], key=repr)
    assert H.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_counting_and_the_shuffle_join(spark):
    df = spark.read.parquet(f"{DOCS}/pages.parquet").unionByName(spark.createDataFrame([(1000 + i, f"https://x.example.org/{i}", page(f"z{i}")) for i in range(9)], SCHEMA))
    got = rows(H.extract_text(df))
    own = {(r["url"], r["html"]): r["url"].split("/")[2].split(":")[0].lower() for r in df.collect()}
    n, total = Counter(), Counter(own.values())
    for (_, h), host in own.items():
        n.update({(host, x) for x, _, _ in H.subtree_hashes(h)})
    bad = defaultdict(set)
    for (host, x), k in n.items():
        if k >= H.MIN_PAGES and k >= total[host] * H.MIN_SHARE:
            bad[host].add(x)
    want = []
    for r in df.collect():
        host = own[r["url"], r["html"]]
        spans = [(s, e) for x, s, e in H.subtree_hashes(r["html"]) if x in bad[host]]
        want.append((r["page_id"], host, H.visible_text(r["html"], spans), len(spans)))
    assert got == sorted(want) and any(w[3] for w in want)
    assert rows(H.extract_text(df, broadcast_rows=-1)) == got


def test_other_pages_of_a_host_do_not_matter(spark):
    section = [(i, f"http://big.example.com/s/{i}", page(f"own words {i}")) for i in range(5)]
    others = [(100 + i, f"http://big.example.com/o/{i}", f"<p>unrelated {i}</p>") for i in range(700)]
    few = rows(H.extract_text(spark.createDataFrame(section, SCHEMA)))
    many = [r for r in rows(H.extract_text(spark.createDataFrame(section + others, SCHEMA))) if r[0] < 100]
    assert few == many and all(r[2] == f"own words {r[0]}" for r in many)


class Tree(HTMLParser):
    """Elements of well-formed markup as [tag, children]; text as strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ["", []]
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1][1].append([tag, []])
        self.open.append(self.open[-1][1][-1])

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][1].append(data)


def below(node):
    for x in node[1]:
        if not isinstance(x, str):
            yield x
            yield from below(x)


def shown(node, gone):
    out = ""
    for x in node[1]:
        if isinstance(x, str):
            out += x.replace("\n", " ")
        elif repr(x) in gone:
            out += "\n"
        else:
            out += f"\n{shown(x, gone)}\n" if x[0] in ("div", "p", "ul", "li", "nav") else shown(x, gone)
    return out


def test_against_another_parser(spark):
    rng = random.Random(1)

    def node(depth, words):
        tag = rng.choice(["div", "p", "ul", "li", "nav", "span", "b"]) if depth else "span"
        inner = "".join(node(depth - 1, words) if depth and rng.random() < 0.5 and tag not in ("p", "li") else f" {rng.choice(words)}" for _ in range(rng.randint(1, 3)))
        return f"<{tag}>{inner}</{tag}>" if tag != "li" else f"<ul><li>{inner}</li></ul>"

    pages, few = [], ["home", "news", "about"]
    for i in range(240):
        words = few if rng.random() < 0.7 else [f"w{rng.randrange(10**6)}" for _ in range(5)]
        pages.append((i, f"http://h{i % 3}.example.com/{i}", "".join(node(3, words) for _ in range(rng.randint(1, 4)))))
    on = defaultdict(set)
    trees = {i: Tree(h).root for i, _, h in pages}
    for i, url, h in pages:
        for x in below(trees[i]):
            on[url.split("/")[2], repr(x)].add((url, h))
    want = []
    for i, url, _ in pages:
        gone = {x for (host, x), seen in on.items() if host == url.split("/")[2] and len(seen) >= H.MIN_PAGES}
        lines = [" ".join(x.split()) for x in shown(trees[i], gone).split("\n")]
        want.append((i, "\n".join(x for x in lines if x)))
    got = sorted((r["page_id"], r["text"]) for r in H.extract_text(spark.createDataFrame(pages, SCHEMA)).collect())
    assert got == want and any(t for _, t in got)


def test_deep_and_unended_pages_take_linear_time():
    for bad in ("<div>" * 30_000 + "x" + "</div>" * 30_000, "<b>" * 30_000 + "</i>" * 30_000, "<p><b>" * 20_000, "<li><ul>" * 20_000, "</p>" * 50_000, "<a href='" * 20_000):
        began = time.time()
        H.subtree_hashes(bad)
        H.visible_text(bad)
        assert time.time() - began < 5, bad[:20]
