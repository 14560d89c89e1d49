import random
import time
from html.parser import HTMLParser

from docs import prose

from wirelake.llm import op07_html as h

SCHEMA = "page_id long, url string, html string"


def page(r, i):
    title = f"Title {i} {r.choice('abcdef')}"
    paragraphs = [f"Paragraph {i}-{k} {prose(r, 12)}" for k in range(r.randint(1, 4))]
    image = f"<figure><img src='{i}.png'><figcaption>Caption {i}</figcaption></figure>" if r.random() < 0.5 else ""
    ads = "".join(f"<li class='item'>Item {i} {k}</li>" for k in range(r.randint(2, 5)))
    html = f"<!doctype html><html><head><title>{title}</title><script>var x = '<p>no</p>';</script><style>p {{}}</style></head><body><nav><a href='/'>Home</a><a href='/x'>News {i}</a></nav><div id='main{i}'><h1>{title}</h1>{image}" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"<ul>{ads}</ul></div><div class='legal'>All rights reserved</div><footer>Contact</footer></body></html>"
    want = [title] + ([f"Caption {i}"] if image else []) + paragraphs + [x.split(">")[1] for x in ads.replace("</li>", "").split("<li class='item'")[1:]]
    return title, want, html


def corpus(spark, n=60):
    r = random.Random(6)
    rows, want = [], {}
    for i in range(n):
        title, texts, html = page(r, i)
        rows.append((i, f"https://Host{i % 2}.example:80/{i}?q", html))
        want[i] = (title, texts)
    return spark.createDataFrame(rows, SCHEMA), want


def test_texts_of_templates(spark):
    df, want = corpus(spark)
    got = {r["page_id"]: r for r in h.extracted(df).collect()}
    assert {r["host"] for r in got.values()} == {"host0.example", "host1.example"} and all(r["fits"] for r in got.values())
    for i, (title, texts) in want.items():
        assert got[i]["title"] == title and got[i]["text"].split("\n") == texts, i
        assert "rights" not in got[i]["text"] and "News" not in got[i]["text"] and "Contact" not in got[i]["text"]


def test_the_order_of_pages_and_parts_do_not_matter(spark):
    df, want = corpus(spark, 24)
    rows = sorted(map(tuple, h.extracted(df).collect()))
    assert sorted(map(tuple, h.extracted(df.orderBy("page_id", ascending=False).repartition(3)).collect())) == rows
    assert [r[4] for r in sorted(map(tuple, h.extracted(df, fan=3).collect()))] == ["\n".join(want[i][1]) for i in range(24)]


def shape(html):
    return h.load(h.structure(html))


def test_repeats_and_options():
    x = shape("<ul><li>a</li><li>b</li><li>c</li></ul>")
    li = (h.Tag("<li>"), h.Tag(h.TEXT), h.Tag("</li>"))
    assert x == [h.Tag("<ul>"), h.Group(li, 1, True), h.Tag("</ul>")]
    both = h.load(h.infer([h.structure(t) for t in ("<p>a</p><b>c</b>", "<p>a</p><i>x</i><b>c</b>")]))
    assert h.Group((h.Tag("<i>"), h.Tag(h.TEXT), h.Tag("</i>")), 0, False) in both
    w = h.Wrapper(h.load(h.infer([h.structure("<ul><li>a</li></ul>"), h.structure("<ul><li>a</li><li>b</li></ul>")])))
    for n in (1, 2, 7):
        symbols, texts = h.tokens("<ul>" + "<li>t</li>" * n + "</ul>")
        assert w.match(symbols) == [0] * n and len(texts) == n
    assert w.match(h.tokens("<ol></ol>")[0]) is None


def test_wrappers_take_all_pages_they_are_made_of():
    r = random.Random(12)
    pages = [page(r, i)[2] for i in range(40)]
    w = h.Wrapper(h.load(h.infer([h.structure(p) for p in pages])))
    assert all(w.match(h.tokens(p)[0]) is not None for p in pages)


def test_tokens():
    assert h.tokens("a<!-- x --> b &amp; <b CLASS='k1'>c<br/></B><script>1<2</script><p unclosed") == (["#", "<b.k0>", "#", "<br>", "</b>", "#"], ["a b &", "c", "<p unclosed"])
    assert h.tokens(None) == h.tokens("") == ([], []) and h.tokens("<script>x") == ([], [])


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "https://a.example/", ""), (3, "https://a.example/", "plain text"), (None, "no url", "<p>x</p>"), (4, "https://b.example", "<p>same</p>"), (4, "https://b.example", "<p>same</p>"), (5, "https://c.example", "<div>" * 2_000 + "deep" + "</div>" * 2_000), (6, "https://d.example", "<li>i</li>" * 20_000), (7, "https://e.example", "<" * 1_000 + "</" * 1_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", host string, slots int, fits int")
    got = [tuple(r) for r in h.extracted(df).collect()]
    assert len(got) == len(rows)
    by = {(g[0], g[4]) for g in got}
    assert {(1, ""), (2, ""), (3, "plain text"), (None, "x"), (5, "deep")} <= by and next(g for g in got if g[0] == 6)[4] == "\n".join(["i"] * 20_000)
    assert h.extracted(df.limit(0)).count() == 0


def test_copies_of_one_page_are_no_template(spark):
    article = "<body><h1>One</h1><p>Its only paragraph</p></body>"
    part = lambda i, more: f"<body><div>Site</div><h1>Title {i}</h1>{more}</body>"
    rows = [(i, f"http://a.example/?utm_source={i}", article) for i in range(3)] + [(i, "http://b.example/", part(max(i, 12), "<table>kept</table>" if i < 13 else "")) for i in range(11, 15)]
    got = {r["page_id"]: r for r in h.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["fits"] and got[i]["text"] == "One\nIts only paragraph" for i in range(3))
    assert [got[i]["text"] for i in range(11, 15)] == ["Title 12\nkept"] * 2 + ["Title 13", "Title 14"]


def test_places_of_odd_markup():
    def body(page):
        symbols, texts = h.tokens(page)
        return [t for t, place in zip(texts, h.contexts(symbols)) if place == "body"]

    for page in ("<nav><a>x</a><h1>a</h1><div>b</div>", "<div><aside>x</div><p>a</p></aside><p>b</p>", "<button/><p>a</p><div>b</div>", "<form><p>a</p><p>b</p></form>", "<form/><i>a</i><p>b</p>", "<title>x<p>a</p><p>b</p>"):
        assert body(page)[-2:] == ["a", "b"], page
    assert body("<div><nav>x<ul><li>y<br></ul></nav><p>a</div></nav><footer>z<nav>u</nav>v</footer>b") == ["a", "b"]
    symbols, texts = h.tokens("<li>i" * 20_000 + "</ol>" * 20_000)
    assert h.contexts(symbols) == ["body"] * len(texts)


class Leaves(HTMLParser):
    """Another reading of a page, by the standard library's parser: (path of open elements, text) in order."""

    def __init__(self, page):
        super().__init__()
        self.path, self.leaves = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in ("img", "br", "meta", "link", "hr", "input"):
            self.path.append(tag + "." + (dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if self.path and self.path[-1].split(".")[0] == tag:
            self.path.pop()

    def handle_data(self, data):
        if data.strip() and not {x.split(".")[0] for x in self.path} & {"script", "style", "nav", "footer", "aside", "title"}:
            self.leaves.append(("/".join(self.path), " ".join(data.split())))


def brute(pages):
    """Texts that aren't the only text ever seen in their place (path, and whether it is the only one of that path on its page) on most distinct pages."""
    read = [Leaves(p).leaves for p in pages]
    distinct = {tuple(x) for x in read}
    on, texts = {}, {}
    for leaves in distinct:
        for path in {p for p, _ in leaves}:
            on[path] = on.get(path, 0) + 1
        for path, text in leaves:
            texts.setdefault(path, set()).add(text)
    constant = {p for p in on if len(texts[p]) == 1 and on[p] > 1 and on[p] > len(distinct) / 2}
    return ["\n".join(t for p, t in leaves if p not in constant) for leaves in read]


def card(r, i, k):
    """Over twenty symbols."""
    return f"<section class='card'><a class='pic' href='/{k}'><img src='{k}.png'></a><h3 class='head'>Head {i} {k}</h3>" + "".join(f"<div class='f{c}'><b class='n{c}'>Field {i} {k} {c}</b></div>" for c in "abcd") + "</section>"


def test_against_another_inference(spark):
    r = random.Random(31)
    rows = []
    for i in range(40):
        cards = "".join(card(r, i, k) for k in range(r.randint(2, 6)))
        option = f"<blockquote class='q'>Said by {i}</blockquote>" if i % 3 == 0 else ""
        html = f"<html><head><title>T {i}</title></head><body><nav><a>Home</a></nav><div class='site'>The site</div><h1 class='t'>Title {i}</h1>{option}<main>{cards}</main><div class='legal'>All rights</div><footer>c</footer></body></html>"
        rows.append((i, "https://a.example/x", html))
    rows += [(100 + i, f"https://a.example/x?again={i}", html) for i, (_, _, html) in enumerate(rows[:10])]
    rows += [(200 + i, "https://b.example/x", f"<body><div class='site'>B</div><h1>Title {i}</h1>" + ("<p class='quote'>A quotation</p>" if i < 2 else "") + f"<p class='x'>Body {i}</p></body>") for i in range(4)]
    got = {x["page_id"]: x for x in h.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    for host in ("a.example", "b.example"):
        own = [x for x in rows if host in x[1]]
        for (i, _, _), want in zip(own, brute([x[2] for x in own])):
            assert got[i]["fits"] and got[i]["text"] == want, i
    assert all("A quotation" in got[200 + i]["text"] for i in range(2)) and "The site" not in got[0]["text"]


def test_repeats_of_any_period():
    r = random.Random(32)
    pages = {n: "<ul>" + "".join(card(r, 0, k) for k in range(n)) + "</ul>" for n in (2, 3, 4)}
    assert len(h.tokens(card(r, 0, 0))[0]) > 20
    w = h.Wrapper(h.load(h.infer([h.structure(pages[2]), h.structure(pages[4])])))
    assert len(h.load(h.structure(pages[4]))) == 3 and w.match(h.tokens(pages[3])[0]) is not None


def test_time_grows_with_the_length():
    for piece in ("<a ", "<a \"", "<a '\"", "<script ", "x<!-- -->", "</script ", "<a b='<a \"'"):
        page = piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        h.tokens(page)
        assert time.perf_counter() - began < 5, piece
