from seqloom.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{}</style><script>var t="</p><article>no";</script></head>
<body class="menu-open"><header><h2>Site</h2></header><nav><ul><li>Menu<li>More</ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<article><header><h1>A &lt;head&gt;ing</h1></header><p><b>One&nbsp;&eacute;&#233;&#x1F600;<br>two   lines<p>Second <i>it</i>em<ul><li>x<li>y</ul>
<table><tr><td>1</td><td>2</td></tr></table><div class="share">Share!</div><p hidden>no</p><a title="a > b" href=x>link</a> tail
<section id="comments"><p>first!</p></section><form>f<input></form></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_page():
    assert H.extract(PAGE).split("\n") == ["A <head>ing", "One éé😀 two lines", "Second item", "x", "y", "1 2", "link tail"]


def test_odd_markup():
    assert H.extract(None) == H.extract("") == H.extract("<script>x") == H.extract("<!-- x") == ""
    assert H.extract("just text &amp more") == "just text & more"
    assert H.extract("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert H.extract("a < b and 3<4") == "a < b and 3<4"
    assert H.extract('<p title="open>x</p><p>y</p>') == "x\ny"
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(H.extract("<p>" + "word " * 200000)) == 999999


def page(body, n):
    return f"<html><body><div><span>Welcome to our site</span></div>{body}<div class=c><p>All rights {'reserved'}</p></div><p>unique {n}</p></body></html>"


def test_templates_by_host(spark):
    rows = [(i, f"http://a.com/{i}", page(f"<p>text {i}</p>", i), "x") for i in range(8)]
    rows += [(100 + i, f"http://b{i}.com/", page(f"<p>text {i}</p>", i), "x") for i in range(3)]
    copies = "<article><h1>Same</h1><p>Same article</p><div><div>box</div></div></article>"
    rows += [(200 + i, f"http://c.com/{i}", copies, "x") for i in range(6)]
    rows += [(300, None, None, "x"), (301, None, "", "x"), (None, "no url", "<p>z</p>", "x"), (5, "http://a.com/5", page("<p>text 5</p>", 5), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = [tuple(r) for r in H.extract_pages(df).collect()]
    assert len(found) == len(rows)
    by = {r[0]: r for r in found}
    assert by[3][2] == "text 3\nunique 3"
    assert by[101][2] == "Welcome to our site\ntext 1\nAll rights reserved\nunique 1"
    assert by[204][2] == "Same\nSame article"
    assert by[300][2:4] == ("", 0) and by[None][2:4] == ("z", 1)
    assert all(len(r[2]) == r[3] for r in found) and sum(r[0] == 5 for r in found) == 2
    assert H.extract_pages(df.where("false")).count() == 0


def test_counts_decide_in_and_outside_articles(spark):
    advert = "<ul><li>Buy now</li><li>Pay later</li></ul><p>Sign <b>here</b></p>"
    rows = [(i, f"http://a.com/{i}", f"<article><h1>Title {i}</h1><p>Own <b>text</b> {i}</p>{advert}</article><div>On every page</div>") for i in range(8)]
    teaser = "<article><p>Teaser {0}</p></article><div><p>The main text {0}</p></div><div>On every page</div>"
    rows += [(100 + i, f"http://b.com/{i}", teaser.format(i)) for i in range(8)]
    rows += [(200 + i, f"http://c.com/{i}", "<article><h1>Copy</h1><p>All of it</p></article>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in H.extract_pages(df).collect()}
    for i in range(8):
        assert by[i] == f"Title {i}\nOwn text {i}"
        assert by[100 + i] == f"Teaser {i}\nThe main text {i}"
        assert by[200 + i] == "Copy\nAll of it"


def brute(rows):
    """The text of (page_id, url, html) rows with the templates counted in plain Python, and how many subtrees went."""
    import re
    from collections import defaultdict

    host = lambda u: m[1].lower() if (m := re.match(H.HOST, u or "")) else ""
    pages, where, shares, everywhere = defaultdict(int), defaultdict(list), defaultdict(int), defaultdict(set)
    for _, u, source in rows:
        pages[host(u)] += 1
        for subtree, article, share in H.template_hashes(source):
            where[host(u), subtree].append(article)
            shares[host(u), subtree] += share
            if article:
                everywhere[subtree].add((host(u), article))
    known = defaultdict(set)
    for (h, subtree), articles in where.items():
        n = articles.count(0) + len({a for a in articles if a})
        own = len({a for a in articles if a})
        if n >= H.LEAST_PAGES and n >= H.LEAST_SHARE * pages[h] and shares[h, subtree] < 1000 * H.MAIN_SHARE * n and own >= H.LEAST_OWN * len(everywhere[subtree]) * (own > 0):
            known[h].add(subtree)
    return sorted((i, u, *H.extracted(source, known[host(u)])) for i, u, source in rows)


def varied(seed=0, n=240):
    import random

    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) + str(r.randrange(999)) for _ in range(k))
    rows = []
    for i in range(n):
        host = r.choice(["a.com", "a.com", "a.com", "b.com", "c.com", f"h{i}.com"])
        slot = f"<div class='x{len(host)}'><span>{text(4)}</span><span>{text(2)}</span></div>" * r.randint(1, 2)
        shared = "<p>Quoted everywhere</p>" if r.random() < 0.4 else ""
        own = f"<p>Subscribe to {host}</p>" if r.random() < 0.5 else ""
        main = r.choice(["article", "main", "div"])
        body = f"{slot}<{main}><h1>{text(3)}</h1><p>{text(40)}</p>{shared}{own}</{main}><section>{text(3)}</section>"
        rows.append((i, r.choice([f"http://{host}/{i}", f"https://{host.upper()}/{i}?q"]) if i % 20 else None, body if i % 33 else r.choice([None, ""])))
    return rows


def test_against_brute_force(spark):
    rows = varied()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = [(i, u or "", t, len(t), g) for i, u, t, g in brute([(i, u or "", h) for i, u, h in rows])]
    for limit in (H.BROADCAST_BYTES, 0):  # templates sent to the pages, or joined by host and salt
        found = sorted((r.page_id, r.url or "", r.text, r.n_chars, r.n_template) for r in H.extract_pages(df, limit).collect())
        assert found == expected
    assert sum(g > 0 for *_, g in expected) > 100
    by = {r[0]: r[2] for r in expected}
    assert any("Quoted everywhere" in t for t in by.values())


def test_no_telling_names(spark):
    """Counts alone tell slots from articles: no tag or class here says what it is, and no text but the last recurs."""
    rows = []
    for i in range(30):
        words = " ".join(f"word{i}x{k}" for k in range(60))
        rows.append((i, f"http://s.com/{i}", f"<body><div class='q1'><span>offer {i}</span></div><div class='q2'><h1>title {i}</h1><p>{words}</p></div><div class='q3'>printed {i} times</div><div>same</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in H.extract_pages(df).collect():
        words = " ".join(f"word{r.page_id}x{k}" for k in range(60))
        assert (r.text, r.n_template) == (f"title {r.page_id}\n{words}", 3)


def test_hot_host_and_clashing_names(spark):
    """A third of all rows on one host, most without salt; columns named as the operator's own are ignored."""
    rows = [(i, "http://hot.com/" if i % 3 else f"http://h{i % 7}.com/", f"<div>all</div><p>own {i}</p>", "t", "h", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template string, host string, salt int")
    found = H.extract_pages(df, 0).collect()
    assert sorted((r.page_id, r.text) for r in found) == [(i, f"own {i}") for i in range(300)]
