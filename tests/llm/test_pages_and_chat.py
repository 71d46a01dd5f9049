"""URL filter, page text and chat formatting on small rows."""

import json
import random
import time

from pyspark.sql import functions as F

from gridcast.llm import chat, html_text, url_filter

SF = "/root/testdata/sf0.01"
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def test_url_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/", "http://example.com", "http://x.com?q=/en/", None, "no scheme/en/",
            "ftp://a.net/es/1#x", "http://anet/es/", "://h/p://q?r"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "host string, bad boolean")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, none, RULES).orderBy("page_id").collect()]
    assert got == [("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"),
                   ("example.com", "", None, "allow"), ("x.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
                   ("a.net", "/es/1", "net/es/", "block"), ("anet", "/es/", None, "allow"), ("h", "/p://q", None, "allow")]


def test_reputation_shrinks_towards_parents(spark):
    rows = [("bad.x.org", True)] * 40 + [("good.x.org", False)] * 40 + [("few.x.org", True)] * 2 + [("a.y.org", False)] * 50
    outcomes = spark.createDataFrame(rows, "host string, bad boolean")
    share = {r["host"]: r["a"] / (r["a"] + r["b"]) for r in url_filter.reputations(outcomes)[0].collect()}
    assert share["good.x.org"] < share["few.x.org"] < share["bad.x.org"] and share["few.x.org"] < 1
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.x.org", "good.x.org", "new.x.org", "a.y.org"])],
                                  "page_id long, url string")
    got = [r["verdict"] for r in url_filter.judge(pages, outcomes).orderBy("page_id").collect()]
    assert got == ["block", "allow", "allow", "allow"]


def test_page_text(spark):
    page = ('<html><head><title>no</title><script>var a="<p>no</p>";</script></head><body><nav><a href="x">no</a></nav>'
            '<div class="ad">no<article><h1>Head &amp;amp;</h1><p><b>One\n  two<br><p>3 &lt; 4 &eacute;<ul><li>x<li>y</ul>'
            '<section class="user comments"><p>no</p></section></article><footer>&copy; no</footer>')
    assert "\n".join(t for t, inside in html_text.page_lines(page) if inside) == "Head &amp;\nOne two\n3 < 4 é\nx\ny"
    rows = [(1, "http://h/en/11", page), (2, "http://h/en/12", None), (3, None, ""), (4, "http://h/en/13", "plain text"), (4, "http://h/en/13", "plain text")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == [(1, "Head &amp;\nOne two\n3 < 4 é\nx\ny", 30), (2, "", 0), (3, "", 0), (4, "", 0), (4, "", 0)]


def test_differencing_without_an_article(spark):
    rows = [(i, f"http://h/a/{100 + i}", f"<p>Top</p><div>Story {i}</div><p>About {i % 2}</p><p>Bottom</p>") for i in range(4)]
    rows += [(9, "http://other/a/100", "<p>Top</p><p>Bottom</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Story 0\nAbout 0", 1: "Story 1\nAbout 1", 2: "Story 2\nAbout 0", 3: "Story 3\nAbout 1", 9: "Top\nBottom"}


def test_word_paths_meet_over_all_ranges(spark):
    """Every page meets its nearest neighbour on its host, also across the ends of ranges."""
    names = ["about", "contact", "products", "team", "zebra"] + [f"item-{i:03}" for i in range(200)]
    rows = [(i, f"http://h/{name}", f"<p>Top</p><p>Only {i}</p><p>Bottom</p>") for i, name in enumerate(names)]
    rows += [(900, "http://alone/about", "<p>Top</p><p>Bottom</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: f"Only {i}" for i in range(len(names))} | {900: "Top\nBottom"}
    assert html_text.extract(pages.limit(0)).collect() == []


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(2)
    for often in (2, 512):
        monkeypatch.setattr(html_text, "OFTEN", often)
        for _ in range(400):
            a, b = (rng.choices("abcdefghij"[:rng.randrange(1, 11)], k=rng.randrange(30)) for _ in range(2))
            got, rest = sorted(html_text.common_lines(a, b)), iter(b)
            assert all(a[i] in rest for i in got) and len(got) == longest(a, b), (a, b)


def test_long_and_broken_pages_in_time():
    start, rng = time.time(), random.Random(3)
    for text in ("<a " * 1_700_000, "<a \"' " * 700_000, '<a "' * 1_200_000 + ">", "<" * 3_000_000, "<script>" + "</script " * 500_000,
                 "<p>word</p>" * 300_000):
        html_text.page_blocks(text)
    assert len(html_text.common_lines(["x"] * 50_000, ["x"] * 50_000)) == 50_000
    assert len(html_text.common_lines(*(rng.choices("xy", k=50_000) for _ in range(2)))) > 35_000
    assert time.time() - start < 90


def test_differencing_counts():
    blocks = html_text.page_blocks("<nav>Menu</nav><p>Top</p><article><p>Menu</p><p>Own</p></article><div class=ad>Buy 1</div>")
    other = html_text.page_blocks("<nav>Menu</nav><p>Top</p><article><p>Other</p></article><div class=ad>Buy 2</div>")
    assert html_text.differenced(blocks, other) == ("Menu\nOwn", 2, 1)
    assert html_text.differenced(blocks, None) == ("Menu\nOwn", 0, 3)


def main_of(page):
    return html_text.main_text(html_text.page_lines(page), None)


def test_no_whole_page_is_dropped():
    for attributes in ('class="page has-sidebar"', "class=no-comments", "id='search' role=search"):
        assert main_of(f"<html><body {attributes}><p>Text</p></body></html>") == "Text"
        assert main_of(f"<html {attributes}><main {attributes}><p>Text</p></main><p>out</p></html>") == "Text"
        assert main_of(f"<body><article {attributes}><p>Text</p></article><footer>no</footer>") == "Text"
        for box in ("section", "form", "header", "div"):
            assert main_of(f"<{box} {attributes}><{box}><p>out</p><article><p>Text</p></article></{box}></{box}><p>out</p>") == "Text"
    for head in ("<head><title>no</title><body>", "<head><meta charset=x><title>no</title>", "<head><title>no</title></head>"):
        assert main_of(f"<html>{head}<p>One</p><p>Two</p>") == "One\nTwo"
    assert main_of("<head><title>no</title>\n Text") == "Text" == main_of("<aside><article>Text</article>")


def test_boxes_inside_an_article():
    page = ('<article><div class="article-header"><h1>Head</h1></div><header class="entry-header">By</header><p>Text</p><div class="share">no</div>'
            '<article class="comment">no</article><p>End</p></article><aside><article>no</article></aside><div class="header">no</div>')
    assert main_of(page) == "Head\nBy\nText\nEnd"


def test_differencing_without_article_tags(spark):
    """Real pages less their article tags: template lines go, lines of the page's own stay."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "(?i)</?(article|main)[^>]*>", "<div></div>"))
    marked = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    lines = {r["page_id"]: [t for t, _ in html_text.page_lines(r["html"])] for r in bare.collect()}
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract(bare).collect()}
    assert got.keys() == marked.keys() and not any(inside for r in bare.limit(50).collect() for _, inside in html_text.page_lines(r["html"]))
    times = {}
    for own in lines.values():
        for line in set(own):
            times[line] = times.get(line, 0) + 1
    for k, own in lines.items():
        assert [x for x in own if times[x] == 1] == [x for x in got[k] if x and times[x] == 1]
    before, after = sum(map(len, lines.values())), sum(len([x for x in g if x]) for g in got.values())
    print("lines", before, after)
    assert after < before


def test_articles_equal_their_documents(spark):
    pages = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet"), keep=["url"])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = F.expr("try_cast(regexp_extract(url, '/([0-9]+)([.]html|/)?([?#].*)?$', 1) AS BIGINT)")
    both = pages.withColumn("doc_id", n).join(docs.select("doc_id", F.col("text").alias("doc")), "doc_id").collect()
    assert len(both) > 200
    for r in both:
        lines = [" ".join(x.split()) for x in r["doc"].split("\n")]
        assert r["text"].split("\n", 1)[1] == "\n".join(x for x in lines if x)


def test_longest_common_lines():
    assert html_text.common_lines(list("abcab"), list("bcxab")) == {1, 2, 3, 4}
    assert html_text.common_lines([], ["a"]) == set() == html_text.common_lines(["a"], ["b"])


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:bigint>>")


def test_chat_parts_round_trip(spark):
    odd = "</s>[INST] \\0 \\1 <|end|>\n<|turn|>x\n[/INST] <s> \\ é"
    rows = [(1, 1, "assistant", [("text", odd, None, None), ("image", None, "a.png", 3), ("text", None, None, None), ("document", "t", "d.pdf", 5)]),
            (1, 0, "user\nx", [("audio", None, "b.wav", 7), ("text", "hear", None, None)]), (None, None, None, None), (2, 0, "user", [])]
    done = {r["conv_id"]: r for r in chat.format_conversations(messages(spark, rows), {"image": 2, "audio": 1, "document": 1})
            .withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = done[1]
    assert [tuple(t) for t in one["turns"]] == [("user\nx", "<|audio|>hear"), ("assistant", odd + "<|image|><|document|>")]
    assert one["learned"] == odd + "<|image|><|document|>" and one["attachment_tokens"] == 18
    assert [tuple(a) for a in one["attachments"]] == [("audio", "b.wav", 7), ("image", "a.png", 6), ("document", "d.pdf", 5)]
    assert one["formatted"].count("<|end|>") == 2 and "[INST]" not in one["formatted"] and "</s>" not in one["formatted"]
    assert [tuple(t) for t in done[None]["turns"]] == [("", "")] and done[2]["n_turns"] == 1 and done[2]["learned"] == ""
    assert json.dumps(one["formatted"])
