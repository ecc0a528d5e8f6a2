import hashlib
import random

import numpy as np
import pytest

from editlore.llm import common, link_trust, merkle, page_text

PAGES = "html string, page_id long, url string, host string, path string, digest string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(h, i, u, "h", "p", "d", "t") for i, u, h in rows], PAGES)


PAGE = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><li><a href='/x'>menu</a></nav><!-- <p>no</p> -->"
        "<div class=\"cookie-notice\">cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n text<br>next<p>Second &lt;i&gt;"
        "<form>field</form><aside>beside</aside><div class='comments'><p>reader</p></div><footer>end</footer></article><footer>foot</footer></body></html>")


def test_article_lines():
    assert [line for line, kind in page_text.page_lines(PAGE) if kind == page_text.KEEP] == ["Head & line", "First bold text next", "Second <i>"]


@pytest.mark.parametrize("page", ["", "<", "<<<>>>", "</p></div>", "<script>", "<p class=\"a>b", "<!-- open", "a & b &amp", "<p>" * 3000, "<a '" * 3000])
def test_broken_pages(page):
    page_text.page_lines(page)


def test_common_lines_are_longest():
    rng = random.Random(8)
    for _ in range(300):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 12))], np.uint64) for _ in range(2))
        got = a[page_text.common_lines(a, b)].tolist()
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        rest = iter(b.tolist())
        assert len(got) == table[-1, -1] and all(x in rest for x in got)


def site(n):
    rows = []
    for k in range(n):
        body = f"<div><p>site name</p><p>story {k} begins</p><p>story {k} ends</p><p>all rights</p></div>"
        rows.append((k, f"http://Site{k % 2}.org/a/{k:03d}?q=1", body))
    return rows


@pytest.mark.parametrize("shuffles", ["1", "4", "30"])
def test_repeated_lines_go(spark, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        rows = site(20) + [(100, None, "<p>alone</p>"), (101, "http://one.org", None), (102, "http://two.org/x", PAGE), (103, "http://two.org/y", PAGE), (104, "http://long.org/", "<p>" + "word " * 50_000)]
        got = {r.page_id: r for r in page_text.main_text(pages(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for k in range(20):
        assert got[k].text == f"story {k} begins story {k} ends" and got[k].n_chars == len(got[k].text)
    assert got[100].text == "alone" and got[101].text == "" and got[104].n_chars == 249_999
    assert got[102].text == got[103].text == "Head & line First bold text next Second <i>"


def test_differencing_decides_beside_a_marked_article(spark):
    rows = [(k, f"http://news.org/{k}", f"<div>site name</div><div><p>body {k} begins</p><p>body {k} ends</p></div><article>teaser</article><div class='ad'>advert {k}</div>") for k in range(4)]
    got = {r.page_id: r.text for r in page_text.main_text(pages(spark, rows)).collect()}
    assert got == {k: f"body {k} begins body {k} ends teaser" for k in range(4)}


@pytest.mark.parametrize("shuffles", ["1", "3", "30"])
def test_copies_are_paired_with_a_different_page(spark, shuffles):
    story = lambda k: f"<p>site name</p><p>story {k} begins</p><p>story {k} ends</p>"
    rows = [(k, f"http://a.org/{k:02d}", story(k)) for k in range(3)]
    rows += [(k, "http://a.org/05?q=%d" % k, story("copied")) for k in range(10, 40)] + [(40, "http://a.org/05", story("copied"))] * 2  # queries, repeated rows
    rows += [(k, f"http://a.org/06/{k}", story("copied")) for k in range(50, 80)] + [(90, "http://a.org/9", story("last"))]  # mirrors
    rows += [(k, f"http://only.org/{k}", story("only")) for k in range(100, 120)] + [(k, f"http://pair.org/{k // 20}", story(k // 20)) for k in range(120, 160)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        got = page_text.main_text(pages(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    name = lambda i: i if i < 3 else "copied" if i < 90 else "last" if i == 90 else i // 20
    want = [(i, "site name story only begins story only ends" if 100 <= i < 120 else f"story {name(i)} begins story {name(i)} ends") for i, _, _ in rows]
    assert sorted((r.page_id, r.text) for r in got) == sorted(want)


def test_no_pages(spark):
    assert page_text.main_text(pages(spark, [])).collect() == []
    assert link_trust.judged(pages(spark, []), link_trust.RULES).collect() == []


def test_rules(spark):
    urls = {1: ("http://A.com/x?y", "a.com", "/x", "com/", "allow"), 2: ("https://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
            3: ("x://m.www.Example.com/en/#z", "m.www.example.com", "/en/", "www.example.com/en/", "allow"), 4: ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
            5: ("http://com", "com", "", None, "allow"), 6: ("nothing", "", "", None, "allow"), 7: (None, "", "", None, "allow"),
            8: ("a://b://c.net/fr/", "b:", "//c.net/fr/", None, "allow"), 9: ("http://xcom/", "xcom", "/", None, "allow"), 10: ("http://É.Org/é\n?", "É.org", "/é\n", None, "allow")}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_trust.judged(pages(spark, [(k, v[0], None) for k, v in urls.items()]), link_trust.RULES).collect()}
    assert got == {k: v[1:] for k, v in urls.items()}


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/p'>x</a>" for h in hosts)
    rows = [(1, "http://good.com/", link("near.org", "near.org")), (2, "http://near.org/", link("far.org")), (3, "http://bad.net/es/", ""), (4, "http://bad.net/fr/", None),
            (5, "http://friend.org/", link("bad.net")), (6, "http://friend2.org/", link("FRIEND.org", "friend2.org")), (7, "http://far.org/", ""), (7, "http://far.org/", "")]
    got = {r.page_id: r.verdict for r in link_trust.judged(pages(spark, rows), link_trust.RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}


def test_ranks_equal_power_iteration(spark):
    rng = random.Random(9)
    hosts = [f"h{k}" for k in range(8)]
    edges = {(a, b): rng.randint(1, 3) for a in hosts for b in hosts if a != b and rng.random() < 0.3}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "source string, target string, n long")
    got = {r.host: r for r in link_trust.spread(frame, spark.createDataFrame([("h0", 2, 0), ("h1", 1, 1)], "host string, allowed long, blocked long"), rounds=200, tolerance=1e-12).collect()}
    for name, seeds, way in (("trust", {"h0": 2 / 3, "h1": 1 / 3}, edges), ("distrust", {"h1": 1.0}, {(b, a): n for (a, b), n in edges.items()})):
        rank = dict(seeds)
        for _ in range(300):
            new = {h: 0.15 * seeds.get(h, 0) for h in hosts}
            for (a, b), n in way.items():
                new[b] += 0.85 * rank.get(a, 0) * n / sum(m for (x, _), m in way.items() if x == a)
            rank = new
        for h in hosts:
            assert abs((got[h][name] if h in got else 0) - rank[h] / sum(rank.values())) < 1e-6


def test_trust_reaches_far_hosts(spark):
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(33)], "source string, target string, n long")
    got = {r.host: r.trust for r in link_trust.spread(edges, spark.createDataFrame([("h0", 1, 0)], "host string, allowed long, blocked long")).collect()}
    assert abs(got["h33"] / got["h0"] - 0.85 ** 33) < 1e-9


def records(spark, rows):
    return spark.createDataFrame([(o, hashlib.sha256(t.encode()).hexdigest()) for o, t in rows], "offset long, digest string")


def test_audit_finds_and_only_finds_damage(spark):
    rows = [(k * 37, f"r{k}") for k in range(400)]
    other = [r for r in rows if r[0] != 37 * 5] + [(37 * 5 + 1, "new")]
    other = [(o, "bad") if o in (0, 37 * 200) else (o, t) for o, t in other]
    found, visited = merkle.audit(records(spark, rows), records(spark, other), fan=4, range_bytes=100)
    assert {(r.offset, r.state) for r in found.collect()} == {(0, "altered"), (37 * 200, "altered"), (37 * 5, "missing"), (37 * 5 + 1, "extra")}
    leaves = visited.filter("level = 0").count()
    assert leaves <= 4 and visited.count() < 30
    same, none = merkle.audit(records(spark, rows), records(spark, rows), fan=4, range_bytes=100)
    assert same.collect() == [] and none.collect() == []


def test_audit_of_empty_replicas(spark):
    some, nothing = records(spark, [(0, "a"), (70_000, "b")]), records(spark, [])
    assert merkle.audit(nothing, nothing)[0].collect() == []
    assert {(r.offset, r.state) for r in merkle.audit(some, nothing)[0].collect()} == {(0, "missing"), (70_000, "missing")}


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 50), rng.randint(0, 9), "x") for _ in range(300)] + [(7, 5, None)] * 3
    got = sorted((r.k, r.before, r.n) for r in common.running(spark.createDataFrame(rows, "k long, n long, other string"), ["k", "n"], "n", "before").collect())
    at = 0
    for k, before, n in sorted(got, key=lambda r: (r[0], r[1], r[2])):
        assert before == at
        at += n
    assert common.running(spark.createDataFrame([], "k long, n long"), ["k"], "n", "before").collect() == []
