import os
import random
import subprocess
import sys

import numpy as np
import pytest

from canlake.llm import embdedup, htmlmain, urlfilter
from canlake.llm.components import components


def test_url_filters_equal_a_plain_loop(spark):
    urls = [
        "http://a.example.org/es/x", "https://EXAMPLE.org/en/15?q", "http://example.org", "http://x.org/", "http://b.com/de/1#t", "http://b.com/fr/2", "http://b.com/en", "ftp://com/de/", None, "", "no scheme/org/",
        "http://notexample.org/es/", "http://org/es/", "http://a.b.c.example.org/en/1", "http://example.org/en/2", "x://y.example.net/://z.org/", "http://a..org/", "http://" + "a." * 300 + "com/de/",
    ]
    rows = [(k, u, "extra") for k, u in enumerate(urls)] + [(None, urls[0], "extra"), (0, urls[0], "extra")]

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(h + p, a) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, "allow"))

    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urlfilter.judge(pages, urlfilter.rules_table(spark)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=key) == sorted(((i, *plain(u)) for i, u, _ in rows), key=key)
    none = spark.createDataFrame([], "action string, rule_host string, rule_path string")
    assert {r["verdict"] for r in urlfilter.judge(pages, none).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark)).count() == 0


def test_url_filters_with_many_rules_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", 4)
    monkeypatch.setattr(urlfilter, "LISTED_LENGTHS", 10)
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 50)
    rules = [("block", f"h{k % 40}.x", "/" + "p" * (k % 23)) for k in range(300)]
    urls = [(k, f"http://s.h{k % 50}.x/" + "p" * (k % 31) + "?q") for k in range(400)]
    got = {r["page_id"]: r["rule"] for r in urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string"), urlfilter.rules_table(spark, rules)).collect()}
    for k, u in urls:
        host, path = u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0]
        fit = [h + p for _, h, p in rules if host.endswith("." + h) and path.startswith(p)]
        assert got[k] == max(fit, key=len, default=None)


def brute(rows, threshold=0.98):
    links, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(i, np.array(v, float) / np.linalg.norm(v), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, *_ in rows:
        links[i], parent[i] = 0, i
    for k, (a, va, la) in enumerate(good):
        for b, vb, lb in good[:k]:
            if la == lb and len(va) == len(vb) and va @ vb >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = []
    for c in range(30):
        center = rnd.normal(size=16)
        rows += [(len(rows) + k, (center + rnd.normal(size=16) * 0.04).tolist(), c % 2) for k in range(12)]
    n = len(rows)
    rows += [(n + k, rows[0][1], 0) for k in range(5)] + [(n + 5, None, 0), (n + 6, [0.0] * 16, 0), (n + 7, [float("nan")] * 16, 0), (n + 8, rows[0][1], None), (n + 9, [None, 1.0], 0), (n + 10, [1.0, 0.0], 0), (n + 11, [], 0)]
    rows += [(n + 12, [2 * x for x in rows[0][1]], 0), (n + 13, [1e300, 1e300], 1), (n + 14, [1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    want = brute(rows)
    want[n + 13], want[n + 14] = (1, n + 13), (1, n + 13)
    for shard in (4096, 40):
        monkeypatch.setattr(embdedup, "SHARD", shard)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(df).collect()}
        linked = sum(v[0] for v in want.values())
        assert abs(sum(v[0] for v in got.values()) - linked) <= 0.01 * linked and all(got[i][0] <= want[i][0] for i in want)
        assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_graph_search_recall():
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(1500, 24))
    v = np.concatenate([v, v[:300] + rnd.normal(size=(300, 24)) * 0.02])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pairs, audit = embdedup.find_links(v, v)
    found = [(int(a), int(b)) for q, at in pairs for a, b in zip(q, at, strict=True)]
    want = {(int(a), int(b)) for a, b in np.argwhere(v @ v.T >= 0.98)}
    assert audit["hits"] >= 0.99 * audit["true"] and audit["true"] >= 64 and audit["exact"] == 0
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.98 * len(want)


def test_joined_labels_equal_components():
    rnd = random.Random(7)
    root, parent = np.arange(300), list(range(300))
    for size in (1, 5, 60, 0, 40):
        edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(size)] + [(k, k + 1) for k in range(size)]
        embdedup.joined(root, np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))
        for a, b in edges:
            x, y = sorted((parent[a], parent[b]))
            parent = [x if p == y else p for p in parent]
        assert root.tolist() == parent


def sparse(n=1200, twins=60):
    """Vectors of one label of which few have a near copy -> rows, true number of links of each."""
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(n, 24))
    v = np.concatenate([v, v[:twins] + rnd.normal(size=(twins, 24)) * 0.02])
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return rows, ((v @ v.T >= 0.98).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("shard", [4096, 700, 200])
def test_sparse_links_are_found_at_several_shard_counts(spark, monkeypatch, shard):
    rows, want = sparse()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert 100 <= sum(want) <= 140
    monkeypatch.setattr(embdedup, "SHARD", shard)
    report = {}
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_duplicates(df, report=report).collect()}
    print("shards of", shard, "recall of links", sum(got.values()) / sum(want), report)
    assert sum(got.values()) >= 0.98 * sum(want) and all(got[i] <= n for i, n in enumerate(want))
    assert report["hits"] >= 0.99 * report["true"] and report["true"] >= 64 and report["exact"] == 0


def test_graphs_that_miss_are_audited(spark):
    class Blind(embdedup.Graph):
        """Finds one node for each query, whichever is asked for."""

        def search(self, queries, beam):
            return np.zeros((len(queries), 1), int), queries @ self.vectors[:1].T

    rows, want = sparse()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    report = {}
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_duplicates(df, graph=Blind, report=report).collect()}
    assert [got[i] for i in range(len(want))] == want and report["exact"] == report["queries"]


def test_a_dense_group_is_counted_whole(spark):
    rnd = np.random.default_rng(4)
    v = np.concatenate([rnd.normal(size=(1, 16)) + rnd.normal(size=(400, 16)) * 0.01, rnd.normal(size=(100, 16))])
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = embdedup.near_duplicates(df).collect()
    assert all((r["n_links"], r["component_id"]) == ((399, 0) if r["vec_id"] < 400 else (0, r["vec_id"])) for r in got)


SHIPPED = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", {tmp!r}).config("spark.checkpoint.dir", "file://" + {tmp!r}).getOrCreate()
from canlake.llm import embdedup, htmlmain, langid, ngramjoin, spiece, suffix, toxicity
docs = spark.createDataFrame([(k, "some words of text number %d and more of it " % (k % 3) * 9, "en", k % 2) for k in range(8)], "doc_id long, text string, lang string, toxic int")
assert langid.predict(docs, langid.fit(docs)).count() == 8
assert toxicity.scores(docs, toxicity.fit(docs, docs)).count() == 8
assert ngramjoin.similar(docs.select(F.col("doc_id").alias("key"), "text")).where("n_links > 0").count() == 8
assert suffix.remove_repeats(docs, ["doc_id"]).where("n_removed > 0").count() == 8
assert spiece.encode(docs).count() == 8
assert htmlmain.main_text(docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"))).count() == 8
vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id") + 0.5).alias("embedding"), F.col("toxic").alias("label"))
assert embdedup.near_duplicates(vectors).count() == 8
try:
    import subprocess
    assert spark.range(1).mapInArrow(lambda b: (__import__("canlake"), b)[1], "id long").count()
except Exception as e:
    assert "No module named" in str(e)
    print("SHIPPED")
"""


def test_workers_need_no_package(tmp_path):
    """From a working folder outside the repository, workers can't import the package; all Python operators still run."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SHIPPED.format(repo=repo, tmp=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SHIPPED" in run.stdout, run.stderr[-3000:]


def test_components_of_random_graphs_and_chains(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    ("<p>One&nbsp;&amp; <b>two</b>three<p>Four<br>five", "One & twothree\nFour five"),
    ("<body><nav>menu</nav><article><h1>T</h1><p>a <i>b</i></p><div class='comments'>c</div><aside>d</aside></article><footer>e</footer></body>", "T\na b"),
    ("<main><ul><li>x<li>y</ul><script>'<p>no</p>'</script><style>p{}</style><form>f</form></main><p>out", "x\ny"),
    ("<p>unclosed <b>tags <!-- note --> stay &lt;here&gt; &quo", "unclosed tags stay <here> &quo"),
    ("<div id=cookie-notice>n</div><div>kept</div><script>never closed <p>x", "kept"),
    ("<div class='page no-sidebar'><p>main</p><div class='left sidebar'>gone</div></div><div class='nav-wrap'><main>kept</main>x</div>", "kept"),
    ("<div class='page no-sidebar'><p>main</p><div class='left sidebar'>gone</div></div>", "main"),
    ("plain text only\n\n  spaced", "plain text only spaced"),
    ("", ""),
    (None, ""),
    ("<article>" + "<p>long words</p>" * 20000 + "</article>", "\n".join(["long words"] * 20000)),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_one_page(page, want):
    assert "\n".join(htmlmain.kept_blocks(page or "")) == want


def test_deep_and_broken_pages_take_linear_time():
    import time

    deep = "<div>" * 30_000 + "inner" + "</div>" * 30_000
    mixed = "".join(f"<div>t{k}" for k in range(20_000))
    quotes = "<p title=\"x>never closed " * 20_000 + "<p>end 'x"
    start = time.time()
    assert htmlmain.kept_blocks(deep, frozenset({1})) == ["inner"]
    assert htmlmain.kept_blocks(mixed, frozenset({1})) == [f"t{k}" for k in range(20_000)]
    assert htmlmain.kept_blocks(quotes)[-1] == "end 'x" and htmlmain.kept_blocks("<" * 50_000) == ["<" * 50_000]
    assert htmlmain.kept_blocks("</x>" * 20_000 + "<!-- " * 20_000) == []
    assert time.time() - start < 20


def test_host_counts_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for k in range(160):
        host = f"h{min(k % 9, 3)}.x"
        parts = [f"<div><ul><li>menu {rnd.randrange(3)}</li></ul></div>", f"<nav><a>nav of {host}</a></nav>", f"<article><p>own {k}</p><div class=box>box {rnd.randrange(4)}</div><p>same words</p></article>", f"<footer>foot {k % 2}</footer>"]
        rnd.shuffle(parts)
        rows.append((k, f"http://{host}/{k}", "<body>" + "".join(parts[: rnd.randrange(1, 5)]) + "</body>"))
    rows += rows[:30]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    own, hosts, where, shaped = {}, {}, {}, {}
    for _, url, page in rows:
        host, (blocks, nodes) = url.split("/")[2], htmlmain.parse(page)
        content = tuple(b[0] for b in blocks)
        hosts.setdefault(host, set()).add(content)
        hashes = htmlmain.subtree_hashes(blocks, nodes)
        for h in {h for h in hashes if h is not None}:
            where.setdefault((host, h), set()).add(content)
            own.setdefault(page, set()).add(h)
        for h, (s, menu) in zip(hashes, htmlmain.shape_hashes(blocks, nodes), strict=True):
            if s is not None:
                shaped.setdefault((host, s, menu), {}).setdefault(h, set()).add(content)
                own.setdefault(page, set()).add(s)
    for least, share, many in ((5, 0.2, 200), (2, 0.5, 3), (3, 0.5, 10_000)):
        want = {(host, h) for (host, h), c in where.items() if len(c) >= least and len(c) >= min(share * len(hosts[host]), many)}
        own_rows = htmlmain.subtrees(htmlmain._keyed(pages))
        got = htmlmain.templates(own_rows, least, share, many).collect()
        assert {(r["host"], r["h"]) for r in got} == want and len(got) == len(want) and want
        forms = set()
        for (host, s, menu), texts in shaped.items():
            on = len(set().union(*texts.values()))
            if on >= least and on >= min(share * len(hosts[host]), many) and (menu or 2 * sum(len(c) >= least for c in texts.values()) >= len(texts)):
                forms.add((host, s))
        got = htmlmain.shapes(own_rows, least, share, many).collect()
        assert {(r["host"], r["s"]) for r in got} == forms and len(got) == len(forms) and forms
        monkeypatch.setattr(htmlmain, "BROADCAST_HASHES", 0 if least == 2 else 500_000)
        texts = {r["page_id"]: r["text"] for r in htmlmain.main_text(pages, least, share, many).collect()}
        for k, url, page in rows:
            host = url.split("/")[2]
            assert texts[k] == "\n".join(htmlmain.kept_blocks(page, frozenset(h for h in own.get(page, ()) if (host, h) in want | forms)))


def test_shapes_tell_boilerplate_without_articles_and_lists(spark):
    """Menus whose entries differ from page to page and slogans out of a few go by their shape, with neither articles nor
    lists of tags and classes to go by; what is written for a page stays, also where pages come twice."""
    rnd = random.Random(14)
    rows = []
    for k in range(40):
        menu = "".join(f"<li><a href=/{rnd.random()}>entry {rnd.randrange(10**6)}</a></li>" for _ in range(4))
        slogan = f"<div class='x{k}'>slogan {k % 4}</div>"
        text = f"<div class=c><h1>Head {k // 2}</h1><p>written for {k // 2} <a href=/l>with a link</a></p><p>second {k // 2}</p></div>"
        rows.append((k, f"http://h.x/{k}", f"<body><div><ul>{menu}</ul></div>{text}{slogan}</body>"))
    got = htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), lists=False, articles=False).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Head {k // 2}\nwritten for {k // 2} with a link\nsecond {k // 2}" for k in range(40)}
    few = htmlmain.main_text(spark.createDataFrame(rows[:4], "page_id long, url string, html string"), lists=False, articles=False).collect()
    assert all("entry" in r["text"] and "slogan" in r["text"] for r in few)  # too few pages to tell


def test_templates_inside_articles_go_and_running_text_stays(spark):
    box = "<div class='x'>read our guide</div>"
    rows = [(k, f"http://h.x/{k}", f"<body><article><p>own {k}</p>{box}<p>same words</p></article></body>") for k in range(12)]
    rows += [(20 + k, f"http://c.x/{k}", "<body><article><div>a copied page</div></article></body>") for k in range(12)]
    rows += [(40 + k, f"http://a.x/{k}", f"<body><article><div>all is template</div></article><nav>{k}</nav></body>") for k in range(12)]
    by = {r["page_id"]: r["text"] for r in htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by == {k: f"own {k}\nsame words" for k in range(12)} | {20 + k: "a copied page" for k in range(12)} | {40 + k: "all is template" for k in range(12)}


def test_templates_go_per_host(spark):
    rows = [(k, f"http://h.x/{k}", f"<body><div><p>same top</p></div><div><p>own {k}</p></div><p>rare</p></body>" if k < 2 else f"<body><div><p>same top</p></div><div><p>own {k}</p></div></body>") for k in range(8)]
    rows += [(50 + k, f"http://g.x/{k}", "<body><div><p>same top</p></div></body>") for k in range(3)] + [(60, None, None), (None, "", ""), rows[0]]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, blocks string")
    got = htmlmain.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[0] == "own 0\nrare" and by[5] == "own 5" and by[51] == "same top" and by[60] == "" and by[None] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got) and htmlmain.main_text(pages.limit(0)).count() == 0


def test_templates_are_counted_on_pages_with_articles(spark):
    menu = "<div><p>same menu</p></div>"
    rows = [(k, f"http://h.x/{k}", f"<body>{menu}<article><p>own article {k}</p></article></body>") for k in range(17)]
    rows += [(17 + k, f"http://h.x/{17 + k}", f"<body>{menu}<div><p>own page {k}</p></div></body>") for k in range(3)]
    rows += [(20, "http://h.x/20", f"<body>{menu}<article><p>small</p></article><div><p>the longer text of the page</p></div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r["page_id"]: r["text"] for r in htmlmain.main_text(pages).collect()}
    assert by == {k: f"own article {k}" for k in range(17)} | {17 + k: f"own page {k}" for k in range(3)} | {20: "small"}
