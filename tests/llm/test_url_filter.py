"""URL rules and the path-template tree against SQL and a plain model."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from tessera.llm import queries, url_filter

DATA = "/root/testdata/sf0.001"
PAGE = "page_id long, url string"


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://Sub.EXAMPLE.org/es/1", "x://example.org/en/12?q", "x://example.org/en/2#f", "x://badexample.org/es/1", "x://example.com/de/", "x://a.example.com/fr/x", "x://net", "x://org", "x://h.net/a/b/c/d?e", "x://h.net/a/b/c/d?e"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit(1)), queries.URL_RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("sub.example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("org/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[9] == ("net", "", None, "allow") and got[10][2] is None and got[11] == ("h.net", "/a/b/c/d", None, "allow")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).collect() == []


def test_templates_equal_sql(spark):
    con = duckdb.connect()
    more = "SELECT 1000 + i, 'x://h.example.com/' || CASE WHEN i % 4 = 0 THEN 'de/' WHEN i % 4 = 1 THEN 'fr/' ELSE 'en/' END || 'p' || chr(97 + (i % 20)::INT) || '/' || i, '' FROM range(300) t(i)"
    bad = "SELECT 2000 + i, 'x://bad.example.com/' || CASE WHEN i % 3 THEN 'de/' ELSE 'xx/' END || i, '' FROM range(90) t(i)"
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet' UNION ALL {more} UNION ALL {bad}")
    want = con.sql(url_filter.oracle_sql(queries.URL_RULES))
    pages = spark.createDataFrame(con.sql("SELECT page_id, url FROM pages").df())
    got = url_filter.judge(pages, queries.URL_RULES).select(want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    # The rules know this host by blocked urls alone, so the tree blocks its other section too.
    assert {r["verdict"] for r in got if r["path"].startswith("/xx/")} == {"block"}


def model(rows, z=2.0, smoothing=10.0, reject=0.7):
    """Host, segments and label of each url to its template and verdict, node by node."""

    def walk(urls, depth, template, out):
        names, by = {}, {}
        for u in urls:
            by.setdefault(u[1][depth] if depth < len(u[1]) else "", []).append(u)
        known = lambda us: [u[2] for u in us if u[2]]
        for name, us in by.items():
            here, own, apart = known(urls), known(us), False
            if own:
                share = here.count("block") / len(here)
                apart = abs(own.count("block") / len(own) - share) > max(z, math.sqrt(2 * math.log(len(by)))) * math.sqrt(share * (1 - share) / len(own))
            names.setdefault("" if name == "" else f"/{name}" if apart else "/*", []).extend(us)
        for name, us in names.items():
            if name == "":
                out.extend((id(u), u[0] + template) for u in us)
            else:
                walk(us, depth + 1, template + name, out)

    found = []
    for host in {r[0] for r in rows}:
        walk([r for r in rows if r[0] == host], 0, "", found)
    template = dict(found)
    labels = [r[2] for r in rows if r[2]]
    overall = labels.count("block") / len(labels) if labels else 0.0
    own = {}
    for r in rows:
        own.setdefault((r[0], template[id(r)]), []).append(r[2])
    purity = {t: (ls.count("block") + smoothing * overall) / (len(ls) - ls.count(None) + smoothing) for t, ls in own.items()}
    return [(template[id(r)], "block" if purity[r[0], template[id(r)]] >= reject else "allow") for r in rows]


def test_deep_trees_equal_a_plain_model(spark):
    """Rules on deep prefixes, known urls, paths of up to seven segments; the tree blocks urls that no rule decides."""
    rnd = random.Random(4)
    rules = [("a.net/forum/spam/", "block"), ("a.net/forum/good/", "allow"), ("b.net/x/y/z/w/1", "block"), ("b.net/x/y/v/", "allow")]
    word = lambda: rnd.choice(["red", "blue", "tin", "oak"])
    paths = [f"a.net/forum/{rnd.choice(['spam', 'good', 'other'])}/{word()}/t{rnd.randrange(99)}" for _ in range(400)]
    paths += [f"b.net/x/y/{rnd.choice(['z', 'v'])}/{rnd.choice(['w', 'u'])}/{rnd.randrange(1, 40)}/{word()}/{word()}" for _ in range(600)]
    paths += [f"c.net/{word()}/{'/'.join(word() for _ in range(rnd.randrange(6)))}" for _ in range(200)] + ["c.net/one/and/only/one/path/of/all"]
    known = [(f"http://c.net/red/{word()}/k", "block") for _ in range(80)] + [(f"http://c.net/oak/{word()}", "allow") for _ in range(60)]
    pages = [(i, f"http://{p}") for i, p in enumerate(paths)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, PAGE), rules, known=spark.createDataFrame(known, "url string, verdict string")).collect()}

    def row(url, verdict):
        host, _, path = url.removeprefix("http://").partition("/")
        return host, ["*" if any(c.isdigit() for c in s) else s for s in path.split("/") if s], verdict

    def says(p):
        fits = [(len(t), v) for t, v in rules if p.startswith(t)]
        return max(fits)[1] if fits else None

    rows = [row(u, says(u.removeprefix("http://"))) for _, u in pages]
    want = model(rows + [row(*k) for k in known])
    for i, (r, (template, verdict)) in enumerate(zip(rows, want, strict=False)):
        assert (got[i]["template"], got[i]["verdict"]) == (template, r[2] or verdict), pages[i]
    assert {v for (_, v), r in zip(want, rows, strict=False) if r[2] is None} == {"allow", "block"}
    assert any(t.split("/")[3:4] == ["v"] for t, _ in want)  # a segment below two wildcards keeps its name
