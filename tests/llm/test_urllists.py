import duckdb
from pyspark.sql import functions as F

from pixelweave.llm import queries, urllists


def test_query_equals_its_sql(spark, sf):
    for where in (sf, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{where}/pages.parquet'")
        df = queries.op5_url_lists(spark, where)
        got = sorted(map(str, (tuple(r) for r in df.collect())))
        want = sorted(map(str, con.execute(queries.OP5_SQL).fetchall()))
        assert got == want
        assert any("True" in x for x in got) and any("False" in x for x in got)


def active(url, at, entries):
    """Brute force over all entries, event by event."""
    from urllib.parse import urlsplit

    parts = urlsplit(url or "")
    host = (parts.hostname or "").lower()
    last = {}
    for kind, pattern, category, when, action in entries:
        if None in (kind, pattern, when, action) or action not in ("add", "remove") or at is None or when > at or not host:
            continue
        p = pattern.lower() if kind != "prefix" else pattern.split("/")[0].lower() + pattern[len(pattern.split("/")[0]) :]
        whole = host + parts.path
        fits = {"host": host == p, "domain": host == p or host.endswith("." + p), "prefix": whole.startswith(p) if p.endswith("/") else whole == p or whole.startswith(p + "/")}.get(kind, False)
        if fits:
            k = (kind, p, category or "")
            last[k] = max(last.get(k, (when, action)), (when, action))
    return sorted(k for k, v in last.items() if v[1] == "add")


def test_intervals_ties_nulls_and_clashes(spark):
    entries = [
        ("host", "a.example.com", "spam", 10, "add"), ("host", "a.example.com", "spam", 20, "remove"), ("host", "A.example.com", "spam", 30, "add"), ("host", "a.example.com", "spam", 30, "add"),
        ("domain", "example.com", "adult", 15, "add"), ("domain", "example.com", "adult", 15, "remove"), ("domain", "example.com", "adult", 25, "add"),
        ("prefix", "b.example.org/x/", None, 5, "add"), ("prefix", "b.example.org/", "spam", 50, "add"), ("host", None, "spam", 1, "add"), ("host", "c", "spam", None, "add"), ("host", "c", "spam", 3, "odd"),
        ("prefix", "B.example.org/Case/Path", "case", 1, "add"), ("prefix", "b.example.org/x", "below", 12, "add"), ("prefix", "d.example.org", "all", 1, "add"), ("domain", "c", "label", 15, "add"), ("domain", "org", "label", 25, "add"), ("odd", "c", "spam", 1, "add"),
    ]
    urls = ["http://a.example.com/p", "https://user@A.EXAMPLE.com:8080/p/q?x#y", "http://notexample.com/", "http://b.example.org/x/y/z", "http://b.example.org/xy", "http://b.example.org", "/relative", None, "", "http://c/", "http://long.example.com/" + "s/" * 500, "http://b.example.org/case/path", "http://b.example.org/Case/Path", "http://b.example.org/Case/Path/z?q", "http://b.example.org/Case/Pathology", "http://b.example.org/x", "http://b.example.org/x/", "http://d.example.org", "http://d.example.org//x//"]
    rows = [(k, u, t) for k, (u, t) in enumerate((u, t) for u in urls for t in (9, 10, 15, 19, 20, 25, 29, 30, 60, None))]
    captures = spark.createDataFrame(rows + rows[:3], "id long, url string, fetched_at long").withColumn("category", F.lit("c")).withColumn("blocked", F.lit("x")).withColumn("kind", F.lit(1))
    listed = spark.createDataFrame(entries, "kind string, pattern string, category string, at long, action string")
    got = urllists.evaluate(captures, listed).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        want = active(r.url, r.fetched_at, entries)
        assert (r.n_active, r.categories, r.blocked) == (len(want), ",".join(sorted({k[2] for k in want})), bool(want)), r
    assert urllists.evaluate(captures, listed.limit(0)).filter("blocked").count() == 0
    assert urllists.evaluate(captures.limit(0), listed).count() == 0
