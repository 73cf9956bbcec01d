import datetime as dt
from collections import Counter

import duckdb

from sieveline.llm import urlfilter
from sieveline.llm.queries import QUERIES

DAY = dt.date(2024, 1, 1)


def test_keys(spark):
    urls = ["http://u:p@A.b.Example.com.:80/x//y?q#f", "https://h", "https://h/", "no url", "", "ftp://a.b?x=/y"]
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string").select(urlfilter.keys_of(df_col()).alias("k"), urlfilter.host_of(df_col()).alias("h"))
    got = [r.k for r in df.collect()]
    assert got[0] == ["a.b.example.com", "b.example.com", "example.com", "com", "a.b.example.com/x", "a.b.example.com/x/y"]
    assert got[1] == got[2] == ["h"] and not got[3] and not got[4] and got[5] == ["a.b", "b"]


def test_addresses_and_cases(spark):
    urls = {"http://10.1.2.3:8/A/b": ["10.1.2.3", "10.1.2.3/A", "10.1.2.3/A/b"], "http://[::1]:80/x": ["[::1]", "[::1]/x"], "HTTP://EXAMPLE.COM/A/B": ["example.com", "com", "example.com/A", "example.com/A/B"], "http://1.2.3.4.com": ["1.2.3.4.com", "2.3.4.com", "3.4.com", "4.com", "com"]}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", urlfilter.keys_of(df_col()).alias("k"))
    assert {r.url: r.k for r in df.collect()} == urls
    entries = [("EXAMPLE.com/A", DAY, "block"), ("2.3", DAY, "block"), ("[::1]", DAY, "block")]
    caps = [(1, "http://example.COM/A/x"), (2, "http://example.com/a/x"), (3, "http://10.1.2.3/"), (4, "http://[::1]/"), (5, "http://x.2.3/")]
    got = urlfilter.verdicts(spark.createDataFrame([(*c, DAY) for c in caps], "id long, url string, fetched date"), spark.createDataFrame(entries, "pattern string, at date, action string"))
    assert {r.id: r.pattern for r in got.collect()} == {1: "example.com/A", 2: None, 3: None, 4: "[::1]", 5: "2.3"}


def df_col():
    from pyspark.sql import functions as F

    return F.col("url")


def test_as_of(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    entries = [("x.com", d(10), "block"), ("x.com", d(20), "remove"), ("x.com", d(30), "block"), ("A.x.com", d(15), "allow"), ("a.x.com/p", d(16), "block"), ("t.com", d(5), "allow"), ("t.com", d(5), "block"), ("t.com", d(5), "block"), (None, d(1), "block"), ("n.com", None, "block"), ("o.com", d(1), "other")]
    caps = [(1, "http://a.x.com/p/q", d(9)), (2, "http://a.x.com/p/q", d(10)), (3, "http://a.x.com/p/q", d(15)), (4, "http://a.x.com/p/q", d(16)), (5, "http://b.x.com/", d(19)), (6, "http://b.x.com/", d(20)), (7, "http://b.x.com/", d(400)), (8, "http://t.com", d(5)), (9, None, d(5)), (10, "http://x.com", None), (None, "http://o.com", d(9)), (11, "http://n.com", d(9)), (11, "http://n.com", d(9)), (12, "junk", d(9))]
    e = spark.createDataFrame([(*x, 0) for x in entries], "pattern string, at date, action string, since int")
    c = spark.createDataFrame([(*x, 0) for x in caps], "id long, url string, fetched date, verdict int")
    got = Counter((r.id, r.verdict, r.pattern) for r in urlfilter.verdicts(c, e).collect())
    assert got == Counter([(1, "none", None), (2, "block", "x.com"), (3, "allow", "a.x.com"), (4, "block", "a.x.com/p"), (5, "block", "x.com"), (6, "none", None), (7, "block", "x.com"), (8, "block", "t.com"), (9, "none", None), (10, "none", None), (None, "none", None), (11, "none", None), (11, "none", None), (12, "none", None)])
    assert urlfilter.verdicts(c.limit(0), e).collect() == []
    assert {r.verdict for r in urlfilter.verdicts(c, e.limit(0)).collect()} == {"none"}


def test_sql_of_addresses(spark, tmp_path):
    urls = ["http://10.1.2.3:8/A/b", "http://[::1]:80/x", "HTTP://spam-farm.Example.ORG/en/x", "http://spam-farm.example.org/EN/x", "junk", None, ""]
    spark.createDataFrame([(i * 31, urls[i % 7], "h") for i in range(70)], "page_id long, url string, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = Counter(con.execute(f"select page_id, host, fetched, verdict, pattern, since from ({urlfilter.SQL}) where host is not null").fetchall())
    got = Counter(map(tuple, QUERIES["op7_urls"](spark, f"file://{tmp_path}").select("page_id", "host", "fetched", "verdict", "pattern", "since").collect()))
    assert {k: v for k, v in got.items() if k[1]} == {k: v for k, v in want.items() if k[1]} and sum(got.values()) == 70


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = Counter(con.execute(f"select page_id, host, fetched, verdict, pattern, since from ({urlfilter.SQL})").fetchall())
    got = Counter(map(tuple, QUERIES["op7_urls"](spark, sf).select("page_id", "host", "fetched", "verdict", "pattern", "since").collect()))
    assert got == want and len({k[3] for k in got}) == 3
