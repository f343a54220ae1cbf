import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filter as u

CASES = {
    None: ("", "", None), "no scheme": ("", "", None), "http://": ("", "", None), "HTTP://A.NET/x?y": ("a.net", "/x", "net/"), "http://net": ("net", "", None), "http://net/": ("net", "/", "net/"),
    "https://m.Example.net/en/1#a": ("m.example.net", "/en/1", "example.net/en/"), "http://example.net/EN/": ("example.net", "/EN/", "net/"), "http://badexample.net/en/": ("badexample.net", "/en/", "net/"), "x://example.com/de/?q": ("example.com", "/de/", "example.com/de/"),
    "x://example.com/de": ("example.com", "/de", None), "x://a.org/fr/y": ("a.org", "/fr/y", "org/fr/"), "http://a.com#/x://b.net/": ("a.com", "", None), "http://É.net?x": ("É.net", "", None), "a://b://c.net/": ("b:", "//c.net/", None), "http://u@h.net:80/p\nq": ("u@h.net:80", "/p\nq", None), "http://x.net/p\nq": ("x.net", "/p\nq", "net/"),
}
LABELS = "doc_id long, quality int, toxic int"


def pages(spark, urls):
    return spark.createDataFrame([(i, x, "h", "v") for i, x in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.filter_urls(pages(spark, CASES), spark.createDataFrame([], LABELS)).collect()}
    for i, (host, path, rule) in enumerate(CASES.values()):
        assert got[i] == (host, path, rule, "block" if rule in ("net/", "example.com/de/") else "allow"), list(CASES)[i]


def test_poor_hosts_are_blocked_and_rules_win(spark):
    urls = [f"http://bad.site.info/{i}" for i in range(60)] + [f"http://good.place.info/{i}" for i in range(200)] + ["http://bad.site.info/extra", "http://a.org/fr/1"]
    labels = [(i, 0, 1) for i in range(50)] + [(i, 1, 0) for i in range(60, 230)] + [(261, 0, 1), (None, 0, 1), (3, None, None)]
    got = {r["page_id"]: r["verdict"] for r in u.filter_urls(pages(spark, urls), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[260] == got[55] == "block" and got[240] == "allow" and got[261] == "allow"


def test_shrinkage(spark):
    outcomes = [("a.x.com", 1)] + [("b.x.com", 0)] * 50 + [("c.y.com", 1)] * 2 + [("d.y.com", 0)] * 40
    hosts, domains, _, mean = u.levels(spark.createDataFrame(outcomes, "host string, bad int"))
    r = {x["host"]: x for x in hosts.collect()}
    assert r["b.x.com"]["rate"] < r["a.x.com"]["rate"] < 1 and r["a.x.com"]["over"] > r["b.x.com"]["over"] and 0 < mean < 0.1
    assert {x["domain"] for x in domains.collect()} == {"x.com", "y.com"}


def test_suffixes_and_domains(spark):
    cases = {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("com", "x.com"), "w.x.com": ("com", "x.com"), "com": ("com", "com"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "u@h.net:80": ("net", "h.net"), "": ("", ""), "a.co.info": ("info", "co.info")}
    df = spark.createDataFrame([(h,) for h in cases], "h string").withColumn("host", u.bare(F.col("h")))
    got = {r["h"]: (r["s"], r["d"]) for r in df.select("h", u.public_suffix(F.col("host")).alias("s"), u.registered_domain(F.col("host")).alias("d")).collect()}
    assert got == cases


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_posterior_probability(spark, least):
    rng = np.random.default_rng(0)
    cases = [(0.2, 0.3), (1.0, 1.0), (3.0, 9.0), (60.0, 40.0), (0.05, 4.0), (900.0, 1000.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    for r in df.select("a", "b", u.probability_over(F.col("a"), F.col("b"), least).alias("p")).collect():
        assert abs(r["p"] - (rng.beta(r["a"], r["b"], 400_000) > least).mean()) < 0.004
    whole = spark.createDataFrame([(4.0, 3.0)], "a double, b double").select(u.probability_over(F.col("a"), F.col("b"), 0.5).alias("p")).first()["p"]
    assert whole == pytest.approx(42 / 64, abs=1e-6)  # of six tosses, three heads at most


def test_empty_repeated_and_many_rules(spark):
    none = spark.createDataFrame([], LABELS)
    assert u.filter_urls(pages(spark, ["http://a.net/"]).limit(0), none).count() == 0
    two = pages(spark, ["http://a.net/"])
    assert u.filter_urls(two.unionAll(two), none).count() == 2
    with pytest.raises(ValueError):
        u.rule_of([("block", f"h{i}", "/") for i in range(1001)])
