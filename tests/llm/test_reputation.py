import math

from symgrid.llm import reputation as R

from .fixtures import rows

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def site(host, ids):
    return [(i, f"https://{host}:8080/p/{i}?q=1", "x") for i in ids]


def test_host_domain_suffix(spark):
    cases = {
        "HTTP://User:pw@WWW.Example.co.uk.:80/x": ("www.example.co.uk", "example.co.uk", "co.uk"), "https://a.b.example.com/": ("a.b.example.com", "example.com", "com"),
        "http://192.0.2.7/x": ("192.0.2.7", "192.0.2.7", "ip"), "http://localhost": ("localhost", "localhost", "localhost"), "no url": ("", "", ""), "http://co.uk/": ("co.uk", "co.uk", "uk"),
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "u string")
    h = R.host(df["u"])
    got = {r[0]: tuple(r)[1:] for r in df.select("u", h, R.registered_domain(h), R.suffix(h)).collect()}
    assert got == {**cases, None: ("", "", "")}


def test_bad_hosts_go_and_few_labels_do_not_convict(spark):
    pages = site("bad.example.com", range(0, 60)) + site("good.example.org", range(100, 300)) + site("one.example.net", range(400, 402)) + site("new.good.example.org", range(500, 505))
    labels = [(i, 0, 0) for i in range(0, 50)] + [(i, int(i % 20 > 0), 0) for i in range(100, 300)] + [(400, 1, 1)]
    got = R.filter_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), keep_scores=True)
    left = {r["host"] for r in got.collect()}
    assert left == {"good.example.org", "one.example.net", "new.good.example.org"}
    rep = {r["host"]: r for r in R.reputations(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)).collect()}
    assert rep["bad.example.com"]["mean"] > 0.8 > rep["one.example.net"]["mean"] > rep["good.example.org"]["mean"]
    assert rep["new.good.example.org"]["labelled"] == 0 and rep["new.good.example.org"]["mean"] < 0.3


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.com/", "x"), (2, "http://a.com/", "x"), (2, "http://a.com/", "x")], PAGES).selectExpr("*", "1 as host", "2 as mean", "'x' as id")
    labels = spark.createDataFrame([(2, None, None), (None, 0, 1), (2, 1, None), (2, 1, None)], LABELS)
    got = R.filter_urls(pages, labels)
    assert got.columns == pages.columns and got.count() == 4
    none = spark.createDataFrame([], LABELS)
    assert R.filter_urls(pages, none).count() == 4 and R.filter_urls(spark.createDataFrame([], PAGES), labels).count() == 0
    assert rows(R.reputations(spark.createDataFrame([], PAGES), none)) == []


def beta_mass(a, b, x, n=20_000):
    """Mass of a beta distribution below x, by the midpoint rule in logarithms."""
    c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return sum(math.exp(c + (a - 1) * math.log((i + 0.5) * x / n) + (b - 1) * math.log1p(-(i + 0.5) * x / n)) for i in range(n)) * x / n


def test_lower_bound_is_the_quantile(spark):
    cases = [(2.0, 5.0), (5.0, 2.0), (30.0, 70.0), (400.0, 3.0), (1.5, 300.0), (250.0, 750.0)]
    df = spark.createDataFrame([*cases, (0.4, 9.0), (1.0, 1.0), (3.0, 0.5)], "a double, b double")
    got = [r[0] for r in df.select(R.beta_lower(df["a"], df["b"])).collect()]
    for (a, b), x in zip(cases, got):
        assert abs(beta_mass(a, b, x) - 0.05) < 0.01, (a, b, x)
    assert got[-3:-1] == [0.0, 0.0] and 0 <= got[-1] < 1


def test_registries_and_shared_suffixes(spark):
    want = {"shop.example.com.br": "com.br", "www.unit.ac.uk": "ac.uk", "me.github.io": "github.io", "github.io": "io", "x.notregistry.de": "de", "a.co.com": "com"}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert dict(map(tuple, df.select("h", R.suffix(df["h"])).collect())) == want


def test_cutoff_ties_long_urls_and_names(spark):
    long = "https://" + "a" * 100_000 + ".example.com/" + "b" * 100_000
    pages = spark.createDataFrame(site("bad.example.com", range(60)) + site("good.example.org", range(100, 300)) + [(900, long, "x")], PAGES).selectExpr("*", "'x' as host", "'y' as lower")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)] + [(i, 1, 0) for i in range(100, 300)], LABELS)
    got = R.filter_urls(pages, labels, keep_scores=True)
    assert got.columns == [*pages.columns, "host_", "mean", "lower_"]
    ids = {r["page_id"] for r in got.collect()}
    assert ids == set(range(100, 300)) | {900}
    assert {r["page_id"] for r in R.filter_urls(pages, labels).collect()} == ids
    assert {r["page_id"] for r in R.filter_urls(pages, labels, broadcast_rows=-1).collect()} == ids
    bound = next(r["lower"] for r in R.reputations(pages.drop("host", "lower"), labels).collect() if r["host"] == "bad.example.com")
    assert R.filter_urls(pages, labels, cutoff=bound).count() == 261 and R.filter_urls(pages, labels, cutoff=bound - 1e-6).count() == 201
