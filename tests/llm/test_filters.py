import numpy as np
import pytest

from sparkloom.llm import gam, url_filter
from sparkloom.llm.queries import URL_RULES


def judged(spark, urls, rules=URL_RULES, **kw):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict int, host string")
    return {r["page_id"]: r for r in url_filter.judge_urls(pages, rules, **kw).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://org/", "http://xorg/a", "http://b.com/fr/1", "http://b.com/de/",
            "http://example.org", None, "", "no-scheme/adult", "x://h?y/z", "http://b.com/FR/1", "http://example.org/en/2", "a://b://c/d"]
    got = judged(spark, urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("org", "/", "org/", "allow"),
        ("xorg", "/a", None, "allow"), ("b.com", "/fr/1", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"), ("example.org", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "block"), ("h", "", None, "allow"), ("b.com", "/FR/1", None, "allow"),
        ("example.org", "/en/2", "org/", "allow"), ("b:", "//c/d", None, "allow")]


@pytest.mark.parametrize(("url", "verdict", "strict", "soft"), [
    ("http://adult-x.net/a", "block", 1, 0), ("http://adulthood.net/a", "allow", 0, 0), ("http://essex.net/Sex", "block", 1, 0),
    ("http://free.net/free/free", "allow", 0, 1), ("http://free-bets.net/", "block", 0, 2), ("http://freebets.net/", "allow", 0, 0),
    ("http://a.net/free?bets", "block", 0, 2), ("http://a.net/watch?cat=Adult", "block", 1, 0), ("http://a.net/x#xxx", "block", 1, 0),
    ("sex.com/a", "block", 1, 0), ("sex", "block", 1, 0), ("free.net", "allow", 0, 1), ("http://a.net/free_bets", "block", 0, 2), ("http://a.net/ä-xxxé", "block", 1, 0)])
def test_vocabulary(spark, url, verdict, strict, soft):
    few = url_filter.Vocabulary(("adult", "sex", "xxx"), (("bets", 0.6), ("free", 0.5)))
    row = judged(spark, [url], vocabulary=few)[0]
    assert (row["verdict"], row["strict_hits"], row["soft_hits"]) == (verdict, strict, soft)


def test_default_vocabulary(spark):
    bad = ["porn.com/videos", "https://a.net/watch?cat=porno", "http://a.net/#casino", "http://sportwetten-a.de/", "https://apuestas.es/", "http://x.ru/buy?pills=cheap&rx=1",
           "http://a.com/torrents/cracked/app", "http://bet.io/freespins"]
    good = ["http://news.net/free-farm-loan-advice", "https://a.org/offers/sale/2024", "http://shop.com/buy-online/shoes", "https://a.edu/essex/sussex/middlesex",
            "http://lib.net/therapist/analysis", "https://a.net/pharmacology/pharmacy", "http://a.net/spam-folder-help", "http://a.net/winners/track/field", None, "", "://"]
    got = judged(spark, bad + good, rules=[])
    assert [got[i]["verdict"] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)
    assert len(url_filter.STRICT) > 100 and len(url_filter.SOFT) > 130 and not set(url_filter.STRICT) & set(url_filter.SOFT)


def test_url_edges(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), []).count() == 0
    assert judged(spark, ["http://porn.net"], rules=[], vocabulary=url_filter.Vocabulary((), ()))[0]["verdict"] == "allow"
    long = judged(spark, ["http://a.net/" + "b" * 1_000_000 + "/xxx/"])
    assert long[0]["verdict"] == "block"


def test_rules_beat_vocabulary(spark):
    assert judged(spark, ["http://porn.com/fr/", "http://porn.com/en/"])[0]["verdict"] == "allow"


def test_gam_learns_main_effects_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=4000) < 0.05)).astype(float)
    model = gam.fit_gam(x[:3000], y[:3000])
    plain = gam.fit_gam(x[:3000], y[:3000], n_pairs=0)
    right = lambda m: ((m.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()
    assert right(model) > 0.85 and right(plain) < 0.65
    brute = model.base + sum(model.tables[f][np.searchsorted(model.cuts[f], x[:50, f], side="right")] for f in range(4))
    for f, g, t in model.pairs:
        brute = brute + np.array([t[np.searchsorted(model.coarse[f], a, side="right"), np.searchsorted(model.coarse[g], b, side="right")]
                                  for a, b in zip(x[:50, f], x[:50, g], strict=True)])
    assert np.allclose(model.margin(x[:50]), brute)


def test_shallow_tree_is_the_best_split():
    g, h = np.array([1.0, 1, -3, -1]), np.ones(4)
    step = gam.shallow_tree(g, h, 1, 0.0, 0.5)
    assert np.allclose(step, [1, 1, -2, -2])


def test_held_out_quality_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = gam.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, good = got["score"].rank(), got["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95


def test_quality_edges(spark, odd_rows, no_rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0), (5, 0, 1), (6, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = gam.score_quality(odd_rows, labels).collect()
    assert len(rows) == odd_rows.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert gam.keep_good(odd_rows, labels).columns == odd_rows.columns
    assert gam.score_quality(no_rows, labels).count() == 0
    none = gam.score_quality(odd_rows, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_labels_of_the_held_out_fifth_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = ({r["doc_id"]: r["score"] for r in gam.score_quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b
