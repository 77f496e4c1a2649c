import numpy as np

from corpusgraph.llm import url_cascade as U

URLS = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/1?q"), (4, "http://example.org/en/12#f"),
        (5, "https://x.com/de/a"), (6, "https://x.com/fr/a"), (7, "http://free-bets.example.net/a"),
        (8, "http://m.spam-farm.example.com"), (9, "http://org/"), (10, "http://org"), (11, "http://notorg/"),
        (12, "x://y://z/p"), (13, "http://É.net/É?x"), (13, "http://É.net/É?x"), (14, "")]
WANT = {1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.example.org", "/es/1", "example.org/es/", "block"),
        4: ("example.org", "/en/12", "example.org/en/1", "block"), 5: ("x.com", "/de/a", "com/de/", "block"),
        6: ("x.com", "/fr/a", "com/fr/", "allow"), 7: ("free-bets.example.net", "/a", None, "block"),
        8: ("m.spam-farm.example.com", "", None, "block"), 9: ("org", "/", "org/", "allow"),
        10: ("org", "", None, "allow"), 11: ("notorg", "/", None, "allow"), 12: ("y:", "//z/p", None, "allow"),
        13: ("É.net", "/É", None, "allow"), 14: ("", "", None, "allow")}


def test_verdicts_by_cascade_and_beyond_its_bound(spark):
    pages = spark.createDataFrame([(i, u, "c") for i, u in URLS], "page_id long, url string, host string")
    for limit in (U.MAX_BYTES, 0):
        got = U.judge_urls(pages, max_bytes=limit).collect()
        assert len(got) == len(URLS)
        assert all((r.host, r.path, r.rule, r.verdict) == WANT[r.page_id] for r in got)


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).selectExpr("concat('host', id) key", "id")
    listed, unlisted = keys.where("id % 37 = 0").select("key"), keys.where("id % 37 != 0").select("key")
    levels = U.build_cascade(listed, unlisted)
    assert len(levels) > 1
    for side, want in ((listed, True), (unlisted, False)):
        h = U._hashed(side).toPandas()
        assert (U.is_listed(levels, h.h1.to_numpy(), h.h2.to_numpy()) == want).all()
    assert sum(x.bits for x in levels) < 20_000 * 8
    h = U._hashed(listed).toPandas()
    assert np.any(levels[1].has(h.h1.to_numpy(), h.h2.to_numpy())) or len(levels) == 2


def test_empty_list_and_empty_table(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r.verdict for r in U.judge_urls(pages, rules=(), blocked=()).collect()} == {"allow"}
    assert U.judge_urls(pages.limit(0)).count() == 0
