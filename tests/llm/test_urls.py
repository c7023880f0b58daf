import random
import re

from effectlab.llm import urls

RULES = (urls.SiteRule(True, "com"), urls.SiteRule(False, "example.com", "/en/"), urls.SiteRule(True, "www.example.com", "/en/"), urls.SiteRule(False, "net", "/es/"))
URLS = [
    None, "", "nohost/x", "http://A.COM", "https://x.Example.com/en/1?q#z", "http://www.example.com/en/a", "ftp://u.net/es/", "http://com:80/", "x://?q", "x://com/\ny?",
    "http://notexample.com/en/", "http://net#/es/", "a://b://c/d", "http://É.COM/p", "http://u.net/es/", "http://u.net/es/",
]


def brute(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(str(r)), default=None)
    return host, path, str(best) if best else None, None if best is None else "allow" if best.allow else "block"


def test_rules_against_python(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id int, url string, rule string")
    for row in urls.judge(pages, RULES).collect():
        host, path, rule, verdict = brute(URLS[row["page_id"]])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")


def test_models_tell_unruled_urls_apart(spark):
    rng = random.Random(7)
    good = lambda: "http://site.com/" + "".join(rng.choice(["news", "story", "garden", "-"]) for _ in range(4))
    bad = lambda: "http://site.net/es/" + "".join(rng.choice(["casino", "bet", "88", "_"]) for _ in range(4))
    rows = [good() for _ in range(300)] + [bad() for _ in range(300)]
    fresh = [(good().replace("site.com", "site.org"), True) for _ in range(40)] + [(bad().replace("site.net/es", "site.org"), False) for _ in range(40)]
    pages = spark.createDataFrame([(u,) for u in rows + [u for u, _ in fresh]], "url string")
    verdict = {r["url"]: r["verdict"] for r in urls.judge(pages, RULES).collect()}
    assert sum((verdict[u] == "allow") == ok for u, ok in fresh) >= 76


def test_one_class_or_no_rows(spark):
    pages = spark.createDataFrame([("http://a.com/",), ("http://a.org/",)], "url string")
    assert {r["verdict"] for r in urls.judge(pages, RULES).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), RULES).count() == 0


CHECKS = {"op10_url_models": "test_rules_against_python"}
