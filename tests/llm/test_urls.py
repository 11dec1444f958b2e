import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import urls
from leafmill.llm.queries import URL_RULES

HARD = [None, "", "no scheme", "://", "http://", "http://NET", "http://NET/", "http://a.net?x=/en/", "http://Example.NET/en/1#t", "http://xexample.net/en/", "http://www.example.com/de/",
        "http://example.com/de", "ftp://org/fr/://x", "http://a.org/fr/\nline", "http://É.org/fr/", "http://.net/", "http://a..net/", "http://net./x", "a\nb://c.net/"]


def brute(url, rules, listed):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if host and plain(host, path) in listed else "allow"


def plain(host, path):
    return re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html|/+)\Z", "", path)


@pytest.mark.parametrize("blocks", [1, urls.BLOCKS])
def test_against_a_plain_loop(spark, blocks):
    draw = random.Random(2)
    found = HARD + [f"http://{draw.choice(['', 'www.', 'm.', 'a.b.'])}{draw.choice(['example.net', 'example.com', 'x.org', 'net', 'other.de'])}/{draw.choice(['en', 'de', 'fr'])}/{draw.randrange(5)}{draw.choice(['', '/', '.html', '?q', '#f'])}"
                    for _ in range(300)]
    listed = [u for u in found if u and "other.de" in u][:7] + [None]
    rules = URL_RULES + [("other.de", "/en/1", "block"), ("de", "", "allow"), ("x.org", "/de/", "allow"), ("x.org", "/de/", "block")]
    pages = spark.createDataFrame([(i, u, 1, "h", "r") for i, u in enumerate(found)] + [(None, found[20], 1, "h", "r")], "page_id long, url string, id int, host string, rule string")
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, action string"), spark.createDataFrame([(u,) for u in listed], "url string"), blocks=blocks).collect()
    known = {plain(*brute(u, [], set())[:2]) for u in listed if u}
    assert len(got) == len(found) + 1
    for r in got:
        url = found[20] if r.page_id is None else found[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == brute(url, rules, known), url


def test_empty_lists_and_table(spark):
    rules, listed = spark.createDataFrame([], "host string, path string, action string"), spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, rules, listed).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), spark.createDataFrame(URL_RULES, rules.schema), listed).count() == 0


def test_the_filter_misses_nothing_and_stops_most(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    table = urls.bloom(keys)
    assert table.count() <= urls.BLOCKS
    assert urls.possible(keys, table).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert urls.possible(others, table).count() < 400
