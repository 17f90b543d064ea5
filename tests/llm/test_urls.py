import random

from exposure.llm import urls

RULES = urls.default_rules()


def test_query_matches_sql(compared):
    got, want = compared("op2_url_rules", "/root/testdata/sf0.01")
    assert got == want and len(got) == 250


def test_tokens_stand_alone():
    assert urls.path_rule("net/es/", "block").tokens == ("es", "net")
    assert urls.path_rule("net/es", "block").tokens == ("net",)
    assert urls.pattern_rule("*viagra*", "block").tokens == ()
    assert urls.pattern_rule("||casino^", "block").tokens == ("casino",)
    assert urls.pattern_rule("/banner/*/click", "block").tokens == ("banner",)


def by_hand(url):
    """Plain splitting, without tokens or regular expressions for path rules."""
    after = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in (after.find(c) for c in "/?#") if i >= 0], default=len(after))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in after[:cut])
    rest = after[cut:]
    path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = []
    for name, verdict in urls.PATH_RULES:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(name), name, verdict))
    return host, path, max(fits)[1:] if fits else None


def test_against_plain_splitting(spark):
    r = random.Random(5)
    hosts = ["com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "b.net", "spam-farm.org", "org", "", "ads.io", "Kom.net", "x.com:80"]
    paths = ["", "/", "/en/", "/en", "/EN/", "/en/1", "/es/x", "/fr/", "/ads/1", "/a/VIAGRAx", "/login", "/banner/1/click", "/popunders"]
    rows = [(i, r.choice(["http://", "HTTPS://", "", "x://y://"]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "?a=/en/", "#/ads/", "?x#y"])) for i in range(600)]
    rows += [(None, None), (None, None), (7, ""), (7, ""), (8, "http://\nnet/es/")]
    pages = spark.createDataFrame([(a, b, "x", "y", 0) for a, b in rows], "page_id long, url string, host string, token string, n int").repartition(3)
    got = urls.judge(pages, RULES).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *by_hand(u)[:2], str((by_hand(u)[2] or [None])[0])) for i, u in rows)
    assert sorted((str(g.page_id), g.host, g.path, str(g.rule)) for g in got) == want
    verdicts = dict(urls.PATH_RULES)
    for g in got:
        if g.rule:
            assert g.verdict == verdicts[g.rule]
        else:
            assert g.verdict == ("block" if any(dict(urls.PATTERN_RULES)[p] == "block" for p in g.patterns) and not any(dict(urls.PATTERN_RULES)[p] == "allow" for p in g.patterns) else "allow")
    assert {"*viagra*", "/login^", "||spam-farm.", "/ads/"} <= {p for g in got for p in g.patterns}
    assert "/popunder^" not in {p for g in got for p in g.patterns}


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
