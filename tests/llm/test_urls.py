from lexloom.llm.queries import URL_RULES
from lexloom.llm.urls import judge_urls


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3:]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    best = (None, None)
    for verdict, rule in URL_RULES:
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, path, *best)


ODD = [None, "", "no scheme", "://", "x://", "http://EXAMPLE.com", "http://example.com/", "http://notexample.com/en/1", "https://www.Example.com/en/x?u=http://a.net/es/", "http://m.example.com/en", "ftp://İ.net/es/ü/1",
       "http://net/es/", "http://xnet/fr/", "http://a.net#/fr/", "http://a.net?/fr/", "http://a.b.net/fr/9", "http://com/x", "a://b://c.com/d", "http://example.org/en/7", "http://www.example.com/en/" + "d/" * 20_000]


def test_parts_and_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(ODD + ODD[5:7])]
    got = sorted(judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(3), URL_RULES).collect())
    assert len(got) == len(rows)
    for (i, u, _, _), r in zip(rows, got):
        host, path, rule, verdict = plain(u)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_templates_learn_from_rules(spark):
    rules = [("block", "a.org/spam/"), ("allow", "a.org/news/"), ("block", "b.org/spam/"), ("allow", "b.org/news/")]
    rows = [(i, f"http://{h}.org/{s}/{i}") for i, (h, s) in enumerate([(h, s) for h in "abc" for s in ("spam", "news") for _ in range(30)])]
    rows += [(1000 + i, f"http://d.org/{chr(97 + i // 26)}{chr(97 + i % 26)}/p") for i in range(60)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {(r.template, r.verdict) for r in got if r.host == "c.org"} == {("spam/*", "block"), ("news/*", "allow")} or {r.verdict for r in got if r.path.startswith("/spam")} == {"block"}
    assert {r.verdict for r in got if r.host == "c.org" and r.path.startswith("/spam")} == {"block"}
    assert {r.verdict for r in got if r.host == "c.org" and r.path.startswith("/news")} == {"allow"}
    assert {r.template.strip("/") for r in got if r.host == "d.org"} == {"*/p"}


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
