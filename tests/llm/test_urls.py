import re

from ledgerline.llm.urls import RULES, judge_urls
from tests.llm.conftest import SMALL


def brute(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[2].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[3]) if m else ("", "")
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


ODD = [None, "", "org/x", "http://", "http://ORG/", "HTTP://Example.ORG/es/1?x#y", "a://b.example.org/en/1", "a://org?/fr/", "a://xorg/",
       "a://x.com/fr/a://y.org/", "//x.org/", "a://x.org", "a://x.com/de/", "a://x.com:80/de/", "a://x\n.org/\n?", "a://é.org/ü/😀"]


def test_rules_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(ODD)] + [(None, "a://q.net/"), (5, "a://q.net/")], "page_id long, url string")
    rows = pages.unionByName(odd)
    urls = sorted(((r.page_id, r.url) for r in rows.collect()), key=str)
    found = judge_urls(rows.selectExpr("*", "1 as host", "2 as rule", "3 as length", "4 as p_block", "'q' as features")).collect()
    assert len(found) == len(urls)
    got = {r.page_id: r for r in found if r.page_id is not None and r.page_id != 5}
    for key, url in urls:
        if key in got:
            host, path, rule, verdict = brute(url)
            assert (got[key].host, got[key].path, got[key].rule) == (host, path, rule), url
            assert got[key].verdict == (verdict or ("block" if got[key].p_block >= 0.5 else "allow"))
    learned = {r.verdict for r in found if r.rule is None}
    assert learned == {"allow", "block"}


def test_trees_agree_with_their_labels(spark):
    """Rules that the features tell apart are learned."""
    rows = [(i, f"http://h{i}.com/{'a/b/c/d/e/' if i % 2 else 'x'}{i}") for i in range(400)]
    rows += [(1000 + i, f"http://h{i}.net/{'a/b/c/d/e/' if i % 2 else 'x'}{i}") for i in range(40)]
    rules = [("block", "com", "/a/"), ("allow", "com", "/")]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in found)


def test_without_labels(spark):
    rows = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in judge_urls(rows).collect()} == {"allow"}
    only = spark.createDataFrame([(1, "http://a.com/de/"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.verdict for r in judge_urls(only).collect()} == {"block"}
    assert judge_urls(rows.limit(0)).collect() == []


def test_every_suffix_keeps_its_statistics(spark, monkeypatch):
    """Suffixes of one kind of URL, told apart by their statistics alone, however many others there are."""
    kinds = spark.range(12_000).selectExpr("id % 2 = 1 as bad", "concat('h', lpad(id, 5, '0'), '.com') as suffix", "id")
    rows = kinds.selectExpr("id * 8 as page_id", "bad", "suffix", "explode(sequence(0, 3)) as k").selectExpr(
        "page_id + k as page_id",
        "concat('http://', suffix, if(k = 3, '/x/', if(bad, '/a/', '/b/')), k) as url")
    rules = [("block", "com", "/a/"), ("allow", "com", "/b/")]

    def verdicts():
        found = judge_urls(rows, rules=rules).where("rule is null").collect()
        assert len(found) == 12_000
        return {r.page_id: r.verdict for r in found}

    sent = verdicts()
    assert all((v == "block") == (i // 8 % 2 == 1) for i, v in sent.items())
    monkeypatch.setattr("ledgerline.llm.urls.BROADCAST_SUFFIXES", 10)
    monkeypatch.setattr("ledgerline.llm.urls.HOT_URLS", 3)
    assert verdicts() == sent
