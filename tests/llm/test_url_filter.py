import math
from collections import Counter, defaultdict

import pytest

from hopboard.llm.queries import URL_RULES
from hopboard.llm.url_filter import judge

URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x", "https://www.example.com/en/x?y=/es/", "http://a.www.example.com/en/",
    "http://example.com", "http://example.com?/en/", "http://example.com#/", "http://examplexcom/en/", "http://badexample.com/en/a",
    "ftp://x.net/es/1://y", "http://x.net/ES/1", "http://net/fr/", "http://x.net/frx", "http://münchen.net/es/ü?q", "http://É.net/fr/", "x://com/",
    "http://a.b/" + "long/" * 3000, "http://example.org/en/1", "http://example.org/en/1",
]
URLS += [f"http://good{i % 7}.shop.com/item/{i}" for i in range(60)] + [f"https://spam{i % 5}.casino.net/es/win-{i}" for i in range(60)]
URLS += ["http://good.shop.org/item/1", "https://spam.casino.org/es/win-9"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if c < "\x80" else c for c in rest[:cut]), path


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2])) if fits else None


def symbols(url):
    known = "".join(c.lower() if c < "\x80" else c for c in url or "")
    known = "".join("0" if c in "0123456789" else c if c in "abcdefghijklmnopqrstuvwxyz/.-_?=&#%:" else "*" for c in known)
    return "<<<" + known + ">"


def score_of(url, counts):
    """Mean log ratio by counting contexts anew for every order."""
    total, text = 0.0, symbols(url)
    for at in range(3, len(text)):
        chances = []
        for seen in counts:
            p = 1 / 40
            for order in range(4):
                following = seen[text[at - order : at]] if order else seen[""]
                n, kinds = sum(following.values()), len(following)
                if n:
                    p = (following[text[at]] + kinds * p) / (n + kinds)
            chances.append(p)
        total += math.log(chances[0] / chances[1])
    return total / (len(text) - 3)


def test_matches_brute_force(spark):
    frame = spark.createDataFrame([(i, url, "x", 1.0) for i, url in enumerate(URLS)], "page_id long, url string, host string, score double")
    held = {r["url"]: r["held"] for r in frame.selectExpr("url", "pmod(xxhash64(url), 5) = 0 AS held").collect()}
    rows = judge(frame.repartition(3), URL_RULES).orderBy("page_id").collect()
    counts = (defaultdict(Counter), defaultdict(Counter))
    for url in URLS:
        rule = rule_of(*parts(url))
        if rule and not held[url]:
            text = symbols(url)
            for at in range(3, len(text)):
                for order in range(4):
                    counts[rule[0] == "block"][text[at - order : at]][text[at]] += 1
    assert [row["page_id"] for row in rows] == list(range(len(URLS)))
    for row, url in zip(rows, URLS):
        host, path = parts(url)
        rule = rule_of(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule and rule[1] + rule[2])
        assert row["score"] == pytest.approx(score_of(url, counts), abs=1e-6)
        assert row["verdict"] == (rule[0] if rule else "allow" if row["score"] >= row["threshold"] else "block")
    by_url = {url: row["verdict"] for row, url in zip(rows, URLS)}
    assert by_url["http://good.shop.org/item/1"] == "allow" and by_url["https://spam.casino.org/es/win-9"] == "block"


def test_repeated_rows_and_empty_inputs(spark):
    rows = [(1, "http://a.com/"), (1, "http://a.com/"), (None, None), (None, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(((r["page_id"], r["url"], r["verdict"], r["threshold"]) for r in judge(frame, URL_RULES).collect()), key=str)
    assert [r[:2] for r in got] == sorted(rows, key=str) and all(r[3] == 0.0 for r in got)
    assert judge(frame.limit(0), URL_RULES).count() == 0
    assert {r["rule"] for r in judge(frame, []).collect()} == {None}


def test_plan_is_native(spark):
    frame = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = judge(frame, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
