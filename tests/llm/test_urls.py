import math
import random

from docloom.llm import urls as U


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    best = (None, None)
    for verdict, rule in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[1] or ""):
            best = verdict, rule
    return host, path, best[1], best[0]


ODD = [None, "", "no scheme", "http://", "://", "http://A.Example.ORG/es/x?y#z", "https://example.org", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://com/de/?a=b&c", "HTTP://É.ORG/", "http://a.org?q=://b/", "http://u@h:80/p#?", "x\ny://h.org/\n1", "http://deep.x.example.org/en/1", "http://h/" + "a" * 100_000]


def test_rules_against_brute_force(spark):
    rng = random.Random(1)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.x.'])}{rng.choice(['example.org', 'a.com', 'b.net', 'c.org'])}/{rng.choice(['es/', 'en/1', 'fr/', 'de/', 'en/'])}{rng.randint(1, 999)}{rng.choice(['', '?a=1&b', '#t', '.html'])}" for _ in range(500)]
    rows = [(i if i != 3 else None, u, "h", 0.0) for i, u in enumerate(ODD + made + made[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    got = U.filter_urls(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, *_ in rows:
        r = by[i]
        host, path, rule, verdict = brute(u)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict == ("allow" if r.score >= 0.5 else "block")
    ruled = [r for r in got if r.rule]
    assert sum((r.score >= 0.5) == (r.verdict == "allow") for r in ruled) / len(ruled) > 0.85


def test_trees_learn_held_out_urls(spark):
    """Labels that lexical features tell: many parameters and digits are bad."""
    rng = random.Random(2)
    rows = []
    for _ in range(1200):
        bad = rng.random() < 0.4
        q = "&".join(f"k{j}={rng.randint(10**6, 10**7)}" for j in range(rng.randint(2, 5))) if bad else ""
        rows.append((f"http://site{rng.randint(1, 50)}.net/{'a' * rng.randint(1, 9)}/page" + ("?" + q if q else ""), int(not bad)))
    df = spark.createDataFrame(rows, "url string, allowed int")
    host, path = U.host_and_path("url")
    df = df.withColumns({"host": host, "path": path})
    model = U.train(df.limit(800), "url")
    got = U.score(df.subtract(df.limit(800)), model, "url").collect()
    assert sum((r.score >= 0.5) == bool(r.allowed) for r in got) / len(got) > 0.97


def test_a_label_does_not_tell_of_itself(spark):
    rng = random.Random(3)
    rows = [(f"http://only{i}.net/p{i}", rng.randint(0, 1), rng.choice([1, 500])) for i in range(200)]
    df = spark.createDataFrame(rows, "url string, allowed int, copies long")
    host, path = U.host_and_path("url")
    df = U.with_features(df.withColumns({"host": host, "path": path}), "url")
    for few in (True, False):
        got = U.with_statistics(df, U.suffix_statistics(df), 0.5, few, "url").collect()
        assert len(got) == 200 and all(r.site_rate == 0.5 and r.section_seen == 0 for r in got)
        of = {r.url: r.f for r in df.select("url", U.url_fold("url").alias("f")).collect()}
        for r in got:
            n, good = sum(c for u, _, c in rows if of[u] != of[r.url]), sum(a * c for u, a, c in rows if of[u] != of[r.url])
            assert math.isclose(r.tld_rate, (good + 10) / (n + 20))


def test_urls_without_a_rule_follow_what_rules_say_of_their_section(spark):
    rng = random.Random(4)
    rows = [f"http://s{rng.randint(1, 40)}.com/{rng.choice(['fr', 'de'])}/{rng.randint(1, 10**6)}" for _ in range(1500)]
    rows += ["http://hot.com/de/1"] * 3000  # one URL, many times
    rows += [f"http://t{i}.net/{'fr' if i % 2 else 'de'}/{i}" for i in range(200)]
    got = U.filter_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), sample=500).where("rule is null").collect()
    assert len(got) == 200 and sum((r.verdict == "allow") == ("/fr/" in r.path) for r in got) >= 190


def test_entropy_and_counts(spark):
    df = spark.createDataFrame([("http://a-b.c.net/x/yy?p=1&q=2&&r",)], "url string")
    host, path = U.host_and_path("url")
    r = U.with_features(df.withColumns({"host": host, "path": path}), "url").first()
    u = "http://a-b.c.net/x/yy?p=1&q=2&&r"
    want = -sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u))
    assert math.isclose(r.entropy, want) and (r.depth, r.parameters, r.labels, r.hyphens, r.longest_segment) == (2, 3, 3, 1, 2)
    assert (r.tld, r.site, r.section) == ("net", "c.net", "x")


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in U.filter_urls(df).collect()] == ["allow", "allow"]
    assert U.filter_urls(df.limit(0)).collect() == []
    blocked = spark.createDataFrame([(1, "http://a.com/de/1"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.filter_urls(blocked).collect()} == {1: "block", 2: "block"}
