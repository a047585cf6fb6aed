import random

from cairnflow.llm import urls


def test_host_and_path():
    cases = {
        "http://A.Example.com/en/7?x#y": ("a.example.com", "/en/7"),
        "http://h?q/x": ("h", ""),
        "http://h#f/x": ("h", ""),
        "x://h/a#b?c": ("h", "/a"),
        "no mark": ("", ""),
        None: ("", ""),
        "": ("", ""),
        "http://Ü.com/": ("Ü.com", "/"),
        "a://b://c/d": ("b:", "//c/d"),
    }
    assert {u: urls.host_and_path(u) for u in cases} == cases


def brute(url):
    host, path = urls.host_and_path(url)
    fits = [(v, h, p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        v, h, p = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, v
    blocked = any(host == h or host.endswith("." + h) for h in urls.BLOCKED_HOSTS)
    return host, path, None, "block" if blocked else "allow"


def test_rules_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "example.net", "m.example.net", "notexample.com", "com", "a.org", "spam-farm.example.org", "x.spam-farm.example.org", "myspam-farm.example.org", "EXAMPLE.COM"]
    paths = ["/en/7", "/en/", "/en", "/en/71", "/de/8", "/de/9", "/es/", "/es/x?y", "", "/", "/fr/#/en/7"]
    rows = [(k, f"http://{rng.choice(hosts)}{rng.choice(paths)}", "h") for k in range(300)] + [(900, None, None), (901, "", "x"), (902, "plain", "y"), (902, "plain", "y"), (903, "http://com/en/" + "x" * 50_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.url_filter(df).collect()
    assert len(got) == len(rows)
    assert all((r.host, r.path, r.rule, r.verdict) == brute(r.url) for r in got)
    assert {r.verdict for r in got} == {"allow", "block"}
    assert urls.url_filter(df.limit(0)).count() == 0


def test_cascade_is_exact_for_the_universe(spark):
    """Also with filters so small that many keys pass wrongly, through several levels."""
    names = [(f"http://h{k}.net/",) for k in range(400)]
    pages = spark.createDataFrame(names, "url string")
    listed = spark.createDataFrame([(f"h{k}.net",) for k in range(0, 400, 3)], "key string")
    cascade = urls.build_cascade(listed, pages, (0,), seed=9)
    assert len(cascade.levels) > 2
    assert [f"h{k}.net" in cascade for k in range(400)] == [k % 3 == 0 for k in range(400)]
    assert "net" not in cascade
    assert "x" not in urls.build_cascade(listed.limit(0), pages, (0,))


def test_long_lists_are_judged_shard_by_shard(spark):
    """Tables as lists, far too long for one filter of so few bits: the same results as by brute force."""
    rng = random.Random(8)
    rules = list({("block" if k % 2 else "allow", f"h{k % 90}.net", f"/{'p' * (k % 3)}") for k in range(200)})
    rules = [(v, h, p) for v, h, p in rules if v == "block" or ("block", h, p) not in rules]
    hosts = [f"B{k}.org" for k in range(60)]
    rows = [(k, f"http://{rng.choice(['', 'w.'])}{rng.choice('hb')}{rng.randrange(120)}.{rng.choice(['net', 'org'])}/{'p' * rng.randrange(5)}") for k in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    tables = spark.createDataFrame([*rules, ("block", None, "/p")], "verdict string, host string, path string"), spark.createDataFrame([(h,) for h in [*hosts, None]], "host string")
    plain = sorted(map(tuple, urls.url_filter(df, rules, hosts).collect()), key=str)
    assert sorted(map(tuple, urls.url_filter(df, *tables, most_bits=512).collect()), key=str) == plain

    def expected(url):
        host, path = urls.host_and_path(url)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, *max(fits)[2:]
        return host, path, None, "block" if any(host == h.lower() or host.endswith("." + h.lower()) for h in hosts) else "allow"

    assert all(r[2:] == expected(r[1]) for r in plain)
    assert {r[5] for r in plain} == {"allow", "block"}
    assert any(r[4] for r in plain) and any(r[4] is None and r[5] == "block" for r in plain)
