import math
import random
import re
from collections import Counter, defaultdict
from hashlib import md5

from glyphloom.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, verdict int"


def parse(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


def codes(text):
    text = re.sub("[0-9]", "0", re.sub("[A-Z]", lambda x: x[0].lower(), text))
    return [0, 0, *[U.ALPHABET.find(c) + 1 or U.OTHER for c in text], 0]


class Model:
    def __init__(self, texts):
        self.follow = defaultdict(Counter)
        for t in texts:
            c = codes(t)
            for i in range(2, len(c)):
                for k in range(3):
                    self.follow[tuple(c[i - k : i])][c[i]] += 1

    def p(self, context, c):
        p = 1 / U.SYMBOLS
        for k in range(3):
            seen = self.follow.get(tuple(context[2 - k :]))
            if seen:
                p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p


def plain(rows, lost=5):
    parsed = [(i, u or "", *parse(u)) for i, u in rows]
    kept_back = lambda u: md5(u.encode()).hexdigest()[0] in "0123"
    by = [(u, rule(h, p)) for _, u, h, p in parsed]
    models = {v: Model([u for u, r in by if r and r.verdict == v and not kept_back(u)]) for v in ("allow", "block")}

    def score(text):
        c = codes(text)
        return math.floor(1000 * sum(math.log(models["allow"].p(c[i - 2 : i], c[i])) - math.log(models["block"].p(c[i - 2 : i], c[i])) for i in range(2, len(c))) / (len(c) - 2))

    good = [score(u) for u, r in by if r and r.verdict == "allow" and kept_back(u)]
    cut = max((s for s in good if 100 * sum(x < s for x in good) <= lost * len(good)), default=None)
    both = all(m.follow for m in models.values())
    out = []
    for i, u, h, p in parsed:
        r = rule(h, p)
        method = "block" if both and cut is not None and score(u) < cut else "allow"
        out.append((i, h, p, r.text if r else None, r.verdict if r else method))
    return out


def urls(n=500, seed=1):
    rnd = random.Random(seed)
    hosts = ["a.example.net", "example.net", "b.net", "net", "x.org", "org", "example.com", "m.Example.COM", "other.test", "notnet", "xorg"]
    return [f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/de/', '/fr/', '/fr/Ä'])}{rnd.choice(['', str(rnd.randrange(9999)), 'p~x.html', 'über/b_c'])}{rnd.choice(['', '?q=/en/', '#t', '?a#b'])}" for _ in range(n)]


ODD = [None, "", "no scheme", "http://", "://net/", "http://net", "http://net?x/", "a://b://net/", "HTTP://EXAMPLE.NET/EN/", "http://example.net/en/\nx?", "http://user@net:80/", "http://net/x", "http://net/x", "http://q/\ue001\ue002!", "http://w\ue005.org/fr/ \x05"]


def test_against_brute_force(spark):
    rows = list(enumerate(urls() + ODD)) + [(None, "http://org/fr/")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r)[:5] for r in U.filter_urls(df).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_edges(spark):
    few = [(1, "http://net/a"), (2, "http://q/"), (2, None)]
    got = [tuple(r)[:5] for r in U.filter_urls(spark.createDataFrame(few, "page_id long, url string")).collect()]
    assert sorted(got, key=str) == sorted(plain(few), key=str)
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    plans = U.filter_urls(spark.createDataFrame(few, "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans
