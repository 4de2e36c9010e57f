"""URL filters: rules literally, scores against a plain version of the models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hearth.llm import urls
from hearth.llm.queries import URL_RULES, op12_url_filter

LISTED = [
    ("http://A.Example.NET/en/x?q=1#t", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://a.example.net/EN/x", "a.example.net", "/EN/x", "net/", "block"),
    ("https://example.net/fr", "example.net", "/fr", "net/", "block"),
    ("x://example.com/de/?", "example.com", "/de/", "example.com/de/", "block"),
    ("x://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("x://www.any.org/fr/a/b", "www.any.org", "/fr/a/b", "org/fr/", "allow"),
    ("x://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("x://any.net", "any.net", "", None, None),
    ("x://any.net?/p", "any.net", "", None, None),
    ("x://any.net:80/p", "any.net:80", "/p", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme/net/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://é.NET/中文\n/x", "é.net", "/中文\n/x", "net/", "block"),
]


def pages_of(spark, addresses, clash=()):
    df = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string").repartition(3)
    for name in clash:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def made(n, seed=3):
    pick = random.Random(seed)
    words = {"allow": ["garden", "recipe", "history"], "block": ["casino", "xxx", "winbig"]}
    found = []
    for kind in words:
        end = {"allow": "org/fr", "block": "net"}[kind]
        found += [f"https://{pick.choice(words[kind])}{i % 17}.{end}/{pick.choice(words[kind])}-{pick.randint(0, 999)}.html" for i in range(n)]
    return found


def test_rules_literally(spark):
    found = urls.with_rule(pages_of(spark, [r[0] for r in LISTED]), URL_RULES).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["ruled"]) for r in found] == LISTED


class Plain:
    """Witten-Bell blending with dictionaries."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for text in texts:
            line = [None] * urls.ORDER + list(text) + ["end"]
            for i in range(urls.ORDER, len(line)):
                for order in range(urls.ORDER + 1):
                    self.after[tuple(line[i - order : i])][line[i]] += 1

    def log_likelihood(self, text):
        line, total = [None] * urls.ORDER + list(text) + ["end"], 0.0
        for i in range(urls.ORDER, len(line)):
            p = 1 / 257
            for order in range(urls.ORDER + 1):
                seen = self.after.get(tuple(line[i - order : i]), {})
                n = sum(seen.values())
                if n and (order == 0 or n >= urls.MIN_SEEN):
                    p = (seen.get(line[i], 0) + len(seen) * p) / (n + len(seen))
            total += math.log(p)
        return total


def test_scores_equal_plain_models(spark):
    kinds = {"allow": [u.encode() for u in made(60)[:60]], "block": [u.encode() for u in made(60)[60:]]}
    rows = [(bytearray(u), kind) for kind, of in kinds.items() for u in of]
    counted = urls.count_codes(spark.createDataFrame(rows, "url binary, kind string").repartition(3)).toPandas()
    model = urls.RatioModel(*[counted[c].to_numpy() for c in ("code", "allow", "block")])
    plain = {kind: Plain(of) for kind, of in kinds.items()}
    texts = [*kinds["allow"][:5], *kinds["block"][:5], b"", b"http://other.example/\xc3\xa9", b"x" * 3000]
    expected = [(plain["allow"].log_likelihood(t) - plain["block"].log_likelihood(t)) / (len(t) + 1) for t in texts]
    assert np.allclose(model.scores(texts), expected, atol=1e-9)


def test_probabilities_add_up_to_one():
    found, _ = urls.codes([b"abcabcabd", b"abc"])
    code, count = np.unique(np.concatenate(found), return_counts=True)
    model = urls.MarkovModel(code, count)
    contexts = [b"", b"ab", b"zz", b"abcab"]
    for context in contexts:
        every = [context + bytes([b]) for b in range(256)]
        by_order, sizes = urls.codes([*every, context])
        last = np.cumsum(sizes) - 1
        last[:-1] -= 1
        assert np.exp(model.log_probability([c[last] for c in by_order])).sum() == pytest.approx(1)


def test_threshold_separates():
    assert urls.calibrated(np.array([0.5, 0.9, 2.0]), np.array([-1.0, 0.1])) == pytest.approx(0.3)
    assert urls.calibrated(np.zeros(0), np.array([1.0])) == 0.0
    many = np.random.default_rng(1).normal(size=3000)
    assert abs(urls.calibrated(many + 3, many - 3)) < 1


def test_unruled_urls_follow_the_likeness(spark):
    learnt = made(400)
    unseen = ["https://garden99.com/recipe-5.html", "https://history.io/garden-77.html", "https://casino99.com/xxx-5.html", "https://winbig.io/casino-1.html"]
    found = urls.judge(pages_of(spark, [*learnt, *unseen]), URL_RULES).where(f"page_id >= {len(learnt)}").orderBy("page_id").collect()
    assert [r["verdict"] for r in found] == ["allow", "allow", "block", "block"]
    assert all(r["rule"] is None for r in found)


def test_awkward_rows_and_clashing_columns(spark, saved):
    addresses = [*[r[0] for r in LISTED], *made(30), "https://long.com/" + "y" * 300000, *["https://same.com/a"] * 5]
    pages = pages_of(spark, addresses, clash=["host", "path", "rule", "ruled", "score", "verdict", "kind", "hash"])
    found = {r["page_id"]: r for r in op12_url_filter(spark, saved(pages=pages)).collect()}
    assert len(found) == len(addresses)
    for n, (_, host, path, rule, ruled) in enumerate(LISTED):
        assert (found[n]["host"], found[n]["path"], found[n]["rule"]) == (host, path, rule)
        assert found[n]["verdict"] == ruled if ruled else found[n]["verdict"] in ("allow", "block")
    same = {(r["verdict"], r["score"]) for r in found.values() if r["host"] == "same.com"}
    assert len(same) == 1
    kept = urls.judge(pages, URL_RULES)
    assert {"kind", "hash"} <= set(kept.columns) and kept.where("kind = 'x'").count() == len(addresses)


def test_one_kind_or_no_rows(spark):
    only = urls.judge(pages_of(spark, ["https://a.net/x", "https://a.com/y", None]), URL_RULES).orderBy("page_id").collect()
    assert [(r["verdict"], r["score"]) for r in only] == [("block", None), ("allow", None), ("allow", None)]
    assert urls.judge(pages_of(spark, ["x"]).limit(0), URL_RULES).count() == 0


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    found = urls.judge(pages, URL_RULES).where("rule is not null")
    right = found.selectExpr("avg(cast((score >= 0) = (verdict = 'allow') as double)) AS right").first()["right"]
    assert right > 0.95


def test_every_ruled_url_is_learnt_from(spark):
    """All distinct URLs count, however many and however long they are."""
    addresses = [f"https://a{i}.net/{i}" for i in range(11_000)] + ["https://b.net/" + "q" * 2000, "https://c.org/fr/x", "https://c.org/fr/y", "https://c.org/fr/z", "https://d.org/fr/zz", "https://e.org/fr/u", "https://f.org/fr/v"]
    ruled = urls.with_rule(pages_of(spark, [*addresses, *addresses[:50]]), URL_RULES)
    seen = urls.fit(ruled).block
    ends = seen.count[(seen.code >> urls.TAG == 0) & (seen.code & ((1 << urls.BITS) - 1) == urls.END)]
    assert 8400 < ends.sum() < 9200
    assert seen.count[seen.code == ord("q") + urls.SHIFT].sum() in (0, 2000)


def test_threshold_in_ranges(spark):
    """The same cut as over arrays, with ties of the share and of scores."""
    rng = np.random.default_rng(4)
    for allowed, blocked in ((rng.normal(size=300) + 1, rng.normal(size=200) - 1), (np.round(rng.normal(size=50), 1), np.round(rng.normal(size=70), 1)), (np.array([0.5, 0.9, 2.0]), np.array([-1.0, 0.1])), (np.array([1.0]), np.array([1.0]))):
        rows = [(float(x), "allow") for x in allowed] + [(float(x), "block") for x in blocked]
        found = urls._threshold(spark.createDataFrame(rows, "score double, kind string"))
        assert found == pytest.approx(urls.calibrated(allowed, blocked))
    assert urls._threshold(spark.createDataFrame([(1.0, "allow")], "score double, kind string")) == 0.0
