import math
import random

import pytest

from shelfledger.llm import mixing, url_filter
from shelfledger.session import stage


def filled(sizes, weights, cap=3):
    """Targets by clamping and sharing out again until none is above."""
    total, fixed = sum(sizes), {}
    while len(fixed) < len(sizes):
        rest = [i for i in range(len(sizes)) if i not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in rest)
        over = [i for i in rest if level * weights[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, level * weights[i]) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}
    return [fixed[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_fill(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 1000, 7]) for _ in range(9)]
    weights = [(5, 2, 1)[i % 3] for i in range(9)]
    rows = [(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))]
    table = stage(spark.createDataFrame(rows, "source string, source_size long, weight long"), "t")
    found = {r.source: r.target for r in mixing.fill(table).collect()}
    assert all(math.isclose(found[f"s{i}"], t, abs_tol=1e-9) for i, t in enumerate(filled(sizes, weights)))


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame(
        [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)],
        "doc_id long, text string, source string",
    )
    report = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, report)) == sorted(map(str, again))
    taken = {}
    for r in report:
        assert r.taken <= 3 * r.size
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 30 for (_, target), t in taken.items())
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns
    assert sum(len(r.text.split()) for r in rows.collect()) == sum(r.taken for r in report)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    report = mixing.mix_report(odd_docs).collect()
    assert len(report) == odd_docs.count() and all(r.taken <= 3 * r.size for r in report)
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix_report(no_docs).count() == mixing.mix(no_docs).count() == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net?x/en/", "http://example.net/en",
    "ftp://example.com/de/1", "http://notexample.com/de/", "http://x.example.com/de/../", "http://org/fr/", "http://a.org/fr/x", "http://a.org/f",
    "http://e.net:80/", "http://u@e.net/", "a://b://c.net/", "http://É.Net/", "http://x.net/\nq", "http://" + "a." * 5000 + "net/", "http://.net/", "http://net./",
]
RULES = [("net", "/", "net/", "block"), ("example.net", "/en/", "example.net/en/", "allow"),
         ("example.com", "/de/", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow")]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[2]), len(r[0]), r[3]), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[4]])] + [(None, URLS[4], None)] * 2, "page_id long, url string, host string")
    table = url_filter.rule_table(spark, [r[2] for r in RULES if r[3] == "block"], [r[2] for r in RULES if r[3] == "allow"])
    found = sorted(map(str, map(tuple, url_filter.judge(pages, table).collect())))
    assert found == sorted(str((p.page_id, *judged(p.url, RULES))) for p in pages.collect())
    assert url_filter.judge(pages.where("page_id = -1"), table).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, table.where("rule = ''")).collect()} == {"allow"}


def test_rules_without_path_and_with_ties(spark):
    rules = [("b.c", "", "b.c", "block"), ("c", "/x", "c/x", "allow"), ("a.b.c", "/q", "a.b.c/q", "block"), ("b.c", "/qrs", "b.c/qrs", "allow")]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate([(h, p) for h in ("a.b.c", "b.c", "c", "z.c") for p in ("", "/", "/x", "/qrs", "/q")])], "page_id long, url string")
    table = url_filter.rule_table(spark, [r[2] for r in rules if r[3] == "block"], [r[2] for r in rules if r[3] == "allow"])
    found = sorted(map(str, map(tuple, url_filter.judge(pages, table).collect())))
    assert found == sorted(str((p.page_id, *judged(p.url, rules))) for p in pages.collect())
