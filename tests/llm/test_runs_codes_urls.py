"""Periodic runs, vector codes and url templates against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import multiset
from triagekit.llm import codes, queries, runs, skew, templates


def plain_runs(ids):
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and ids[y] == ids[y + q]:
                y += 1
            length = y + q - x
            if y > x and length >= max(6, 4 * q):
                part = ids[x : y + q]
                if not any(q % d == 0 and part[:-d] == part[d:] for d in range(1, q)):
                    out.append(runs.Run(x, length, q))
            x = max(y, x) + 1
    return sorted(out)


REPEATS = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)).map(
    lambda x: (x[0] * x[1])[: max(1, len(x[0]) * x[1] - x[2])]
)


@settings(max_examples=500, deadline=None)
@given(st.lists(REPEATS | st.lists(st.integers(0, 9), max_size=5), max_size=6).map(lambda x: sum(x, [])))
def test_runs_are_all_found(ids):
    assert runs.find_runs(np.array(ids, np.int64)) == plain_runs(ids)


@pytest.mark.parametrize("ids", [[0] * 100_000, [0, 1, 2] * 40_000, list(range(9_000)) * 5, [0, 1, 1, 0, 1, 0, 0, 1] * 10_000])
def test_long_runs(ids):
    longest = runs.strongest(runs.find_runs(np.array(ids, np.int64)))
    assert (longest.start, longest.length) == (0, len(ids))


def test_grammar_derives_its_stretches():
    ids = [0, 1, 2, 0, 1, 2, 3, 0, 1, 0, 1, 0, 1, 2] * 5
    grammar = runs.Grammar(ids, [(0, len(ids))], 4)

    def derived(x):
        return [x] if x < 4 else [w for child in grammar.rules[x - 4][:2] for w in derived(child)]

    assert [w for x, _ in grammar.rest[0] for w in derived(x)] == ids
    assert all(ids[at : at + size] == derived(4 + i) for i, (_, _, size, at) in enumerate(grammar.rules))
    left = [x for x, _ in grammar.rest[0]]
    pairs = Counter(p for i, p in enumerate(zip(left, left[1:])) if i == 0 or p[0] != p[1])
    assert all(n == 1 for n in pairs.values())


def plain_row(doc_id, text, rewrite=lambda _, w: w):
    words = rewrite(doc_id, (text or "").encode().split())
    found = plain_runs(words)
    best = max(found, key=lambda r: (r.length / r.period, -r.start, -r.period), default=None)
    kept = [w for i, w in enumerate(words) if not any(r.start + r.period <= i < r.start + r.length for r in found)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best.length // best.period) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{r.start},{r.length},{r.period}\n" for r in found)), sha(b" ".join(kept).decode()))


def test_runs_of_documents(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    expected = [plain_row(*r, queries.planted_period) for r in rows if len((r[1] or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows) and len(expected) > 0.9 * len(rows) and any(e[1] for e in expected)
    assert [got[e[0]] for e in expected] == expected


def test_runs_edges(spark, edge, none):
    looped = spark.createDataFrame([(1, "a b " * 4000 + "c"), (1, "x " * 6), (None, "x\x1cy x\x1cy"), (2, "x " * 5)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(looped).collect()}
    assert got[1, 8001].collapsed == "a b c" and got[1, 8001].longest == (0, 8000, 2)
    assert got[1, 6].collapsed == "x" and got[2, 5].runs == [] and got[None, 2].longest is None
    found = runs.periodic_runs(edge).collect()
    assert len(found) == edge.count() and all(r.collapsed is not None for r in found)
    assert runs.periodic_runs(none).count() == 0


# --- vector codes ---------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 70), st.integers(0, 60), st.integers(1, 40), st.integers(0, 10**6))
def test_search_finds_the_nearest_entry(width, k, n, spread, seed):
    rng = np.random.default_rng(seed)
    entries, rows = rng.integers(-spread, spread, (k, width)), rng.integers(-spread, spread, (n, width))
    entry, distance = codes.nearest(rows, entries)
    all_distances = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert entry.tolist() == all_distances.argmin(1).tolist()  # argmin takes the lowest index
    assert distance.tolist() == all_distances.min(1).tolist()


def plain_codes(rows, parts, k, rounds):
    """``rows``: (id, vector, label), usable ones only, of one length."""
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, i))[:k]
    x = np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64).reshape(len(rows), parts, -1)
    start = [min([tuple(r[1]) for r in rows if r[0] == i]) for i in ids]
    books = np.floor(np.array(start) * 256).astype(np.int64).reshape(len(ids), parts, -1).transpose(1, 0, 2)

    def assign():
        d = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        entry, _ = assign()
        moved = books.copy()
        for p in range(parts):
            for e in set(entry[p].tolist()):
                met = x[entry[p] == e, p]
                moved[p, e] = [int(s) // len(met) for s in met.sum(0)]
        books = moved
    entry, d = assign()
    error = d.sum(0).tolist()
    of_label = defaultdict(int)
    for r, e in zip(rows, error):
        of_label[r[2]] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], bytes(entry[:, i].tolist()).hex(), error[i], of_label[r[2]], sha) for i, r in enumerate(rows)]


def coded(df, *args, **kwargs):
    found = codes.compress_vectors(df, *args, **kwargs)
    return multiset(found.select("vec_id", F.lower(F.hex("code")), "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("heavy", [1000, 3])
def test_codes(spark, sf, heavy, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_KEYS", heavy)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert coded(table.repartition(5)) == multiset(plain_codes(rows, 16, 64, 2))


def test_codes_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [0.1, -0.2, 0.3, 4.0], 1), (5, [0.1, -0.2, 0.3, 4.0], 1), (3, [1.0, 1.0, -1.0, -1.0], None), (None, [0.0, 0.0, 0.0, 0.0], None),
            (9, [-0.001, 0.001, 2.5, 2.5], 1), (9, [7.0, 7.0, 7.0, 7.0], 2)]
    bad = [(0, None, 1), (1, [nan, 0.0, 0.0, 0.0], 1), (2, [0.0, -inf, 0.0, 0.0], 1), (4, [0.0, None, 0.0, 0.0], 1), (6, [], 1), (7, [1.0], 1), (None, None, None)]
    schema = "vec_id long, embedding array<double>, label int, code int, error string, _vector int, n int, id int"
    table = spark.createDataFrame([(*r, None, None, None, None, None) for r in good + bad], schema).repartition(3)
    for k in (2, 64):
        assert coded(table, 2, k, 2) == multiset(plain_codes(good, 2, k, 2))
    assert codes.compress_vectors(table.where("vec_id in (0, 1)"), 2).count() == 0
    assert codes.compress_vectors(table.limit(0), 2).columns == codes.compress_vectors(table, 2).columns
    with pytest.raises(ValueError):
        codes.compress_vectors(table, 3)
    huge = spark.createDataFrame([(1, [1e300, -1e300], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert codes.compress_vectors(huge, 2).count() == 2


# --- url templates --------------------------------------------------------------------------------------------


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def plain_shape(path, depth):
    import re

    def general(s):
        if re.fullmatch(templates.VARIABLE, s):
            return "*"
        stem = re.fullmatch(templates.EXTENSION, s)
        return "*" + stem[2].lower() if stem and re.fullmatch(templates.VARIABLE, stem[1]) else s

    if not path:
        return []
    segments = path[1:].split("/")
    return [general(s) for s in segments[:depth]] + (["**"] if len(segments) > depth else [])


def differ(a, b):
    stat, df = 0.0, -2
    cells = [[(x["bad"], x["good"], x["n"] - x["bad"] - x["good"]) for x in (a, b)], [(x["more"], x["n"] - x["more"]) for x in (a, b)]]
    for one, two in cells:
        for x, y in zip(one, two):
            if x + y:
                stat += (x * math.sqrt(b["n"] / a["n"]) - y * math.sqrt(a["n"] / b["n"])) ** 2 / (x + y)
                df += 1
    return df > 0 and stat > templates.CHI_SQUARE[df - 1]


def plain_templates(urls, how):
    """``urls``: (host, path, bad or None); gives the template and purity of each."""
    items = [{"host": h, "shape": plain_shape(p, how.depth), "bad": b, "node": ""} for h, p, b in urls]
    size = Counter(x["host"] for x in items)
    for x in items:
        x["node_n"] = size[x["host"]]
    for level in range(how.depth + 1):
        nodes = defaultdict(lambda: defaultdict(list))
        for x in items:
            if len(x["shape"]) > level:
                nodes[x["host"], x["node"]][x["shape"][level]].append(x)
        for segments in nodes.values():
            named = defaultdict(list)
            for segment, met in segments.items():
                enough = len(met) >= how.least_urls and len(met) >= met[0]["node_n"] * how.least_share
                named[segment if enough else "*"] += met
            groups = []
            for name, met in sorted(named.items(), key=lambda x: (-len(x[1]), x[0])):
                stats = {"n": len(met), "bad": sum(x["bad"] is True for x in met), "good": sum(x["bad"] is False for x in met),
                         "more": sum(len(x["shape"]) > level + 1 for x in met)}
                group = next((g for g in groups if not differ(g, stats)), None)
                if group is None:
                    groups.append(stats | {"names": [name], "met": list(met)})
                else:
                    for key, value in stats.items():
                        group[key] += value
                    group["names"].append(name)
                    group["met"] += met
            for g in groups:
                piece = g["names"][0] if len(g["names"]) == 1 else "{" + "|".join(sorted(g["names"])) + "}"
                for x in g["met"]:
                    x["node"], x["node_n"] = f"{x['node']}/{piece}", g["n"]
    bad, labelled = Counter(), Counter()
    for x in items:
        bad[x["host"], x["node"]] += x["bad"] is True
        labelled[x["host"], x["node"]] += x["bad"] is not None
    out = []
    for x in items:
        key = x["host"], x["node"]
        out.append((x["node"], (bad[key] + how.prior_urls * how.prior_bad) / (labelled[key] + how.prior_urls)))
    return out


def plain_filter(rows, rules, how, labels=None):
    split = [plain_split(u) for _, u in rows]
    ruled = [plain_rule(rules, *s) for s in split]
    known = labels if labels is not None else [None if r is None else r.verdict == "block" for r in ruled]
    judged = plain_templates([(*s, b) for s, b in zip(split, known)], how)
    return [
        (i, h, p, r and r.name, r.verdict if r else ("block" if purity >= how.reject_at else "allow"), template, round(purity, 9))
        for (i, _), (h, p), r, (template, purity) in zip(rows, split, ruled, judged)
    ]


def rows_of(df):
    return multiset([(*r[:-1], round(r.purity, 9)) for r in df.collect()])


@pytest.mark.parametrize("folder,heavy", [("sf0.001", 1000), ("sf0.01", 1000), ("sf0.01", 4)])
def test_urls(spark, folder, heavy, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_KEYS", heavy)
    sf = f"/root/testdata/{folder}"
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    assert rows_of(queries.op11_url_templates(spark, sf)) == multiset(plain_filter(rows, queries.URL_RULES, templates.TreeRules()))


SITE = [
    *[(i, f"http://shop.test/item/{i}/reviews") for i in range(40)], *[(i, f"http://shop.test/promo/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}") for i in range(40)],
    *[(i, f"http://shop.test/sale/word{'uvwxyz'[i % 6]}") for i in range(40)], *[(i, f"http://shop.test/help/{i}.html") for i in range(12)],
]


def test_templates_of_a_site(spark):
    labels = {"promo": True, "sale": True, "item": False}
    known = [labels.get(u.split("/")[3]) if i % 2 else None for i, u in SITE]
    pages = spark.createDataFrame([(*r, k) for r, k in zip(SITE, known)], "page_id long, url string, known boolean").repartition(4)
    got = templates.filter_urls(pages, [], F.col("known"))
    assert rows_of(got) == multiset(plain_filter(SITE, [], templates.TreeRules(), known))
    verdicts = {(r.path.split("/")[1], r.verdict) for r in got.collect()}
    # What has no labels is allowed.
    assert verdicts == {("item", "allow"), ("promo", "block"), ("sale", "block"), ("help", "allow")}


def test_urls_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET?x://y/en/", "x://a://b/c", "http://example.net/en/\n/x", "http://ÄÖ.Net/de#a?b",
            "http://example.com/de", "http://example.com/de/", "http://notnet/", "http://a.b.org/fr/x.html", "http://h/" + "long/" * 30_000 + "x",
            "http://h/" + "y" * 100_000, "http://h//", "http://h/a//b/"] + ["http://dup.com/en/1"] * 20
    rows = [(i if i != 3 else None, u) for i, u in enumerate(urls)] + [(None, None), (5, "http://example.net/en/1")]
    columns = "page_id long, url string, host int, path int, shape int, node int, n int, bad int, verdict int, segments int, rows int"
    pages = spark.createDataFrame([(*r, *[None] * 9) for r in rows], columns).repartition(3)
    assert rows_of(templates.filter_urls(pages, queries.URL_RULES)) == multiset(plain_filter(rows, queries.URL_RULES, templates.TreeRules()))
    assert templates.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_urls_stay_in_the_jvm(spark, sf):
    plan = queries.op11_url_templates(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
