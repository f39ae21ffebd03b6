"""URL filters, spelling variants and hard negatives against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import hard_negatives, spelling, url_filter


# --- urls --------------------------------------------------------------------------------------------

def brute_verdict(url, rules, default="allow"):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def judged(df):
    return sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in df.collect())


def expected(rows, rules):
    out = []
    for i, url in rows:
        host, path, rule, verdict = brute_verdict(url, rules)
        out.append((str(i), host, path, str(rule), verdict))
    return sorted(out)


URLS = [None, "", "net/", "http://", "http://net", "http://net/", "http://NET/en/", "http://example.net/en/", "http://example.net/en", "http://xexample.net/en/",
        "http://a.example.net/en/x://b.org/fr/", "http://example.com/de/?x=/fr/", "x://example.com?/de/", "y://deep.er.org/fr/#a", "//org/fr/", "http://org/FR/",
        "http://.net/", "http://net./", "http://a..net/x", "https://user@example.com:80/de/", "http://net\n/en/", "http://example.net\n/en/", "http://é.net/é", "http://" + "a." * 5000 + "net/" + "x" * 100000]


@pytest.fixture(scope="module")
def pages(spark):
    def made(rows):
        return spark.createDataFrame([(i, u, "k", "h", "v", "r") for i, u in rows], "page_id long, url string, key string, host string, verdict string, rule string")
    return made


def test_urls_of_every_kind_and_repeated_rows(pages):
    rows = [(None if k % 7 == 3 else k, u) for k, u in enumerate(URLS)] * 2
    assert judged(url_filter.report(pages(rows))) == expected(rows, url_filter.RULES)


def test_no_urls_and_no_rules(spark, pages):
    assert url_filter.report(pages([])).count() == 0
    none = url_filter.rule_table(spark, [])
    rows = [(1, "http://a.net/"), (2, None)]
    assert judged(url_filter.judge(pages(rows), none, ["page_id"])) == expected(rows, [])


def test_nested_rules_over_many_partitions(spark, pages):
    rng = random.Random(3)
    labels, paths = ["net", "a", "b", "example", "x-y", "é"], ["", "/", "/a", "/a/", "/a/b", "/b/"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(150)] + [("", "/", "block")]
    urls = [f"http://{host()}{rng.choice(paths)}{rng.choice(['', 'c', '/d'])}" for _ in range(600)] + ["http://b.a.net/a/b"] * 900
    rows = list(enumerate(urls))
    table = url_filter.rule_table(spark, [*rules, (None, "/", "block"), ("NET", None, "allow")])
    got = judged(url_filter.judge(pages(rows), table, ["page_id"]))
    assert got == expected(rows, [*rules, ("net", "", "allow")])


def test_carried_columns_keep_their_names(spark, pages):
    out = url_filter.judge(pages([(1, "http://a.net/x")]), url_filter.rule_table(spark, url_filter.RULES), ["page_id", "host", "verdict"], default="block")
    row = out.first().asDict()
    assert out.columns[:3] == ["page_id", "host", "verdict"] and row["host"] == "h" and row["_host"] == "a.net" and row["_verdict"] == "block"


# --- words -------------------------------------------------------------------------------------------

def brute_near(words):
    """Pairs one inserted, deleted or replaced letter apart, by the definition."""
    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    return {(a, b) for a in words for b in words if a != b and apart(a, b)}


def brute_grouped(n):
    near = {w: set() for w in n}
    for a, b in brute_near(n):
        near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters,length,count", [("ab", (1, 6), 90), ("abcé", (4, 9), 250), ("ab", (44, 50), 60), ("ab", (95, 99), 40)])
def test_near_pairs_of_random_words(spark, letters, length, count):
    rng = random.Random(length[0])
    words = set()
    while len(words) < count:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*length)))
        words.add(w)
        at = rng.randrange(len(w))
        words |= {x for x in (w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at + 1:], w[:at] + rng.choice(letters) + w[at:]) if x}
    got = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == brute_near(words)


def test_forms_and_roots_follow_counts(spark):
    n = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "baaaaaa": 10, "aaaaaac": 9, "xyzxyzx": 5, "xyzxyz": 50, "yzxyzx": 50}
    got = rows_of(spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_grouped(n)
    assert ("aaaaaaa", "aaaaaab", "aaaabbb", 1, 3, 10) in got


def brute_report(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return brute_grouped({w: k for w, k in count.items() if len(w) >= 7 and k >= 2})


def test_spelling_report_on_documents(spark, read):
    docs = read("documents").limit(60)
    assert rows_of(spelling.report(docs)) == brute_report([(r.doc_id, r.text) for r in docs.collect()])


def test_spelling_report_on_tricky_rows(spark, make, tricky, empty):
    long_run = "".join(random.Random(1).choice("abcdefgh") for _ in range(20000))
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    rows += [(20 + k, t) for k, t in enumerate([long_run] * 12 + [long_run[:5000] + "z" + long_run[5001:], long_run[:-1] + "Q"] * 2)]
    rows += [(40 + k, "ÀÉtudes×÷ straßen Straßen STRASSEN straßex") for k in range(40)] * 2
    got = rows_of(spelling.report(make(rows)))
    few = {r for r in brute_report([x for x in rows if x[1] is None or len(x[1]) < 10000 or " " in x[1]])}
    assert few == {r for r in got if len(r[0]) < 1000}
    assert all(n_near >= 1 for w, _, _, _, n_near, _ in got if len(w) >= 19999)
    assert spelling.report(empty).count() == 0 and spelling.report(make([(1, None), (None, "")])).count() == 0


# --- vectors -----------------------------------------------------------------------------------------

def brute_mined(rows, every=50, n_pos=5, n_neg=3):
    """rows: (id, list of integers, label); exact Python integers."""
    width = max((len(v) for _, v, _ in rows), default=0)
    rows = [(i, [*v, *[0] * (width - len(v))], y) for i, v, y in rows]
    out, order = Counter(), lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (i, v, y) in enumerate(rows):
        if i is None or i % every:
            continue
        s = [(sum(p * q for p, q in zip(v, w)), j, z) for k, (j, w, z) in enumerate(rows) if k != a]
        for ps, pid, _ in sorted((x for x in s if x[2] == y), key=order)[:n_pos]:
            fit = sorted((x for x in s if x[2] != y and 50 * ps <= 100 * x[0] <= 95 * ps), key=order)[:n_neg]
            for r, (ns, nid, _) in enumerate(fit, 1):
                out[i, pid, r, nid, ps, ns] += 1
    return out


def mined(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def label_of(i, y):
    return (y + 1) % 10 if i is not None and i % 7 == 0 else y


def test_hard_negatives_of_the_given_vectors(spark, read):
    df = read("embeddings")
    rows = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding], label_of(r.vec_id, r.label)) for r in df.collect()]
    assert mined(hard_negatives.report(df)) == brute_mined(rows)


def test_runs_of_neighbouring_vectors_are_ruled_out_and_results_stay_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 40
    rows = [(i, (centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=8) * 3).tolist(), int(i % 4)) for i in range(900)]
    rows += [(1000 + i, rows[50][1], 1) for i in range(300)]
    monkeypatch.setattr(hard_negatives, "RUN", 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows]
    got = hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), every=50)
    assert mined(got) == brute_mined(whole)


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(size=(500, 6)) * 5 + c for c in (60 * np.eye(6)[0], 60 * np.eye(6)[3], -60 * np.eye(6)[0])])).astype(np.int64)
    refs = hard_negatives.directions([v.astype(float) for v in x[::10]], 4)
    norm = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip((x / norm[:, None]) @ refs.T, -1, 1))
    rows = hard_negatives._Rows.__new__(hard_negatives._Rows)
    rows.row, rows.id, rows.no_id, rows.label, rows.vectors, rows.norm, rows.angles, rows.width = np.arange(1500), np.arange(1500), np.zeros(1500, bool), np.zeros(1500, int), list(x), norm, angles, 6
    block, low = hard_negatives._Block(rows), np.full(1500, 2500.0)
    spared = 0
    for run in block.runs:
        at, mask = block.overlaps(rows, run, low, np.full(1500, np.inf))
        may = np.zeros((1500, len(run[0])), bool)
        may[at] = mask if len(at) else False
        true = x @ x[run[0]].T >= 2500
        assert not (true & ~may).any()
        spared += (~may).sum()
    assert spared > 1500 * 1500 / 2


def test_hard_negatives_of_tricky_rows(spark):
    nan, inf, big = float("nan"), float("inf"), 3e6
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (None, [1.0, 1.9], 1), (None, [0.9, 1.5], 2), (3, [0.0, 0.0], 1), (50, [], 2), (100, [big, -1.0], 3), (4, [big / 3, 5.0], 3),
            (5, [big / 4, 7.0], 4), (6, [0.5, 1.5, 9.0], 4), (8, [0.5, 1.5], 4), (9, [0.5, 1.5], 4), (10, [0.5, 1.5], 4), (150, [0.1], None), (11, None, 1), (12, [nan, 1.0], 1),
            (13, [inf, 1.0], 1), (14, [-1.0, -2.0], 2), (200, [-1.0, -2.0], 1)]
    df = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], "vec_id long, embedding array<double>, label int, row string, norm string")
    hole = spark.createDataFrame([(15, [None, 1.0], 1, "x", "y")], df.schema)
    kept = [(i, [hard_negatives.to_integers(np.array([c]), 256)[0] for c in v], label_of(i, y)) for i, v, y in rows if v is not None and y is not None and np.isfinite(v).all()]
    kept = [(i, [int(c) for c in v], y) for i, v, y in kept]
    assert mined(hard_negatives.report(df.union(hole))) == brute_mined(kept)
    assert hard_negatives.report(df.limit(0)).count() == 0
    assert hard_negatives.report(df.filter("embedding IS NULL")).count() == 0


def test_scores_beyond_a_long_count_as_its_end(spark):
    assert hard_negatives.to_integers(np.array([1e300, -0.1]), 256) == [int(1e300) * 256, -26]
    rows = [(0, [1e300, 1.0], 1), (1, [1e200, 1.0], 1), (2, [-1e200, 0.0], 2), (3, [2.0 ** -60, 30.0], 2)]
    got = hard_negatives.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert [(r.positive_id, r.positive_score) for r in got.collect()] in ([], [(1, hard_negatives.MOST)])
