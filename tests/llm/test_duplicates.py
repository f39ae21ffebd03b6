"""Line dedup, SimHash and substring dedup against brute force."""
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import xxhash
from conftest import SF_SMALL
from pyspark.sql import functions as F

from faultline.llm import line_dedup, simhash, substring_dedup
from faultline.llm.components import star_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---- line dedup -------------------------------------------------------------
def test_line_dedup_equals_oracle_sql(read):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    got = line_dedup.report(read("documents"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(line_dedup.ORACLE).fetchall())


def test_line_dedup_plan_has_no_python(read, capsys):
    line_dedup.report(read("documents")).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_line_dedup_keeps_all_but_the_first_copy(make):
    lines = [f"line {k} of a passage that is shared" for k in range(30)]
    docs = make([(k, "\n".join([f"own start {k}", f"own second {k}", *lines, f"own end {k}"])) for k in range(4)])
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left[0] == docs.filter("doc_id = 0").first().text
    for k in (1, 2, 3):
        kept = left[k].split("\n")
        assert kept[0] == f"own start {k}" and kept[-1] == f"own end {k}" and len(kept) < 15
        assert kept == [x for x in kept if "own" in x or x in lines]


def test_line_dedup_tricky_rows(tricky, empty):
    done = line_dedup.dedup_lines(tricky)
    assert done.columns == tricky.columns and done.count() == tricky.count()
    left = sorted(((r.doc_id, r.text) for r in done.collect()), key=str)
    before = sorted(((r.doc_id, r.text) for r in tricky.collect()), key=str)
    for (i, new), (j, old) in zip(left, before):
        assert i == j
        if i in (1, 2, 3, 4, 5, 6, 8, 9):
            assert new == old
    long_text = next(t for i, t in before if i == 6)
    copies = [t for i, t in left if t is not None and i in (7, None) and len(t) > 10]
    assert len(copies) == 2 and all(len(t) < 0.6 * len(long_text) for t in copies)
    assert line_dedup.dedup_lines(empty).collect() == []


def brute_passages(rows):
    """Lines of each (id, text) that stay: pairs of lines by their bytes, one document after another."""
    first, out = {}, {}
    for i, text in sorted(rows):
        lines, gone, here = text.split("\n"), set(), {}
        for k, pair in enumerate(zip(lines, lines[1:])):
            if "".join(pair).strip(" \t\r"):
                if first.setdefault(pair, i) != i or k > here.setdefault(pair, k) + 1:
                    gone |= {k, k + 1}
        out[i] = "\n".join([x for k, x in enumerate(lines) if k not in gone] or lines[:1])
    return out


def test_passages_of_any_length_go_whole_in_any_context(make):
    rnd = random.Random(4)
    shared = {n: [[f"{n} {j} {k}" for k in range(n)] for j in range(8)] for n in (2, 3, 4, 6, 8, 20)}
    rows, context = [], iter(range(10 ** 6))
    for copy in range(3):
        for passages in shared.values():
            for p in passages:
                own = lambda: [f"own {next(context)}" for _ in range(rnd.randint(1, 4))]
                rows.append((len(rows), "\n".join(own() + p + own())))
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert left[i].split("\n") == (lines if i < len(rows) // 3 else [x for x in lines if x.startswith("own")])


def test_passages_equal_brute_force_on_few_lines(make):
    rnd = random.Random(11)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "d", "", " ", "e\r"]) for _ in range(rnd.randint(1, 9)))) for i in range(120)]
    rows += [(200, "same\nsame\nsame"), (201, "self\nother\nx\nself\nother")]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()} == brute_passages(rows)


def test_chunks_of_three_rules_hold_every_pair_of_neighbours(make):
    rnd = random.Random(5)
    for text in ("a", "a\nb", "a\nb\nc\n" * 50, "\n".join(str(rnd.random()) for _ in range(500)), "same\n" * 400 + "end"):
        lines = text.split("\n")
        got = make([(1, text)]).select(line_dedup.chunks_of(F.col("text")).alias("c")).first().c
        spans = [(x.at, x.n_lines) for x in got]
        assert len(set(spans)) == len(spans) and all(n > 1 and at + n <= len(lines) and len(x.key) == 3 * n for (at, n), x in zip(spans, got))
        assert {(k, 2) for k in range(len(lines) - 1)} <= set(spans)
        assert sum(n for _, n in spans) <= 8 * len(lines)


def test_chunks_do_not_move_with_what_stands_before_them(make):
    rnd = random.Random(6)
    passage = [str(rnd.random()) for _ in range(300)]
    one, two = (make([(1, "\n".join(own + passage))]).select(line_dedup.chunks_of(F.col("text")).alias("c")).first().c for own in (["x"], ["y", "z", "w"]))
    inside = lambda chunks, own: {(x.at - own, x.n_lines, tuple(x.key)) for x in chunks if x.at >= own}
    assert inside(one, 1) == inside(two, 3) and max(x.n_lines for x in one) > 10


def brute_report(rows):
    """op1 by brute force over (id, text), an id being one document."""
    stay = brute_passages([(i, t) for i, t in rows if t is not None])
    first, out = {}, []
    for i, text in sorted((r for r in rows if r[1] is not None)):
        lines, gone, here = text.split("\n"), set(), {}
        for k, pair in enumerate(zip(lines, lines[1:])):
            if "".join(pair).strip(" \t\r") and (first.setdefault(pair, i) != i or k > here.setdefault(pair, k) + 1):
                gone |= {k, k + 1}
        kept = [x for k, x in enumerate(lines) if k not in gone]
        assert stay[i] == "\n".join(kept or lines[:1])
        out.append((i, len(lines), len(gone), sha("\n".join(kept))))
    return sorted(out + [(i, 0, 0, sha("")) for i, t in rows if t is None])


def test_line_report_equals_brute_force(make, empty):
    rnd = random.Random(12)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "", " ", "d\r", "é漢😀"]) for _ in range(rnd.randint(1, 40)))) for i in range(80)]
    rows += [(300, None), (301, ""), (302, "\n"), (303, "a\n" * 3000), (304, "a\n" * 3000), (305, "q\n\n\n\nr"), (306, "q\n\n\n\nr"), (-7, rows[0][1])]
    assert sorted(map(tuple, line_dedup.report(make(rows)).collect())) == brute_report(rows)
    assert line_dedup.report(empty).collect() == []


def test_one_copy_stays_among_rows_without_an_id_or_of_one_id(make):
    for ident in (None, 9):
        rows = [(ident, f"own {k}\nfirst shared\nsecond shared\nend {k}") for k in range(6)] + [(ident, None)]
        left = [t for _, t, *_ in line_dedup.dedup_lines(make(rows)).collect() if t is not None]
        assert sum("first shared\nsecond shared" in t for t in left) == 1 and len(left) == 6
        assert sum(r.n_removed for r in line_dedup.report(make(rows)).collect()) == 10


def test_rows_equal_in_id_and_text_are_one_document(make):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb")]
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.report(make(rows)).collect()) == [(1, 0), (1, 0), (2, 2)]


def test_line_dedup_of_documents_with_text_ids(spark):
    docs = spark.createDataFrame([("b", "k\np\nq"), ("a", "p\nq\nl"), (None, "p\nq"), ("c", None)], "name string, body string")
    left = {r.name: r.body for r in line_dedup.dedup_lines(docs, "name", "body").collect()}
    assert left == {"a": "p\nq\nl", "b": "k", None: "p", "c": None}


def test_lines_with_equal_marks_and_other_bytes_stay(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "marks", lambda line: (F.length(line).cast("int"), F.lit(0), F.lit(0)))
    rows = [(1, "aa\nbbb\nx"), (2, "cc\nddd\ny"), (3, "longer\nthe longest"), (4, "longer\nthe longest\nz")]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()} == {**dict(rows[:3]), 4: "z"}


# ---- SimHash ----------------------------------------------------------------
def fingerprint(text):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    count = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        count += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * count[k] > len(shingles))


def brute_components(rows):
    fps = sorted({f for _, f in rows})
    sets, a = Sets(), np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 2):
            sets.join(f, fps[j])
    low = {}
    for i, f in rows:
        if i is not None:
            low[sets.find(f)] = min(i, low.get(sets.find(f), i))
    return [(i, f, low.get(sets.find(f))) for i, f in rows]


def test_simhash_whole_table(read):
    docs = read("documents")
    want = brute_components([(r.doc_id, fingerprint(r.text)) for r in docs.collect()])
    got = simhash.report(docs).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == sorted(want)
    assert len({c for *_, c in want}) < len(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_simhash_tricky_rows(tricky, empty):
    want = brute_components([(r.doc_id, fingerprint(r.text)) for r in tricky.collect()])
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.report(tricky).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    groups = {(r.root, r.component_id) for r in simhash.near_duplicates(tricky).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(c for _, c in groups)
    assert simhash.report(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_links_connect_clusters_of_near_fingerprints(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(4):
        center = rnd.getrandbits(64)
        for _ in range(250):
            x = center
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randint(0, 63)
            fps.add(x - (1 << 64) if x >> 63 else x)
    roots = {r.u: r.root for r in star_components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    got = Counter(roots.get(x, x) for x in fps)
    want = brute_components([(x, x & (1 << 64) - 1) for x in fps])
    assert sorted(got.values()) == sorted(Counter(c for *_, c in want).values())


def test_gray_index_finds_all_groups_in_crowded_trees():
    rnd = random.Random(6)
    for free in (10, 14, 24):
        fps = np.array(sorted({(0xABCDEF << 40) | rnd.getrandbits(free) for _ in range(1500)}), np.uint64)
        got = simhash.GrayIndex(fps).link(2)
        want = brute_components([(i, int(f)) for i, f in enumerate(fps)])
        assert len(set(got.tolist())) == len({c for *_, c in want})
        assert all(got[i] == got[c] for i, _, c in want)


def test_components_of_a_long_chain_and_an_empty_table(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in star_components(chain).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}
    assert star_components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---- substring dedup ----------------------------------------------------------
def brute_substrings(rows, window=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - window + 1) if count[tuple(w[k:k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def test_substring_dedup_whole_table(read):
    rows = [(r.doc_id, r.text) for r in read("documents").collect()]
    got = sorted(map(tuple, substring_dedup.report(read("documents")).collect()), key=str)
    assert got == brute_substrings(rows) and sum(r[2] for r in got) > 0


def test_substring_dedup_tricky_rows(tricky, empty):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    assert sorted(map(tuple, substring_dedup.report(tricky).collect()), key=str) == brute_substrings(rows)
    assert substring_dedup.report(empty).collect() == []


def test_substring_dedup_over_many_chunks_and_buckets(make, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 90))) + (" " + passage if k % 3 == 0 else "")) for k in range(120)]
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 200)
    monkeypatch.setattr(substring_dedup, "STRETCH_WORDS", 300)
    assert sorted(map(tuple, substring_dedup.report(make(rows)).collect()), key=str) == brute_substrings(rows)


def test_rolling_hash_is_the_polynomial():
    w = np.array([random.Random(1).getrandbits(64) for _ in range(50)], np.uint64)
    base, k = substring_dedup.BASES[0], 7
    got = substring_dedup.Rolling(base, k, 60)(w)
    for i in range(len(w) - k + 1):
        h = 0
        for x in w[i:i + k].tolist():
            h = (h * base + x) & substring_dedup.MASK
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & substring_dedup.MASK
        assert int(got[i]) == h ^ (h >> 32)
