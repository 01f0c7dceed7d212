"""The text operators against brute force, on small tables with nulls, empty and
long texts, ties, repeated rows, extra columns, and no rows at all."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungfleet.llm import containment, jaccard_join, licenses, mixing, passages, quality_rules, repeats, token_counts, toxicity, url_lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ba ce di fo gu ha je ki lo mu né pa qu ra sé".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(30, 160)) for _ in range(30)]
    near = texts[0].split(" ")
    near[5] = "edited"
    shared = sentence(rng, 70)
    texts += [texts[0], texts[0], " ".join(near), texts[1].upper(), texts[2] + " " + shared, shared + " " + texts[3], "x" * 900, "one", "two words", "", None, "  \n\t ", sentence(rng, 4000) + " " + shared]
    rows = [(i, t, f"src{i % 3}" if i % 7 else None, "en" if i % 2 else None, "clash", 1) for i, t in enumerate(texts)]
    return [*rows, rows[1], (None, texts[4], "src0", "en", "clash", 1), (None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, source string, lang string, token string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def shingles(text, n):
    ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def test_repeats(docs, nothing):
    rows = corpus()
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    want = Counter()
    for (doc, *_), t in zip(rows, data, strict=True):
        cover = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        want[doc, len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in repeats.repeat_digests(docs).collect()) == want
    assert repeats.repeat_digests(nothing).count() == 0


def test_repeats_of_very_many_contexts(docs):
    counted = repeats.repeated_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), many=1)
    indexed = repeats.repeated_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def covered(df):
        return {(r.doc_id, r.row): sorted({i for s in r.spans for i in range(s.start, s.stop)}) for r in df.collect()}

    assert covered(counted) == covered(indexed)


def test_run_length_index():
    rng = random.Random(1)
    for _ in range(60):
        length = rng.choice([3, 6])
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 6))]
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]
        assert [x.tolist() for x in repeats.repeated_starts(parts, length)] == want


def test_remove_repeats_keeps_columns(docs):
    out = repeats.remove_repeats(docs)
    assert out.columns == docs.columns
    assert all(WORD.search(r.text) for r in out.collect())


def test_passages(docs, nothing):
    got = {r.doc_id: r for r in passages.passage_classes(docs.where("doc_id is not null")).collect()}
    where = defaultdict(set)
    for doc, text, *_ in corpus():
        ws = WORD.findall((text or "").lower())
        for i in range(len(ws) - 49):
            where[tuple(ws[i : i + 50])].add(doc)
    exact = {d for ds in where.values() if len(ds - {None}) > 1 for d in ds if d is not None}
    assert exact and all(got[d].n_passages > 0 for d in exact)
    for d in set(got) - exact:
        assert got[d].n_passages == 0 or d in (0, 30, 31, 32)
    assert got[34].class_id == got[35].class_id == got[42].class_id
    assert passages.passage_classes(nothing).count() == 0


def test_passages_of_families_with_a_common_core(spark):
    rng = random.Random(11)
    core = sentence(rng, 34)
    rows = []
    for family in range(12):
        # 50 words whose middle all families share
        text = sentence(rng, 8) + " " + core + " " + sentence(rng, 8)
        rows += [(family, text), (100 + family, sentence(rng, 20) + " " + text)]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + family] == got[family] for family in range(12))


def test_passages_where_minima_recur(spark):
    rng = random.Random(12)
    rows = []
    for k in range(8):
        ws = sentence(rng, 50).split(" ")
        # most shingles of the passage occur once more before it, 11 words further from one another in one of the texts
        parts = [" ".join(ws[i : i + 10]) for i in range(0, 41, 5)]
        rows += [(2 * k, " qu ".join(parts) + " " + " ".join(ws)), (2 * k + 1, sentence(rng, 30) + " " + " ".join(ws))]
    got = {r.doc_id: r for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1].class_id == 2 * k and got[2 * k + 1].n_words >= 50 for k in range(8))


def test_longest_similar_part_of_a_stretch():
    import numpy as np

    # 60 equal shingles, then every second one equal: too different as a whole, and longer than the run
    a = np.arange(1, 221)
    b = np.where((np.arange(220) >= 60) & (np.arange(220) % 2 == 1), a + 1000, a)
    ((x, y, u, v),) = passages.shared_passages(a, b, [(10, 10)], 46, 0.8)
    best = max(n for n in range(46, 221) if len(set(a[:n]) & set(b[:n])) >= 0.8 * len(set(a[:n]) | set(b[:n])))
    assert (x, y, u, v) == (0, best, 0, best) and best > 61
    # a recurring shingle is taken where it is nearest to the diagonal
    c = np.concatenate([[7], np.arange(500, 560), a[:30], [900], a[30:60]])
    assert passages.shared_passages(a[:60], c, [(20, 81)], 46, 0.8) == [(0, 60, 61, 122)]


def test_toxicity(spark, nothing):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 40) + (" awful horrid" if i % 8 == 0 else ""), i % 8 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "awful horrid")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    truth = {i: int(y) for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (9000, 9001)} and [r.predicted for r in out if r.doc_id is None] == [1]
    assert toxicity.drop_toxic(docs, labels).where("text like '%awful%'").count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, labels).count() == 0


def test_nearest_entries_are_exact():
    import numpy as np

    rng = random.Random(5)
    entries = {}
    for i in range(700):
        v = tuple(sorted({rng.randrange(60): toxicity.level(rng.randint(1, 9)) for _ in range(rng.randint(1, 7))}.items()))
        entries[v] = (v, rng.random() + 0.2, 0.1, i)
    index = toxicity.Index([f"t{i}" for i in range(60)], np.linspace(1, 3, 60), list(entries.values()), 0.1)
    for _ in range(50):
        q = index.vector({rng.randrange(60): 1 for _ in range(rng.randint(1, 5))})
        sims = np.bincount(index.rows, np.array([q.get(c, 0.0) for c in index.cols.tolist()]) * index.vals, len(index.weight))
        order = [i for i in np.lexsort((np.arange(len(sims)), -sims)) if sims[i] > 0]
        reach = np.searchsorted(np.cumsum(index.weight[order]), 5)
        floor = sims[order[min(reach, len(order) - 1)]] - 1e-12
        assert set(index.nearest(q, 5)[0].tolist()) == {i for i in order if sims[i] >= floor}


@pytest.mark.parametrize("n", [3])
def test_jaccard_join(docs, nothing, n):
    rows = [(d, shingles(t, n)) for d, t, *_ in corpus()]
    group = {d: d for d, _ in rows if d is not None}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    want = Counter((d, len(s), root(d) if d is not None else None) for d, s in rows)
    assert Counter(tuple(r) for r in jaccard_join.similar_groups(docs).collect()) == want
    assert jaccard_join.similar_groups(nothing).count() == 0


def test_one_of_each_group_stays(docs):
    kept = [r.doc_id for r in jaccard_join.keep_one_of_each(docs).select("doc_id").collect()]
    assert 0 in kept and 30 not in kept and 31 not in kept and 32 not in kept and kept.count(None) == 2


def test_licenses(docs, nothing):
    lines = docs.sparkSession.createDataFrame([(500, "ba ce\nLicensed under the Apache License, Version 2.0.\ndi fo"), (501, "Released under the MIT License."), (502, "the license of the house is red")], "doc_id long, text string")
    out = licenses.scan_licenses(docs.select("doc_id", "text").union(lines)).where("confirmed").collect()
    assert {(r.doc_id, r.paragraph_no, r.family) for r in out} == {(500, 1, "Apache-2.0"), (501, 0, "MIT")}


def test_url_lists(spark):
    caps = spark.createDataFrame([("http://u:p@A.Example.com:80/x/y?q", 5), ("http://a.example.com/x/y", 11), ("http://b.example.com/z", 5), ("http://other.org/", 5), (None, 5), ("junk", 5), ("http://other.org/", None)], "url string, fetched int")
    events = spark.createDataFrame([("example.com", "add", 1), ("example.com", "remove", 10), ("a.example.com/x", "add", 3), ("other.org", "add", 5), ("other.org", "remove", 5), (None, "add", 1)], "key string, action string, effective int")
    got = [(r.url, r.fetched, r.blocked, r.matched_key) for r in url_lists.filter_captures(caps, events).collect()]
    assert Counter(got) == Counter([("http://u:p@A.Example.com:80/x/y?q", 5, True, "a.example.com/x"), ("http://a.example.com/x/y", 11, True, "a.example.com/x"), ("http://b.example.com/z", 5, True, "example.com"), ("http://other.org/", 5, False, None), (None, 5, False, None), ("junk", 5, False, None), ("http://other.org/", None, False, None)])
    assert url_lists.filter_captures(caps, events.limit(0)).where("blocked").count() == 0
    assert url_lists.filter_captures(caps.limit(0), events).count() == 0


def test_token_counts(spark, docs, nothing):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    extra = ["a <|endoftext|><|endoftext|> b", "don't  stop\n\n now　漢字 ½ 🙂", "\x1c\x85x"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for r in token_counts.count_tokens(d, path).join(d, "doc_id").collect():
        want = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        if r.doc_id != 1:  # the id that two rows share
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((r.text or "").encode()), want > 512)
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_quality_measures(docs, nothing):
    def brute(text):
        ws = WORD.findall(text or "")
        win = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        rep = {j for i in range(len(ws) - 7) if win[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)

    texts = [t for _, t, *_ in corpus()] + ["a b c d e f g h " * 5, "a " * 40, "l1 x\nl1 x\n\n \nl1 x\nq#*", "a b c d e f g h a b c d e f g h i"]
    d = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.measures(d).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    labels = d.sparkSession.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")
    assert quality_rules.apply_rules(docs, labels).count() == docs.count()
    assert quality_rules.apply_rules(nothing, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 100), (3, 400), (10, 5000), (0, 0), (60, 2000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for k, n, p in df.collect():
        exact = sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) if k < n * 0.02 else 1.0
        assert p == pytest.approx(exact, rel=1e-6)


def test_mixing(docs, nothing):
    out = mixing.mix(docs).collect()
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for size, taken, target in per.values():
        assert abs(taken - target) <= 0.5 and target <= 3 * size
    assert sum(t for *_, t in per.values()) == pytest.approx(sum(s for s, *_ in per.values()))
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_containment(docs, nothing):
    items = [(1, corpus()[6][1]), (2, "two words"), (3, None), (4, ""), (5, " ".join(corpus()[42][1].split(" ")[100:140])), (6, "not there at all in any of them")]
    table = docs.sparkSession.createDataFrame(items, "item_id long, text string")
    want = set()
    by_id = defaultdict(set)
    for d, t, *_ in corpus():
        by_id[d] |= shingles((t or "").lower(), 5)
    for i, t in items:
        s = shingles((t or "").lower(), 5)
        want |= {(d, i, len(s), len(s & x)) for d, x in by_id.items() if s and 10 * len(s & x) >= 8 * len(s)}
    assert {tuple(r) for r in containment.contained_items(docs, table).collect()} == want
    assert containment.contained_items(nothing, table).count() == 0
    assert containment.decontaminate(docs, table.limit(0)).count() == docs.count()
    left = {r.doc_id for r in containment.decontaminate(docs, table).collect()}
    assert left == set(by_id) - {d for d, *_ in want}


def test_containment_tells_rows_that_share_an_id_apart(spark):
    rng = random.Random(13)
    leaks = [sentence(rng, 20) for _ in range(3)]
    halves = leaks[0].split(" ")
    docs = [(None, "a " + leaks[1]), (None, sentence(rng, 30)), (7, leaks[2]), (7, sentence(rng, 30)), (8, " ".join(halves[:12])), (8, " ".join(halves[8:])), (9, leaks[0] + " b")]
    items = [(None, leaks[1]), (None, leaks[0]), (3, leaks[2]), (3, sentence(rng, 20)), (3, leaks[2])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in containment.contained_items(d, i).collect()) == Counter([(None, None, 16, 16), (7, 3, 16, 16), (9, None, 16, 16)])
    left = Counter(tuple(r) for r in containment.decontaminate(d, i).collect())
    assert left == Counter(docs[k] for k in (1, 3, 4, 5))


CLASHES = ("spans", "copy", "leaked", "leaked_row", "candidate", "host", "row", "row_key", "blocked", "size", "hash")


def clashing(df):
    """``df`` with columns that are named as what operators use inside."""
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def test_columns_with_clashing_names(docs):
    wide = clashing(docs)
    items = clashing(docs.sparkSession.createDataFrame([(1, corpus()[6][1])], "item_id long, text string"))
    labels = clashing(docs.sparkSession.createDataFrame([(i, int(i < 3)) for i in range(20)], "doc_id long, toxic int"))
    kept = {
        "repeats": (repeats.remove_repeats(wide), repeats.remove_repeats(docs)),
        "copies": (jaccard_join.keep_one_of_each(wide), jaccard_join.keep_one_of_each(docs)),
        "leaks": (containment.decontaminate(wide, items), containment.decontaminate(docs, items)),
        "toxic": (toxicity.drop_toxic(wide, labels), toxicity.drop_toxic(docs, labels)),
    }
    for name, (got, want) in kept.items():
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in docs.columns), name
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in want.collect()), name
    results = [
        (repeats.repeat_digests, ()), (passages.passage_classes, ()), (jaccard_join.similar_groups, ()), (mixing.mix, ()),
        (containment.contained_items, (items,)), (toxicity.score_toxicity, (labels,)), (licenses.scan_licenses, ()),
    ]
    for fn, more in results:
        assert Counter(map(str, fn(wide, *more).collect())) == Counter(map(str, fn(docs, *more).collect())), fn.__name__
    urls = docs.sparkSession.createDataFrame([("http://a.example.com/", 5, "mine", "mine", "x")], "url string, fetched int, host string, blocked string, u string")
    events = docs.sparkSession.createDataFrame([("example.com", "add", 1)], "key string, action string, effective int")
    (r,) = url_lists.filter_captures(urls, events).collect()
    assert (r.u, r.host, r.blocked, r.matched_key) == ("x", "a.example.com", True, "example.com")


def test_passages_with_boilerplate_inside(spark):
    rng = random.Random(21)
    boilerplate = sentence(rng, 30)
    rows = [(i, sentence(rng, 40) + " " + boilerplate + " " + sentence(rng, 40)) for i in range(40)]
    for k in range(100):
        shared = sentence(rng, 15) + " " + boilerplate + " " + sentence(rng, 15)
        rows += [(1000 + 2 * k, sentence(rng, 25) + " " + shared), (1001 + 2 * k, shared + " " + sentence(rng, 25))]
    got = {r.doc_id: r for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1001 + 2 * k].class_id == got[1000 + 2 * k].class_id and got[1001 + 2 * k].n_links > 0 for k in range(100))
    assert all(got[i].n_links == 0 and got[i].class_id == i for i in range(40))


def test_passages_recall_of_near_copies(spark):
    rng = random.Random(22)
    rows, n = [], 150
    for k in range(n):
        ws = sentence(rng, rng.randint(60, 200)).split(" ")
        near = list(ws)
        for at in range(rng.randint(20, 40), len(ws), 60):  # about five of sixty shingles differ
            near[at] = "edited"
        rows += [(2 * k, " ".join(ws) + " " + sentence(rng, 40)), (2 * k + 1, sentence(rng, 40) + " " + " ".join(near))]
    got = {r.doc_id: r for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = sum(got[2 * k].class_id == got[2 * k + 1].class_id for k in range(n))
    assert met >= 0.9 * n
    assert all(r.class_id // 2 == r.doc_id // 2 for r in got.values())


def test_compact_windows_by_brute_force():
    import numpy as np

    from rungfleet.llm.wordsets import mix

    rng = np.random.default_rng(1)
    seqs = [mix(rng.integers(0, 30 if k % 3 == 0 else 1 << 60, rng.integers(0, 200), dtype=np.uint64)) for k in range(40)]
    width, want = 11, set()
    for d, s in enumerate(seqs):
        for fn in range(3):
            h = (mix(s ^ np.uint64(passages._SEED * (fn + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(34)).astype(int)
            runs = []
            for i in range(len(s) - width + 1):
                c = i + int(np.argmin(h[i : i + width]))
                if runs and s[runs[-1][0]] == s[c]:
                    runs[-1][2] = i
                else:
                    runs.append([c, i, i])
            want |= {(int(mix(mix(s[c : c + 1]) + np.uint64(fn))[0]), d, c, f, e) for c, f, e in runs}

    def rows(windows):
        return {(v, d, c, f, e) for w in windows for v, d, c, f, e in zip(w["value"].view(np.uint64).tolist(), *(w[k].tolist() for k in ("doc", "center", "first", "last")), strict=True)}

    assert rows(passages.compact_windows(seqs, width, 3)) == want
    keep = {v for i, v in enumerate(sorted({w[0] for w in want})) if i % 2}
    cover = Counter((d, i) for v, d, _, f, e in want if v in keep for i in range(f, e + 1))
    cut = set()
    for v, d, c, f, e in want:
        at = [i for i in range(f, e + 1) if cover[d, i] >= 2]
        if v in keep and at:
            cut.add((v, d, c, at[0], at[-1]))
    assert rows(passages.compact_windows(seqs, width, 3, lambda v: np.array([x in keep for x in v.tolist()], bool), 2)) == cut


def test_passages_of_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(23)
    a, b, c = sentence(rng, 80), sentence(rng, 80), sentence(rng, 80)
    rows = [(5, a), (5, b), (6, "x " + a), (7, b), (None, c), (8, c + " y"), (9, "short"), (10, "short"), (11, None), (5, a)]
    got = Counter(tuple(r)[:4] for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 5, 2, 1): 2, (5, 5, 1, 1): 1, (6, 5, 1, 0): 1, (7, 5, 1, 1): 1, (None, None, 0, 0): 1, (8, 8, 0, 0): 1, (9, 9, 0, 0): 1, (10, 10, 0, 0): 1, (11, 11, 0, 0): 1})


def test_licenses_against_plain_scores(docs):
    import math

    lines = ["Licensed under the Apache License, Version 2.0.", "released UNDER the mit license!", "a general public license of sorts", "ba ce di", "the house is licensed"]
    d = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(90, "This program is free software: you can redistribute\nit and/or modify it under the terms of the GNU General\nPublic License as published by the Free Software Foundation,\neither version 3 of the License, or any later version.\n\nother words"), (None, lines[0]), (0, lines[0]), (91, None), (92, "")], "doc_id long, text string").union(docs.select("doc_id", "text"))
    weights, bias, stems = licenses.train(d)
    table = {r.gram: r.by_family for r in weights.collect()}
    assert stems and all(any(s in g for s in stems) for g in table)
    out = licenses.scan_licenses(d).collect()
    assert Counter((r.doc_id, r.family) for r in out if r.confirmed and r.doc_id not in (90,)) == Counter({(0, "Apache-2.0"): 2, (None, "Apache-2.0"): 1, (1, "MIT"): 1})
    assert [(r.unit, r.paragraph_no, r.family) for r in out if r.doc_id == 90 and r.confirmed] == [("block", 0, "GPL-3.0")]
    for r in out:
        if r.unit == "line" and r.doc_id is not None and r.doc_id < 5:
            ws = re.sub(r"[^a-z0-9]+", " ", lines[r.doc_id].lower()).split()
            grams = {" ".join(ws[i : i + n]) for n in (2, 3) for i in range(len(ws) - n + 1)}
            z = [b + sum(table[g][k] for g in grams if g in table) for k, b in enumerate(bias)]
            assert r.probability == pytest.approx(1 / sum(math.exp(x - max(z)) for x in z), abs=1e-5)
            assert r.family == licenses.families()[z.index(max(z))]
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_license_threshold(spark):
    ps = spark.createDataFrame([(0.9,)] * 3 + [(0.7,)] * 4, "probability double")
    assert licenses.believed_from(ps, 1000, 0.001) == pytest.approx(0.9001)
    assert licenses.believed_from(ps, 3000, 0.001) == pytest.approx(0.7001)
    assert licenses.believed_from(ps, 7000, 0.001) == 0.5


def test_targets_by_the_rule_round_by_round(spark):
    rng = random.Random(5)
    for n in (1, 4, 9, 40):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 3, 50, 2000]) for i in range(n)} | {None: 7}
        names = sorted(k for k in sizes if k is not None) + [None]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
        target, full = {}, set()
        while True:
            free = [k for k in names if k not in full and sizes[k]]
            left = sum(sizes.values()) - sum(3 * sizes[k] for k in full)
            target = {k: 3.0 * sizes[k] if k in full or not sizes[k] else left * weight[k] / sum(weight[x] for x in free) for k in names}
            over = {k for k in free if target[k] > 3 * sizes[k]}
            if not over:
                break
            full |= over
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        assert {r.source: r.target for r in got.collect()} == pytest.approx(target)


def test_false_rejections_stay_within_the_allowance(spark):
    rng = random.Random(8)
    rows = []
    for s in range(30):
        for _ in range(3000):
            rows.append((f"s{s}", 100, int(100 * rng.expovariate(4)), 10, rng.randint(0, 9), rng.randint(0, 30), rng.randint(400, 1500)))
    good = spark.createDataFrame(rows, "stratum string, n_words long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, word_chars long")
    cutoffs = quality_rules.select_cutoffs(good).where("rule = 'symbols_per_word'").collect()
    assert cutoffs
    share = quality_rules.ALLOWANCE / len(quality_rules.GRID)
    # the true share of good documents above a cutoff c is exp(-4 c)
    assert all(2.718281828 ** (-4 * r.cutoff) <= share for r in cutoffs)


def test_binomial_tail_of_many_labels(spark):
    from math import exp, lgamma, log

    cases = [(900_000, 50_000_000), (2_500, 150_000), (1, 2_000), (39, 2_000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for k, n, p in df.collect():
        top = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(0.02) + (n - k) * log(0.98)
        total, term = 0.0, 1.0
        for i in range(k, -1, -1):
            total += term
            term *= i * 0.98 / ((n - i + 1) * 0.02)
            if term < 1e-18 * total:
                break
        assert p == pytest.approx(exp(top) * total, rel=1e-4, abs=1e-300)


def test_tokenizer_files_that_are_not_understood():
    import json

    plain = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE"}, "added_tokens": []}
    token_counts.check_supported(json.dumps(plain))
    for other in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "Unigram"}}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError):
            token_counts.check_supported(json.dumps(plain | other))


def test_containment_of_items_of_all_sizes(spark):
    rng = random.Random(14)
    items = [(k, sentence(rng, n)) for k, n in enumerate([3, 5, 6, 9, 17, 40, 90, 300, 900])]
    docs = []
    for k, t in items:
        ws = t.split(" ")
        for cut in (0, 1, len(ws) // 10, len(ws) // 4):
            docs.append((len(docs), sentence(rng, 50) + " " + " ".join(ws[cut:]) + " " + sentence(rng, 50)))
            docs.append((len(docs), t if cut == 0 else " ".join(ws[: len(ws) - cut])))
    want = {(d, i) for d, x in docs for i, t in items if (s := shingles(t.lower(), 5)) and 10 * len(s & shingles(x.lower(), 5)) >= 8 * len(s)}
    got = containment.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20


def test_mixing_of_rows_that_share_an_id(spark):
    """Rows of one id, and equal rows, are cut as the others are."""
    rng = random.Random(5)
    rows = [(None, sentence(rng, rng.randint(1, 9)), "a") for _ in range(150)] + [(None, "one two three", "a")] * 150 + [(i, "x y", "b") for i in range(40)] + [(3, "x y", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sum(len(t.split(" ")) for _, t, s in rows if s == r.source) and r.taken <= 3 * r.size
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.5 and target[s] <= 3 * size[s]
    assert Counter(map(str, out)) == Counter(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_containment_of_items_with_one_opening(spark):
    rng = random.Random(17)
    opening = sentence(rng, 12)
    items = [(i, f"{opening} {sentence(rng, 12)} t{i}") for i in range(25)]
    docs = [(i, f"{sentence(rng, 6)} {t}") for i, t in items] * 2 + [(None, items[3][1])] * 3 + [(99, opening)]
    got = containment.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for d, t in docs:
        for i, u in items:
            s = shingles(u, 5)
            shared = len(s & shingles(t, 5))
            if 10 * shared >= 8 * len(s):
                want.add((d, i, len(s), shared))
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_repeated_rows_and_null_ids_get_one_verdict_each(spark):
    rng = random.Random(23)
    texts = [sentence(rng, 30), "short one", None, "", sentence(rng, 25) + " # # # # # #"]
    rows = [(None if i % 4 == 3 else i, texts[i % 5], "en") for i in range(20)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 4)) for i in range(20)] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    judged = Counter(quality_rules.apply_rules(docs, labels).select("doc_id", "n_words", "base_failed", "kept").collect())
    assert sum(judged.values()) == 40 and all(n % 2 == 0 for n in judged.values())
    scored = Counter(tuple(r) for r in toxicity.score_toxicity(docs, labels).select("doc_id", "score", "predicted").collect())
    assert sum(scored.values()) == 40 and all(n % 2 == 0 for n in scored.values())
    caps = spark.createDataFrame([("http://a.org/x", 5), ("http://a.org/x", 5), (None, 5), (None, 5)], "url string, fetched int")
    events = spark.createDataFrame([("a.org", "add", 1)] * 3, "key string, action string, effective int")
    assert Counter((r.url, r.blocked) for r in url_lists.filter_captures(caps, events).collect()) == {("http://a.org/x", True): 2, (None, False): 2}
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect())
    assert got == Counter((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)


def test_repeats_of_windows_that_differ_in_one_byte(spark):
    """Hundreds of windows with one anchor at every length of it but the last."""
    rng = random.Random(41)
    core = [rng.randrange(97, 123) for _ in range(60)]
    texts = []
    for i in range(240):
        t = list(core)
        t[rng.randrange(60)] = 48 + i % 10
        texts.append(bytes(t).decode() + str(rng.random()) + "".join(map(chr, core[: rng.randrange(20, 60)])))
    texts += texts[:5] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    length = 40
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    want = {}
    for d, t in enumerate(data):
        cover = {j for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1 for j in range(i, i + length)}
        if cover:
            want[d] = cover
    for many in (1, 5, 3000):
        spans = repeats.repeated_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), length, 8, many)
        assert {r.doc_id: {j for s in r.spans for j in range(s.start, s.stop)} for r in spans.collect()} == want


def plain_scores(docs, labels):
    """Scores as ``score_toxicity`` defines them, by comparing each text with every example."""
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    words = {d: re.findall(r"[^\W\d_]+", (t or "").lower()) for d, t in docs}
    known = {d: y for d, y in labels if not held(d)}
    sketch = {d: list(enumerate(toxicity._sketches(words[d]))) for d in known}
    alike = Counter(x for d in known for x in sketch[d])
    w = {d: 1 / max(alike[x] for x in sketch[d]) for d in known}
    total = sum(w.values())
    base = sum(w[d] * y for d, y in known.items()) / total
    n, t = Counter(), Counter()
    for d, y in known.items():
        for x in set(words[d]):
            n[x] += w[d]
            t[x] += w[d] * y
    frequent = [x for x in n if n[x] >= 5]

    def gain(x):
        s = t[x] / n[x]
        return t[x] * math.log(s / base) + ((n[x] - t[x]) * math.log((1 - s) / (1 - base)) if s < 1 else 0) if s > base else 0

    terms = {x for x in frequent if gain(x) > math.log(20 * len(frequent))}

    def vector(d):
        return frozenset((x, 2 ** int(math.log2(c))) for x, c in Counter(words[d]).items() if x in terms)

    def cosine(a, b):
        a, b = ({x: (1 + math.log(c)) * math.log(1 + total / n[x]) for x, c in v} for v in (a, b))
        return sum(a[x] * b.get(x, 0) for x in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    entries = {}
    for d, y in known.items():
        e = entries.setdefault(vector(d), [0, 0])
        e[0], e[1] = e[0] + w[d], e[1] + w[d] * y
    nothing = entries.pop(frozenset(), [0, 0])

    def vote(v, without=None):
        near = sorted(((cosine(v, e), *x) for e, x in entries.items() if e != without), reverse=True) if v else []
        near = [x for x in near if x[0] > 0]
        if not near:
            return None
        sums, floor = 0, 0
        for s, weight, _ in near:
            sums += weight
            if sums >= toxicity.NEIGHBOURS:
                floor = s - 1e-12
                break
        near = [x for x in near if x[0] >= floor]
        mass = sum(s * weight for s, weight, _ in near)
        return (sum(s * y for s, _, y in near) + base * 0.5) / (mass + 0.5)

    seen = sorted((x, *entries[v]) for v in entries if (x := vote(v, v)) is not None)
    ys = [max(min(sum(x[2] for x in seen[j : k + 1]) / sum(x[1] for x in seen[j : k + 1]) for k in range(i, len(seen))) for j in range(i + 1)) for i in range(len(seen))]
    pools = {}
    for (x, weight, y), fitted in zip(seen, ys, strict=True):
        p = pools.setdefault(round(fitted, 9), [0, 0, 0])
        p[0], p[1], p[2] = p[0] + x * weight, p[1] + weight, p[2] + y
    at = [p[0] / p[1] for p in pools.values()]
    up = list(itertools.accumulate(((p[2] + base) / (p[1] + 1) for p in pools.values()), max))

    def score(v):
        x = vote(v)
        if x is None:
            return (nothing[1] + base) / (nothing[0] + 1)
        if x <= at[0] or x >= at[-1]:
            return up[0] if x <= at[0] else up[-1]
        k = next(k for k in range(1, len(at)) if x <= at[k])
        return up[k - 1] + (up[k] - up[k - 1]) * (x - at[k - 1]) / (at[k] - at[k - 1])

    return {d: score(vector(d)) for d, _ in docs}


def test_toxicity_equals_a_comparison_with_every_example(spark):
    rng = random.Random(47)
    rude = ["awful", "horrid", "vile", "nasty"]
    rows = []
    for i in range(500):
        toxic = i % 6 == 0
        extra = [x for x in rude for _ in range(rng.choice([0, 1, 1, 3]))] if toxic and i % 18 else ["vile"] if i % 25 == 0 else []
        rows.append((i, " ".join([sentence(rng, 25), *extra]), int(toxic)))
    rows += [(600 + i, rows[6][1], 1) for i in range(6)] + [(700, None, 0), (701, "", 1)]
    docs = [(d, t) for d, t, _ in rows]
    want = plain_scores(docs, [(d, y) for d, _, y in rows])
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in got.collect()}
    assert len(set(want.values())) > 5 and got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_examples_are_one_text_an_id(spark):
    """An id with a third of all rows is one example."""
    rng = random.Random(53)
    docs = [(i, sentence(rng, 20) + (" awful" if i % 5 == 4 else "")) for i in range(200)] + [(4, sentence(rng, 20) + " awful") for _ in range(100)]
    labels = [(i, int(i % 5 == 4)) for i in range(200)]
    index, none_near = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert list(index.terms) == ["awful"]
    assert abs(index.weight.sum() - sum(i % 5 == 4 for i in known)) < 1e-9


def test_far_copies_of_one_text_make_no_pairs(spark, monkeypatch):
    """Copies of one text that share rare shingles, but are too far from one another,
    are told apart where a list is read: what leaves it does not grow with the square
    of their number. (Before, this made 2,692 pairs of 65 texts.)"""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(150)]

    def edited(ws, k):
        out = list(ws)
        for at in rng.sample(range(3, len(ws) - 3), k):
            out[at] = f"x{rng.randrange(10**9)}"
        return out

    far = [edited(base, 2) for _ in range(60)]
    texts = [" ".join(ws) for ws in [*far, *(edited(far[i], 1) for i in range(5))]]
    sets = [shingles(t, 3) for t in texts]
    want = {i: i for i in range(len(texts))}
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((want[i], want[j]))
                want = {k: x if v == y else v for k, v in want.items()}
    made, counted = [], jaccard_join.materialize_counted

    def spy(df, *measures):
        out = counted(df, *measures)
        if "close" in df.columns:
            made.append(out[0].count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize_counted", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs).collect()} == want
    assert 0 < sum(made) <= 5 * len(texts), made
    # a folded bitmap never tells sets further apart than they are, whatever its width
    wide = [np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(40, 3070, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    rows = spark.createDataFrame([tuple([int(v) for v in jaccard_join._parity(np.sort(s))] for s in wide)], "x array<long>, y array<long>")
    fold = rows.select(jaccard_join._folded(F.col("x")).alias("x"), jaccard_join._folded(F.col("y")).alias("y"))
    ((apart, size),) = fold.select(jaccard_join._folds_apart(F.col("x"), F.col("y")), F.size("x")).collect()
    assert size == jaccard_join.FOLD and 0 < apart <= 110


def test_texts_of_repeated_lines_are_compared_as_sets():
    """Texts of a few repeated lines that are too far apart meet at thousands of places;
    none of these is looked at. The bound loses no pair that has a passage."""
    rng = np.random.default_rng(4)
    for _ in range(100):
        s = rng.integers(0, rng.integers(3, 80), rng.integers(46, 200))
        assert passages.fewest_distinct(s, 46) == min(len(np.unique(s[i : i + 46])) for i in range(len(s) - 45))
    a, b = np.tile(np.arange(30, dtype=np.int32), 40), np.tile(np.concatenate([np.arange(24), np.arange(90, 96)]).astype(np.int32), 40)
    places = [(i, j) for i in range(0, 1200, 30) for j in range(0, 1200, 30)]
    assert not passages.may_be_similar(a, b, 46, 0.8)
    began = time.time()
    assert passages.shared_passages(a, b, places, 46, 0.8) == []
    assert time.time() - began < 0.05
    near = a.copy()
    near[near == 29] = 90
    assert passages.may_be_similar(a, near, 46, 0.8) and passages.shared_passages(a, near, places, 46, 0.8)
    # rows and columns of meets give the same places
    rows = [dict(i=i, first=max(0, i - 45), last=i, j=j, b_first=max(0, j - 45), b_last=j) for i, j in [(30, 60), (33, 63), (5, 5), (3, 4)]]
    columns = {c: np.array([m[c] for m in rows]) for c in passages.MEET}
    got = passages.meeting_places(a, near, rows, 46, 0.8)
    assert got and got == passages.meeting_places(a, near, columns, 46, 0.8)
