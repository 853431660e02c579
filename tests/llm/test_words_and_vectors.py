"""Whitening, quality rules and spelling variants against brute force on small rows."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, SMALL, frame

from tidewatch.llm import quality, variants, whitening
from tidewatch.llm.common import materialise, release, table


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit("k"), "weight": F.lit(2.5), "key": F.lit(None).cast("int"), "n": F.lit(0)})


def check_whitening(rows, given, dims, by_count=True):
    """Every figure of the contract, from the given vectors alone."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in given if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fitted = [x for _, x in good] if by_count else list(map(list, {tuple(x) for _, x in good}))
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    x = np.array(fitted, float)
    d = x - np.array(sums) / n
    cov = d.T @ d / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(32, int((e > 1e-12 * np.trace(cov)).sum()))
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[(r.vec_id, r.component)].append(r)
    assert len(rows) == k * len(good) and {r.n for r in rows} == {n}
    signs = {}
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for c in range(k):
            r = by_id[(i, c + 1)][0]
            want = float((np.array(x, float) - np.array(sums) / n) @ axes[:, c] / math.sqrt(e[c]))
            if abs(want) > 1e-6:
                signs.setdefault(c, np.sign(want) * np.sign(r.whitened))
            assert r.deviation == deviation and abs(r.whitened * signs.get(c, 1) - want) < 1e-6, (i, c)
            assert abs(r.explained - e[c] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-6


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (40, 6)) @ rng.normal(0, 1, (6, 6))
    given = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    given += [(100 + i, given[3][1]) for i in range(60)] + [(3, given[3][1]), (None, given[5][1])]
    given += [(200, None), (201, [None] * 6), (202, [1.0] * 5 + [float("nan")]), (203, [1.0] * 5 + [float("inf")]), (204, [1.0] * 7), (205, [])]
    df = vectors(spark, given).repartition(5)
    check_whitening(whitening.whiten(df).collect(), given, 6)
    check_whitening(whitening.whiten(df, multiplicity=False).collect(), given, 6, by_count=False)
    assert {r.component for r in whitening.whiten(df, most=2).collect()} == {1, 2}
    flat = [(i, [*v[:3], v[0]]) for i, v in given[:40]]  # one direction has no variance
    assert {r.component for r in whitening.whiten(vectors(spark, flat)).collect()} == {1, 2, 3}
    for none in ([], [(1, None)], [(1, [])], [(k, [1.0, 2.0]) for k in range(5)]):
        got = whitening.whiten(vectors(spark, none))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert [(r.component, r.deviation is None) for r in sorted(huge)] == [(1, True), (1, True), (1, False)] and all(math.isfinite(r.whitened) for r in huge)  # beside the first, the other direction is rounding


def test_exact_squares_at_the_edge_of_a_long():
    d = np.array([[3_037_000_499, 0], [3_037_000_500, 0], [2_147_483_648, 2_147_483_648], [1 << 40, 1], [5, -7]], np.int64)
    want = [sum(int(v) ** 2 for v in r) for r in d]
    assert whitening._squares(d) == [w if w < 1 << 63 else None for w in want]
    assert whitening._squares(d.astype(object)) == [w if w < 1 << 63 else None for w in want]


def test_whitening_of_the_table(spark):
    given = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    check_whitening(whitening.op11_whitening(spark, SMALL).collect(), given, 64)


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    marks = {}
    for n in (3, *quality.NGRAMS):
        found = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        marks[n] = {i + k for i in range(len(w) - n + 1) if found[tuple(w[i : i + n])] > 1 for k in range(n)}
    chars = {n: sum(len(w[i]) for i in marks[n]) for n in marks}
    failed = len(w) < 50 or 100 * len(marks[3]) > 50 * len(w)
    bad = any(100 * chars[n] > s * out[1] for n, s in quality.NGRAMS.items()) or 100 * len(again) > quality.LINES * len(lines) or 100 * sum(map(len, again)) > quality.LINE_CHARS * sum(map(len, lines))
    return (*out, len(again), len(marks[3]), failed, not failed and not bad, *(chars[n] for n in quality.NGRAMS), len(lines), sum(map(len, again)))


def test_quality_rules(spark):
    para = " ".join(f"w{k}" for k in range(60))
    odd = [
        (20, para + "\n" + para, "x"), (21, para + "\n" + para[:180], None), (22, "\n".join([para[:90]] + ["a line of five words"] * 9), None), (23, (" \t\n\x0b").join(f"w{k}\x1cz\xa0é" for k in range(70)), None),
        (24, "# * $ % & | < > " * 10, None), (25, "\n".join(f"one two three {k}" for k in range(40)), None), (26, "x " * 30000, None), (27, " ".join(f"w{k % 50000}" for k in range(100_001)), None), (28, "\n \n\n", None), (29, "漢字 é " * 40 + para, None),
    ]
    rows = [*ROWS, *odd]
    got = quality.quality_rules(frame(spark, rows)).collect()
    short = [(i, t) for i, t, _ in rows if i not in (26, 27)]
    assert collections.Counter(tuple(r)[:-1] for r in got if r.doc_id not in (26, 27)) == collections.Counter((i, *brute_quality(t)) for i, t in short)
    by_id = {r.doc_id: r for r in got}
    assert by_id[27].n_repeat_words == 100_001  # the words come again after 50,000
    assert by_id[26].n_repeat_words == 30000 and not by_id[26].kept and by_id[26].base_failed
    assert not by_id[20].kept and "base" in by_id[20].failed_rules
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_windows_of_one_hash_are_told_apart():
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 5, 6, 7, 8], np.int64)
    clash = np.zeros(len(ids) - 2, np.uint64)
    assert quality.repeated(ids, 3, clash).tolist() == [True, False, False, False, True] + [False] * 4
    for n, h in quality.rolling(ids, (3, 5)):
        assert len(h) == len(ids) - n + 1
    assert [len(h) for _, h in quality.rolling(ids[:4], (3, 5, 7))] == [2, 0, 0]


def test_quality_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(quality.SQL)
    names = [c[0] for c in want.description]
    got = quality.op12_quality_rules(spark, SMALL).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_clean_documents_are_kept(spark):
    """Of the documents labelled as good and long enough, nearly all stay; of those that repeat nearly all of their text none does."""
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    found = quality.op12_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where(~F.col("base_failed"))
    share = found.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert dict(map(tuple, share))[1] > 0.99


def brute_variants(docs, letters=6, times=5, more=5, drop=199):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= times and len(w) >= letters}
    less = collections.defaultdict(set)  # by what is left when one letter goes
    for w in words:
        for k in range(len(w)):
            less[w[:k] + "\0" + w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in less.values():
        for a in group:
            near[a] |= group - {a}
    for w in words:
        for k in range(len(w)):
            if (v := w[:k] + w[k + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= more * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    said = ["believe"] * 700 + ["beleive", "belive", "believes"] * 6 + ["beliefe"] * 30 + ["blieve"] * 5 + ["bellieve"] * 130 + ["belllieve"] * 25 + ["bellllieve"] * 5 + ["Élèves"] * 40 + ["élèves"] * 5 + ["élève×"] * 7 + ["straße"] * 60 + ["strasße"] * 9 + ["short"] * 50
    said += ["aaaaaa"] * 5 + ["aaaaaaa"] * 25 + ["aaaaaaaa"] * 125 + ["abcabc", "abcabd", "bbcabc"] * 5 + ["x" * 4000] * 30 + ["x" * 4001] * 5 + ["ccccccd"] * 10 + ["dcccccc"] * 10
    rng = np.random.default_rng(2)
    rng.shuffle(said)
    rows = [(k, " ".join(said[k::12]).replace(" ", ". ") + (" OK\n" if k else ""), "en") for k in range(12)] + [(None, "believe BELIEVE " * 30, None), (40, None, None), (41, "", None), (1, said[0], None), (1, said[0], None)]
    for how in ({}, {"letters": 2, "times": 1, "more": 2, "drop": 7}):
        got = variants.spelling_variants(frame(spark, rows).repartition(4), **how).collect()
        want = brute_variants([r[:2] for r in rows], **how)
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert variants.spelling_variants(frame(spark, [])).count() == 0
    assert max(len(r.word) for r in got) == 4001 and any(r.form and r.root != r.form for r in got)


def test_near_pairs_are_complete(spark):
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(900)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {tuple(sorted((r.word, r.other))) for r in variants.near_pairs(df).collect()}
    less = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    near = lambda a, b: (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (len(a) == len(b) + 1 and b in less(a)) or (len(b) == len(a) + 1 and a in less(b))
    assert got == {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b)}


def test_spelling_variants_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = variants.op13_spelling_variants(spark, SMALL).collect()
    assert len(got) > 100 and set(map(tuple, got)) == brute_variants(docs)


def test_released_tables_are_gone(spark):
    kept = materialise(spark.range(10), "kept")
    gone = materialise(spark.range(10), "gone")
    release(gone)
    assert kept.count() == 10
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        gone.count()
