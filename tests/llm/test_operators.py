"""Each operator against brute force on small rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, bwt, exact_dedup, html_text, langid, licenses, media, near_dedup, packing, repeats, sstable
from tidewatch.llm.common import default_tokenizer, library, materialise, scratch, table, token_ids

SMALL = "/root/testdata/sf0.001"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards boil dark green soup for forty hungry guests tonight"
ROWS = [
    (1, BASE, "en"), (2, BASE, None), (3, BASE.replace("seven", "eight"), "en"), (4, None, "en"), (5, "", None), (6, " \n\t", "de"), (7, "word", "en"),
    (8, "licensed under CC BY-NC 4.0. All rights reserved. all rights\nreserved", "en"), (9, "éèê ça où — “quoted” \x85 \x1c <|endoftext|> 漢字 \U0001f600 aaaaaaaaaaaaaaaaaaaa %%%%%%%", "fr"),
    (10, ("ab cd " * 6000) + BASE, "en"), (11, BASE + " " + "x" * 3000, "en"), (11, BASE + " " + "x" * 3000, "en"), (None, BASE, "en"), (12, "1234 5678", None), (13, "The  Quick\tbrown", "en"), (14, "The Quick brown", "en"), (15, "½² ³¾", None), (16, "x²y½ ÀÉ ɏ\xa0\xa0z 'll 'LL !'s  \n", None),
]


def frame(spark, rows=ROWS):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return made.withColumns({"start": F.lit(1), "key": F.lit("k"), "rep": F.lit(0), "length": F.lit(2), "batch": F.lit("b")})


def ids_of(text):
    return library(default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_token_ids_equal_the_library():
    texts = [t or "" for _, t, _ in ROWS] + ["'s 'LL don't  x\r\n\n y z­", "A" * 2000 + " b" * 50]
    assert [x.tolist() for x in token_ids(texts, default_tokenizer())] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("ranked", [2, 100_000])
def test_packing(spark, ranked):
    rows = packing.place(materialise(packing.pieces(frame(spark), default_tokenizer()), "pieces"), ranked=ranked).collect()
    seqs, by_doc = collections.defaultdict(list), collections.defaultdict(int)
    texts = {i: t for i, t, _ in ROWS}
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
        ids = np.array(ids_of(texts[r.doc_id]) + [0], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert len(ids) > 2048 or r.length == len(ids)
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    want = collections.Counter()
    for i, t, _ in ROWS:
        want[i] += len(ids_of(t)) + 1
    assert by_doc == want
    assert packing.pack(frame(spark, [])).count() == 0


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(0)
    for _ in range(50):
        counts = {int(x): int(rng.integers(1, 3)) for x in rng.integers(3, 40, 5)}
        sums = {0}
        for x, c in counts.items():
            sums = {s + x * k for s in sums for k in range(c + 1)}
        room = int(rng.integers(5, 100))
        got = packing.fullest(counts, room)
        assert all(c <= counts[x] for x, c in got.items())
        assert sum(x * c for x, c in got.items()) == max(s for s in sums if s <= room)


def test_shards(spark):
    path = scratch(spark, "t")
    rows = sstable.token_shards(frame(spark), path).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t, _) in zip(rows, order, strict=True):
        ids = np.array(ids_of(t) + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for size in (64 << 10, 500):
        w = sstable.Writer(size)
        for i in range(0, 4000, 2):
            w.add(sstable.key_of(i), np.array([i, 70000, i + 1], np.uint32))
        reader = sstable.Reader(w.done())
        assert reader.documents == 2000 and (len(reader.index) == 1 if size > 60_000 else len(reader.index) > 50)
        assert all(reader.lookup(i).tolist() == [i, 70000, i + 1] for i in range(0, 4000, 2))
        assert all(reader.lookup(i) is None for i in (-1, *range(1, 4001, 2)))
    path = scratch(spark, "t")
    small = sstable.token_shards(frame(spark), path, shards=2, shard_bytes=60, block_bytes=40).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in small] == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows]
    assert len({r.shard for r in small}) > 3
    assert sstable.token_shards(frame(spark, []), scratch(spark, "t")).count() == 0


def test_bpe(spark):
    got = bpe.encode_decode(frame(spark)).collect()
    want = collections.Counter((i, len(x := ids_of(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library(default_tokenizer()).decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t, _ in ROWS)
    assert collections.Counter(map(tuple, got)) == want
    auto = bpe.automaton(default_tokenizer())
    rng = np.random.default_rng(1)
    for _ in range(300):
        word = "".join(rng.choice(list("abcehlorstnéx% &"), rng.integers(1, 14)))
        pieces = [p for p in [word.replace(" ", "")] if p]
        for p in pieces:
            if len(bpe.Codec(default_tokenizer())._pieces(p)) == 1:
                assert auto.encode(p.encode()) == ids_of(p)
                assert auto.decode(auto.encode(p.encode())) == p
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_automaton_has_the_arcs_of_correct_tokenizations():
    """A state has an arc just if the two tokens are how their bytes are tokenized."""
    auto, rng = bpe.automaton(default_tokenizer()), np.random.default_rng(4)
    tokens = [t for t in auto.ids if t.isalpha() and t.isascii() and auto.ids[t] not in auto.useless]
    often = [t for t in tokens if len(t) < 4]
    seen = collections.Counter()
    for k in range(6000):
        u, v = (tokens if k % 3 else often)[int(rng.integers(len(tokens if k % 3 else often)))], often[int(rng.integers(len(often)))]
        correct = ids_of((u + v).decode()) == [auto.ids[u], auto.ids[v]]
        assert auto.has(auto.ids[u], auto.ids[v]) == correct, (u, v)
        seen[correct] += 1
    assert min(seen.values()) > 100


def test_other_tokenizer_files_are_left_to_the_library(tmp_path):
    import json

    spec = json.load(open(default_tokenizer(), encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}
    path = str(tmp_path / "digits.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    texts = ["in 2024 we had 1234567 of them", "a b  c", "x1y22 <|endoftext|> 333"]
    want = [library(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] != ids_of(texts[0])
    assert [x.tolist() for x in token_ids(texts, path)] == want
    codec = bpe.Codec(path)
    assert [",".join(p[0] for p in codec.parts(t)) for t in texts] == [",".join(map(str, x)) for x in want]


def test_language(spark):
    docs = table(spark, SMALL, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    out = [(r.lang, got[r.doc_id].lang_pred) for r in docs.where(langid.held_out() & F.col("lang").isNotNull()).collect()]
    assert np.mean([a == b for a, b in out]) > 0.95
    odd = langid.identify(frame(spark), model).collect()
    assert len(odd) == len(ROWS)
    assert {r.lang_pred for r in odd if r.doc_id in (4, 5, 6, 12, 15)} == {"und"}
    assert langid.fit(frame(spark, [])).languages == ["und"]
    assert langid.identify(frame(spark, []), model).count() == 0
    long = "la casa de mi madre es muy grande y bonita " * 60_000  # several blocks
    texts = [t or "" for _, t, _ in ROWS] + ["ab", "zzz zzz", "the the", long] + [r.text or "" for r in docs.limit(60).collect()]
    lang, score = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert lang == [a[0][0] for a in alone] and score == [a[1][0] for a in alone]
    total, held = model.hits([long])
    want = 0
    for n, g in zip(langid.SIZES, langid.grams(np.frombuffer(langid._bytes(long), np.uint8)), strict=True):
        want += len(g)
        assert len(g) == len(langid._bytes(long)) - n + 1
    assert total[0] == want and (held[0] <= want).all()


def test_licenses(spark):
    got = collections.defaultdict(list)
    for r in licenses.scan(frame(spark)).collect():
        got[r.doc_id].append(r)
    for i, t, _ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, x) for p, x in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i][0]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert got[8][0].labels == "cc-by,cc-by-nc,reserved"
    assert licenses.scan(frame(spark, [])).count() == 0


def test_short_references_to_licences(spark):
    says = {
        "# SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "code is under the Apache License 2.0.": "apache-2.0",
        "see the Apache License, Version 2.0": "apache-2.0", "licensed under GNU GPL v3": "gpl-3.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "(GPLv2 only)": "gpl-2.0",
        "http://creativecommons.org/publicdomain/zero/1.0/": "cc0", "the words creativecommons org licenses alone": "", "SPDX-License-Identifier: none": "", "v3 of the GNU tools, MIT people, license 2.0": "", "https://creativecommons.org/licenses/by/3.0/": "cc-by-url",
    }
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(k, t, None) for k, t in enumerate(says)])).collect()}
    assert {t: got[k].labels for k, t in enumerate(says)} == says
    assert all(r.n_base == 0 and r.base_labels == "" and (r.score == 1) == bool(r.labels) for r in got.values())
    for text, label in licenses.references():
        found = licenses.Index(licenses.templates(), {}, 1).scan(licenses.words_of(f"some {text} more"))
        assert label in found[2] and found[3] == 1, text


def test_a_long_text_with_many_licence_words(spark):
    part = "all rights reserved under cc by and the general public license "
    text = part * 1500 + "plain words follow " * 40_000 + part
    r = licenses.scan(frame(spark, [(1, text, None)])).first()
    words = text.split()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), 3 * 1501, 0, len(words) - 3)
    assert set(r.base_labels.split(",")) == {"cc-by", "gpl", "reserved"} <= set(r.labels.split(","))


def test_whole_licences_with_departures(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k, (text, label, phrases) in enumerate(licenses.TEXTS):
        words, kept = text.split(), {i for p in phrases for i in range(*(lambda a: (a, a + len(p.split())))(next(i for i in range(len(text.split())) if text.split()[i : i + len(p.split())] == p.split())))}
        changed = [w if i in kept or rng.random() > 0.05 else "changed" for i, w in enumerate(words)]
        cut = len(words) // 2 + next(i for i in range(len(words)) if len(words) // 2 + i not in kept and len(words) // 2 + i + 1 not in kept)
        long = changed[:cut] + ["put", "in", "here"] + changed[cut:]
        rows += [(10 * k, f"Head of it.\n{' '.join(words).upper()}. Tail", None), (10 * k + 1, "a b c " * 50 + " ".join(long), None), (10 * k + 2, " ".join(reversed(words)), None)]
        want |= {10 * k: label, 10 * k + 1: label}
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(label in got[i].labels.split(",") for i, label in want.items())
    assert all(got[i].score == 1 for i in want if i % 10 == 0)
    assert not any(got[10 * k + 2].labels for k in range(len(licenses.TEXTS)))


def test_media(spark):
    path = scratch(spark, "m")
    rows = media.media_columns(frame(spark), path).collect()
    want = collections.Counter((i, len((t or "").encode()), hashlib.sha256(media.payload_of(t or "")).hexdigest()) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in rows) == want
    stored = {(r.doc_id, r.offset): r.media for r in spark.read.format("media_archives").option("path", path).load().collect()}
    by_sum = {hashlib.sha256(m).hexdigest(): m for m in stored.values()}
    texts = {i: t or "" for i, t, _ in ROWS}
    for r in rows:
        payload, m = media.payload_of(texts[r.doc_id]), by_sum[r.media_sha256]
        x = np.frombuffer(payload, np.uint8)
        step, quarters = np.abs(np.diff(x.astype(int))).mean(), [((x >= a) & (x < a + 64)).mean() for a in range(0, 256, 64)]
        assert r.payload_bytes == len(payload) and r.media_bytes == len(m) and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.feature == f"mean={x.mean():.3f};std={x.std():.3f};step={step:.3f};quarters=" + "/".join(f"{q:.4f}" for q in quarters)
    small = spark.read.format("media_archives").option("path", path).option("range_bytes", 150).load()
    assert {(r.doc_id, r.offset): r.media for r in small.collect()} == stored and max(map(len, stored.values())) > 150  # members longer than a range
    import glob

    places = sorted(i.header_offset for f in glob.glob(f"{path.removeprefix('file://')}/media-*.zip") for i in media.zipfile.ZipFile(f).infolist())
    assert sorted(o for _, o in stored) == places
    assert all(r.payload_bytes % 192 == 0 and r.payload_bytes for r in rows)
    assert len({r.media_sha256 for r in rows if r.doc_id in (4, 5)}) == 1
    assert media.media_columns(frame(spark, []), scratch(spark, "m")).count() == 0


def test_media_member_is_tried_again(tmp_path, spark):
    path = f"file://{tmp_path}/m"
    media.write_archives(frame(spark), path)
    reader = media.MediaReader({"path": path, "tries": "3"})
    part = reader.partitions()[0]
    store, _ = media.fs.FileSystem.from_uri(path)
    with store.open_input_file(part.file) as f:
        m = media.zipfile.ZipFile(f).infolist()[0]

    class Flaky:
        left = 2

        def open_input_file(self, file):
            if self.left:
                self.left -= 1
                raise OSError("lost")
            return store.open_input_file(file)

    assert media.from_png(reader.member(Flaky(), part.file, m)).size % 192 == 0
    Flaky.left = 9
    with pytest.raises(OSError):
        reader.member(Flaky(), part.file, m)


def test_exact_dedup(spark):
    docs = frame(spark)
    rows = exact_dedup.DigestIndex(spark).ingest(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append(i)
    want = collections.Counter((i, min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    index = exact_dedup.DigestIndex(spark)
    index.ingest(docs.where("doc_id < 5"))
    later = {r.doc_id: r for r in index.ingest(docs.where("doc_id >= 5 or doc_id is null")).collect()}
    assert later[None].keep_id == 1 and not later[None].kept and later[7].kept and later[5].keep_id == 4
    assert index.table().count() == index.table().select("digest").distinct().count()
    assert exact_dedup.DigestIndex(spark).ingest(frame(spark, [])).count() == 0


def shingle_set(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        hits = collections.Counter(j for g in s for j in held[g])
        for j, n in hits.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    rng = np.random.default_rng(3)
    words = BASE.split() * 3
    for k in range(60):  # a chain of copies, each changed a little more
        words = list(words)
        words[int(rng.integers(len(words)))] = f"w{k}"
        docs.append((10_000 + k, " ".join(words)))
    want = brute_components(docs)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    # one template, whose rows are alike but not linked, save for some that are
    made = []
    for k in range(400):
        t = [f"t{i}" for i in range(120)]
        for i in rng.choice(120, 4, replace=False):
            t[i] = f"v{rng.integers(9)}" if k % 3 else f"u{k}x{i}"
        made.append((20_000 + k, " ".join(t if k % 5 else [*made[int(rng.integers(k))][1].split()[:118], "end", f"e{k}"] if k else t)))
    for how in ({"short_list": 3, "block_bytes": 20_000}, {"short_list": 20, "block_bytes": 300_000}):
        want = brute_components(docs + made)
        got = near_dedup.near_duplicates(spark.createDataFrame(docs + made, "doc_id long, text string").repartition(5), **how).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({want[i][1] for i, _ in made}) > 20
    odd = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark)).collect()}
    assert odd[2].component_id == 1 and not odd[2].kept and odd[4].component_id == 4 and odd[4].n_shingles == 0 and odd[14].component_id == 13
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("size, how", [(1 << 20, {}), (3000, {"home_bytes": 2000}), (3000, {"hot_batches": 1}), (1 << 20, {"crowded": 2})])
def test_repeats(spark, size, how):
    rows = [(i, t) for i, t, _ in ROWS if i not in (None, 11)]
    docs = table(spark, SMALL, "documents").where("doc_id between 20 and 120").collect()
    rows += [(r.doc_id, r.text) for r in docs] + [(900 + k, f"{k} start " + BASE[k : 60 + k] * 2 + f" end {k}") for k in range(30)]
    want = brute_repeats([(i, (t or "").encode()) for i, t in rows])
    made = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch_bytes=size, **how)
    assert {r.doc_id: tuple(r)[1:] for r in made.collect()} == want


def test_repeats_odd_rows(spark):
    got = [r for r in repeats.remove_repeats(frame(spark), text_too=True).collect()]
    assert len(got) == len(ROWS)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert all(r.n_removed == len(BASE) for r in got if r.doc_id == 2)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_of_common_passages_and_periods(spark, monkeypatch):
    """A passage in 600 batches makes no rows of strings, and a text with a period as many as it has different strings, those at its ends included."""
    rng = np.random.default_rng(3)
    words = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, line, seen = words(300), words(59) + " ", []
    by_string = repeats._by_string

    def counted(handed):
        seen.append(handed.select(F.sum(F.length("spans")) / 32).first()[0] or 0)
        return by_string(handed)

    monkeypatch.setattr(repeats, "_by_string", counted)
    common = [(i, words(40 + i % 50) + passage[i % 7 :] + words(30)) for i in range(600)]
    periods = [(1000 + i, words(20 + i) + line * 200 + words(20)) for i in range(3)]
    for rows, size, most in ((common, 300, 0), (periods, 1000, 3 * (60 + 2 * 26))):
        made = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), batch_bytes=size)
        assert {r.doc_id: tuple(r)[1:] for r in made.collect()} == brute_repeats([(i, t.encode()) for i, t in rows])
        assert seen[-1] <= most


@pytest.mark.parametrize("zeros", [0, 32])
def test_anchors_reach_every_string(monkeypatch, zeros):
    """Each string lies within the extent of an anchor in it, also where the halves of hashes that decide are 0 or equal."""
    whole = repeats.Hashes.all
    monkeypatch.setattr(repeats.Hashes, "all", lambda self, n: whole(self, n) >> np.uint64(zeros))
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(97, 123, 3000), np.resize(rng.integers(97, 123, 31), 500), np.full(200, 97), rng.integers(97, 99, 400)]).astype(np.uint8)
    ends = np.array([30, 80, 1000, 1049, 2000, 3900, 4100])
    at, gram, doc, least = repeats.anchors(text, ends, repeats.Hashes(text))
    start, stop = repeats._extent(at, gram, least)
    begins = np.concatenate([[0], ends[:-1]])
    assert (begins[doc] <= start).all() and (stop <= ends[doc]).all() and (start <= at).all() and (at + 24 <= stop).all() and (stop - start >= 50).all()
    reached = np.zeros(len(text) + 1, int)
    np.add.at(reached, start, 1)
    np.add.at(reached, stop - 49, -1)
    strings = np.concatenate([np.arange(a, z - 49) for a, z in zip(begins, ends, strict=True)])
    assert (np.flatnonzero(np.cumsum(reached[:-1])) == strings).all()


@pytest.mark.parametrize("at_once", [1, 60, 75, 1000, 1 << 20])
def test_hashes_made_again_in_buckets(monkeypatch, at_once):
    """A place's text gives the hashes that its batch had, wherever the texts are cut."""
    monkeypatch.setattr(repeats, "HASHED_BYTES", at_once)
    rng = np.random.default_rng(8)
    text = rng.integers(0, 256, 5000).astype(np.uint8)
    start, left, length = rng.integers(0, 4900, 40), rng.integers(0, 27, 40), rng.integers(50, 77, 40)
    hashes = repeats.Hashes(text)
    gram, around = repeats._hashed(np.concatenate([text[a : a + n] for a, n in zip(start, length, strict=True)]), np.cumsum(length) - length, length, left)
    assert (gram.view(np.uint64) == hashes.of(start + left, start + left + 24)).all()
    assert (around.view(np.uint64) == repeats._around(hashes, start, start + length, start + left)).all()


def test_batch_takes_no_longer_for_more_buckets():
    """What the buckets say of a batch's anchors is dealt back in one go: 20,000 buckets take about the time of 20."""
    import pandas as pd
    import pyarrow as pa

    text = np.random.default_rng(6).integers(97, 123, 2_000_000).astype(np.uint8)
    text[-9_000:-4_000] = text[:5_000]  # the second document has 5,000 bytes of the first
    row = {"batch": 7, "ids": np.array([3, 5]).tobytes(), "ends": np.array([1_900_000, 2_000_000]).tobytes(), "text": text.tobytes()}
    handed = lambda **more: iter([pa.RecordBatch.from_pylist([row | more])])
    seconds, spans = {}, {}
    for buckets in (20, 20_000):
        posts = pd.concat([b.to_pandas() for b in repeats._post_hashes(buckets, 64)(handed())])
        answers = pd.concat([repeats._shared(x, 100) for _, x in posts.groupby("bucket")]).drop(columns="batch").to_dict("records")
        took = []
        for _ in range(2):
            rows = handed(parts=answers)
            began = time.process_time()
            made = pa.Table.from_batches(repeats._surroundings(buckets)(rows)).to_pylist()
            took.append(time.process_time() - began)
        seconds[buckets] = min(took)
        spans[buckets] = [np.frombuffer(r["data"], np.int64).tolist() for r in made if r["kind"] == 0]
    ((first, last),) = np.reshape(spans[20], (-1, 2)).tolist()  # the ends are for the buckets to decide
    assert spans[20] == spans[20_000] and 1_991_000 <= first < 1_991_050 and 1_995_950 < last <= 1_996_000
    assert seconds[20_000] < 3 * seconds[20] + 0.2, seconds


def test_merged_transforms_equal_one_sort():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 100, 4000).astype(np.uint8)
    start, length = np.arange(0, 3900, 13), np.full(300, 60)
    whole = bwt.build(text, start, length, np.arange(300))
    merged = bwt.merge(bwt.merge(bwt.build(text, start[:90], length[:90], np.arange(90)), bwt.build(text, start[90:200], length[90:200], np.arange(90, 200))), bwt.build(text, start[200:], length[200:], np.arange(200, 300)))
    word = lambda t, k: text[start[t.string[k]] + t.offset[k] : start[t.string[k]] + 60].tobytes()
    words = [word(merged, k) for k in range(len(merged.string))]
    assert words == sorted(words) == [word(whole, k) for k in range(len(words))]
    shared = [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:], strict=False)]
    assert merged.common[1:].tolist() == shared
    string, offset, interval = bwt.repeated(text, start, length, 8, shard=1000)
    found = {}
    for s, o, k in zip(string, offset, interval, strict=True):
        found.setdefault(int(k), set()).add(text[start[s] + o : start[s] + o + 8].tobytes())
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == len(found)
    assert len(string) == 300 * 53 and len(bwt.repeated(text, start[:1], length[:1], 8)[0]) == 53


def test_main_text(spark):
    pages = [(1, "u", "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1><p>Some long text, with\n a break &amp; more of it to read here.<p>Second one<script>var x='<p>no</p>'</script> goes on and on.</article><footer>&copy; me</footer></body></html>"), (2, "u", None), (3, None, ""), (4, "u", "<p"), (1, "u", "<!-- open")]
    made = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    field = html_text.learn()
    got = html_text.extract(made, field).collect()
    assert len(got) == 5
    first = next(r for r in got if r.page_id == 1 and r.text)
    assert first.text == "Title\n\nSome long text, with a break & more of it to read here.\n\nSecond one goes on and on."
    assert first.n_chars == len(first.text)
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))
    for page in html_text.PAGES:
        found, labels = html_text.labelled(page)
        assert field.decode(found) == labels


def test_unclosed_elements_hide_no_more_than_their_own():
    cut = lambda page: [b.text for b in html_text.blocks(page)]
    assert cut("<html><head><title>T</title><style>p {}</style><meta charset=utf-8><body><article><p>Story</p></article></body></html>") == ["Story"]
    assert cut("<head><title>T</title><p>Story") == ["Story"]
    assert cut("<html><head><title>T</title><script>'<p>no</p>'</script></head><body><p>Story</p></body></html>") == ["Story"]
    for e in ("button", "svg", "select", "video", "audio", "canvas", "template"):
        assert cut(f"<body><div><{e}>gone</div><p>Story</p></body>") == ["Story"]
        assert cut(f"<body><{e}>gone<article><p>Story</p></article></body>") == ["Story"]
        assert cut(f"<div><{e}>gone<p>Story</p></div>and <{e}>gone</{e}>more") == ["Story", "and more"]
        assert cut(f"<p>One <span><{e}>gone</span> more</p>") == ["One more"]
        assert cut(f"<p>One<{e}><div>gone</div></{e}> more</p>") == ["One more"]
    assert cut("<p>a <svg><svg>no</svg><text>no</text></svg><template><script>'</template>'</script>no</template>b</p>") == ["a b"]
    assert cut("<p>a<button>no<button>no</button>b") == ["ab"]
    assert cut("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>") == ["Let x=2 be."]


def main_text(page, field=None):
    found = html_text.blocks(page)
    return [b.text for b, y in zip(found, (field or html_text.learn()).decode([b.features for b in found]), strict=True) if y]


def test_main_text_of_the_table(spark):
    rows = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    got = {r.page_id: r.text for r in html_text.op8_main_text(spark, SMALL).collect()}
    right = 0
    for k, page in rows.items():  # these pages keep all of an article in one element
        body = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
        parts = re.split(r"</?(?:p|h[1-6]|li|ul|div)\b[^>]*>", body[1] if body else "")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in parts]
        right += got[k] == "\n\n".join(x for x in parts if x)
    assert right >= 0.99 * len(rows)
    assert html_text.extract(table(spark, SMALL, "pages").limit(0)).count() == 0


TALE = "On the third day the boats came back with less fish than anyone could remember, and the harbour fell quiet."
#: Pages of layouts that no composed page has, with their main text, by hand.
HELD_OUT = [
    (f"<article><p>{TALE}</p><p>{TALE}</p><form><p>Sign up now</p></form></article>", [TALE, TALE]),
    (f"<body class='has-sidebar'><article><p>{TALE}</p></article></body>", [TALE]),
    (f"<body class='logged-in login'><article><p>{TALE}</p></article></body>", [TALE]),
    (f"<main class='read-more'><p>{TALE}</p></main>", [TALE]),
    (f"<body id=top class='page-with-comments widget-area'><div class=site><nav class=site-nav><a href=/>Home</a> <a href=/b>Boats</a></nav><main id=primary><h1>Less fish</h1><p>{TALE}</p><p>Nobody spoke.</p></main></div></body>", ["Less fish", TALE, "Nobody spoke."]),
    (f"<div id=container><div id=topmenu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=mainContent><h1>Less fish</h1><div class=byline-box><form action=/x><p>Get our letter</p></form></div><p>{TALE}<p>{TALE}</div><div id=rightsidebar><p>Read next: ten more tales</p></div></div>", ["Less fish", TALE, TALE]),
    (f"<form id=Form1><div class=header><a href=/>Portal</a></div><div><h1>Less fish</h1><p>{TALE}</p><ul><li>Cod: few.</li><li>Eel: none.</li></ul></div><div class=footer><p>Terms of use</p></div></form>", ["Less fish", TALE, "Cod: few.", "Eel: none."]),
    (f"<header class=masthead><h1>The Harbour Post</h1></header><div class=post><h2>Less fish</h2><p>{TALE}</p><p>{TALE}</p></div><aside class=widget><p>Tides today</p></aside><footer><p>© Harbour Post</p></footer>", ["Less fish", TALE, TALE]),
    (f"<table><tr><td class=menu><p><a href=/>Start</a></p><p><a href=/l>List</a></p></td><td><h1>Less fish</h1><p>{TALE}</p><table><tr><td>Cod</td><td>12</td></tr></table></td></tr></table>", ["Less fish", TALE, "Cod", "12"]),
    (f"<article class=post><header><h1>Less fish</h1></header><p>{TALE}</p><div class='social share'><p><a href=#>Tell a friend</a></p></div><p>{TALE}</p><section id=comments class=comments><h3>Two replies</h3><div class=comment><p>{TALE} I was there and saw it all myself.</p></div><div class=comment><p>So was I, and it was worse than that by far.</p></div></section></article>", ["Less fish", TALE, TALE]),
    (f"<article><h1>Less fish</h1><p>{TALE}</p></article><div id=disqus_thread class=disqus>{f'<div class=comment><p>{TALE} {TALE} {TALE}</p></div>' * 8}</div>", ["Less fish", TALE]),
    (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Less fish</h1><figure><img src=f.png><figcaption>Boats at rest</figcaption></figure><p>{TALE}</p><blockquote><p>We waited.</p></blockquote><pre>cod = 12</pre></article><section class=related><article><h3>More tales</h3><p>Another day at sea, told by those who stayed.</p></article></section>", ["Less fish", "Boats at rest", TALE, "We waited.", "cod = 12"]),
    (f"<div class=cookie-consent><p>This site keeps cookies for the reasons that our long text on cookies tells.</p></div><div class=advertisement><p>Buy nets at Nelly's, the best nets on the coast.</p></div><main><h1>Less fish</h1><p>{TALE}</p><div class=ad-slot>Buy ropes at Nelly's, too.</div><p>{TALE}</p></main>", ["Less fish", TALE, TALE]),
    (f"<p>{TALE}</p><p>{TALE}</p>", [TALE, TALE]),
    ("<nav><ul><li><a href=/>Home</a></li><li><a href=/a>All</a></li></ul></nav><footer><p>© Nobody</p></footer>", []),
]


def test_main_text_of_layouts_that_were_not_learned():
    for page, want in HELD_OUT:
        assert main_text(page) == want, page


def test_the_field_and_the_markup_differ():
    """A rule of the markup alone (in an article or main, in nothing that goes beside) fails on these pages; the field doesn't."""

    def rule(page):
        inside = re.search(r"<(article|main)\b[^>]*>(.*)</\1>", page, re.S)
        return [b.text for b in html_text.blocks(page) if inside and b.text in re.sub(r"<[^>]*>", " ", inside[2]) and not b.names]

    differ = [page for page, want in HELD_OUT if rule(page) != want]
    assert len(differ) >= 5 and all(main_text(p) == w for p, w in HELD_OUT if p in differ)


def test_composed_pages_of_another_seed():
    composer, wrong, n = html_text._Composer(7), 0, 0
    for _ in range(150):
        found, labels = html_text.labelled(composer.page())
        wrong += sum(a != b for a, b in zip(html_text.learn().decode(found), labels, strict=True))
        n += len(labels)
    assert n > 2000 and wrong < 0.01 * n


def test_time_grows_with_the_page():
    for unit in ("<p><svg>", "<div>x", "<div class=ad>y", "<button>z", "<b>x", "<li>q", "<select><p>", "</div>", "<script>", "<!--x", '<a "x'):
        took = []
        for size in (60_000, 480_000):
            began = time.process_time()
            html_text.blocks(unit * (size // len(unit)) + "</svg>")
            took.append(time.process_time() - began)
        assert took[1] < 16 * took[0] + 0.5 and took[1] < 4, unit
    long = f"<article><h1>Less fish</h1>{f'<p>{TALE}</p>' * 20_000}</article>"
    assert len(main_text(long)) == 20_001


def test_names_are_of_class_id_and_role_alone():
    of = lambda page: [(b.text, b.names) for b in html_text.blocks(page)]
    assert of("<article data-id='comment-3' aria-role=menu><p>Story</p></article>") == [("Story", frozenset())]
    assert of("<article><p>Story</p><div ID=comment-3><p>Reply</p></div></article>") == [("Story", frozenset()), ("Reply", frozenset({"comment"}))]
    assert of("<div ID=comment-3><p>Reply</p></div>") == [("Reply", frozenset())]  # holds all of the page
    assert [b.text for b in html_text.blocks("<article><object data=x><p>Instead</p></object><p>Story</p></article>")] == ["Instead", "Story"]


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(exact_dedup.SQL).fetchall())
    assert sorted(tuple(r) for r in exact_dedup.op6_exact_dedup(spark, SMALL).collect()) == want
