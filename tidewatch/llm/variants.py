"""Spelling variants of frequent words by asymmetric q-chunks.

Two words are near if one edit (a code point inserted, deleted or replaced) turns one into the other. The longer word (of two
as long, the first in order) is cut into two disjoint chunks; one edit leaves one of them whole, and the other word holds it
as a gram, shifted by one place at most. The half that is edited is cut again, and again one of its chunks is left whole, so
that words meet on about three quarters of their letters: groups stay small however common a beginning or an ending is.
Chunks and grams are joined on a hash, and each pair that meets is verified, so that a collision costs a comparison only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words of at least so many code points and occurrences; how much more frequent a form is; one run in DROP loses a letter.
LETTERS, TIMES, MORE, DROP = 6, 5, 5, 199
#: A task hands on its counts when it holds so many words; bounds its memory, not what is counted.
HELD = 400_000
#: Runs of longer texts are counted one by one, not listed first.
LONG = 1 << 22


def runs(text: str) -> Counter:
    """Occurrences of each run of letters, A-Z lowered."""
    found = Counter(RUN.findall(text) if len(text) < LONG else (m[0] for m in RUN.finditer(text)))
    out: Counter = Counter()
    for w, n in found.items():
        out[w.lower() if w.isascii() else w.translate(LOWER)] += n
    return out


def with_dropped(doc_id, text: str, drop: int = DROP):
    """Words of a text and their occurrences; a run whose hash with the doc_id is a multiple of drop loses a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in runs(text).items():
        h = zlib.crc32(w.encode(), start)
        if h % drop == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        yield w, n


def word_counts(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, drop: int = DROP) -> DataFrame:
    """word, n: the words of at least `letters` code points with at least `times` occurrences in all texts."""

    def run(batches):
        held: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for w, n in with_dropped(doc_id, text.as_py() or "", drop):
                    if len(w) >= letters:
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    part = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _key(of: Column, half: int, sub: int, whole_at, whole_size, sub_at, sub_size) -> Column:
    """A chunk of a word, and the chunk of its other half, with their places in the cutting and the length of the word that is cut."""
    w = F.col("word")
    return F.xxhash64(of, F.lit(2 * half + sub), F.substring(w, whole_at + 1, whole_size), F.substring(w, sub_at + 1, sub_size))


def _cuts(of: Column, shorter: int) -> list[Column]:
    """Keys by which a word is met, as a word that is cut (of: its length) or as one with `shorter` letters less than one of length `of`.

    A chunk keeps its place where the edit is behind it, and stands one place earlier where a letter before it is missing.
    """
    a = F.floor(of / 2).cast("int")  # the first half has a letters
    b = of - a
    out = []
    for half, (at, size) in enumerate(((F.lit(0), a), (a, b))):
        rest_at, rest = ((a, b), (F.lit(0), a))[half]
        x = F.floor(rest / 2).cast("int")
        for sub, (sub_at, sub_size) in enumerate(((rest_at, x), (rest_at + x, rest - x))):
            # the edit is in the other half: behind a first half, before a second one; and in its other part
            late = shorter if half == 1 else 0
            out.append(_key(of, half, sub, at - late, size, sub_at - (shorter if sub == 1 else 0), sub_size))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of near words once, the longer (then the first in order) as word."""
    size = F.length("word")
    cut = words.select(F.explode(F.array(*_cuts(size, 0))).alias("key"), "word", "n")
    same, longer = F.array(*_cuts(size, 0)), F.array(*_cuts(size + 1, 1))
    grams = words.select(F.explode(F.concat(same, longer)).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    w, v = F.length("word"), F.length("other")
    one = (F.levenshtein("word", "other", 1) == 1) & ((w > v) | ((w == v) & (F.col("word") < F.col("other"))))
    return cut.join(grams, "key").where(one).select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: the end of the forms from a word. Each round doubles how far a word has looked."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialise(step, "roots")
        release(now)
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, more: int = MORE, drop: int = DROP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each frequent word of docs (doc_id, text).

    form is the near word of largest n (ties: the first in code-point order) where that is at least `more` times the word's;
    root is where forms lead. A null text has no words; a null doc_id is hashed as nothing before the colon; repeated rows
    count as often as they come; a word of any length is treated alike; other columns are left out. Without words there are no rows.
    """
    words = materialise(word_counts(docs, letters, times, drop), "words")
    pairs = materialise(near_pairs(words), "pairs")
    links = pairs.select("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")).union(pairs.select("other", "word", "n"))
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    big = -F.col("best.less") >= more * F.col("n")
    made = joined.select("word", F.when(big, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, -F.col("best.less")).alias("form_n"))
    made = materialise(made, "forms")
    release(words, pairs)
    ends = roots(made.where("form is not null").select("word", "form"))
    return made.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
