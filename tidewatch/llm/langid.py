"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit for each language, so the slots of an n-gram, ANDed, give all
the languages that may contain it. A text's n-grams are counted for each language, each count is corrected for the
language's rate of false positives, and the greatest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, table

SIZES = (3, 5)  # bytes of an n-gram
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SLOT_BITS = 20
#: Labelled documents a language to learn from (about; chosen by hash), the share of them that an n-gram must occur in,
#: and the most n-grams of a language. Only learning is bounded so: every document is predicted from its whole text.
LEARN_DOCS, LEARN_SHARE, LEARN_GRAMS = 3000, 0.02, 40_000
BLOCK = 1 << 20
LETTER = regex.compile(r"\p{L}")
_KEPT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(data: np.ndarray) -> list[np.ndarray]:
    """For each size, the n-grams of a byte array as numbers that carry their size."""
    wide = data.astype(np.uint64)
    out = []
    for n in SIZES:
        g = np.full(max(0, len(data) - n + 1), n, np.uint64)
        for k in range(n):
            g = g << np.uint64(8) | wide[k : k + len(g)]
        out.append(g)
    return out


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode(errors="replace").translate(_KEPT) + b" "


def _slots(g: np.ndarray):
    for h in HASHES:
        yield (g * np.uint64(h) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    filter: np.ndarray  # a mask of languages for each slot
    false_rate: np.ndarray

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language's filter holds."""
        total, held = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        owner, parts, starts_of, size = [], [], [], 0

        def flush():
            nonlocal owner, parts, starts_of, size
            if owner:
                data = np.frombuffer(b"".join(parts), np.uint8)
                begin = np.cumsum([0, *map(len, parts[:-1])])
                for n, g in zip(SIZES, grams(data), strict=True):
                    own = np.array([max(0, min(BLOCK, left - n + 1)) for left in starts_of])  # none reaches into the next part
                    np.add.at(total, owner, own)
                    mask = None
                    for s in _slots(g):
                        mask = self.filter[s] if mask is None else mask & self.filter[s]
                    first, last = np.minimum(begin, len(g)), np.minimum(begin + own, len(g))
                    for k in range(len(self.languages)):
                        sums = np.concatenate([[0], np.cumsum(mask >> self.filter.dtype.type(k) & self.filter.dtype.type(1), dtype=np.int64)])
                        np.add.at(held[:, k], owner, sums[last] - sums[first])
            owner, parts, starts_of, size = [], [], [], 0

        for i, t in enumerate(texts):
            data = _bytes(t)
            for a in range(0, len(data), BLOCK):
                owner.append(i)
                parts.append(data[a : a + BLOCK + max(SIZES) - 1])
                starts_of.append(len(data) - a)
                size += len(parts[-1])
                if size >= BLOCK:
                    flush()
        flush()
        return total, held

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text, whatever other texts are in the batch; `und` and 0 without a letter.

        The score is the winner's share of all corrected counts. Where several languages count alike (as where no n-gram is
        known), the first by name wins.
        """
        total, held = self.hits(texts)
        right = np.maximum(0, (held - total[:, None] * self.false_rate) / (1 - self.false_rate))
        best = right.argmax(axis=1)
        share = right[np.arange(len(texts)), best] / np.maximum(right.sum(axis=1), 1e-9)
        lang, score = [], []
        for t, b, s in zip(texts, best, share, strict=True):
            letter = LETTER.search(t) is not None
            lang.append(self.languages[b] if letter else "und")
            score.append(round(float(min(1.0, s)), 6) if letter else 0.0)
        return lang, score


def fit(train: DataFrame, learn_docs: int = LEARN_DOCS, share: float = LEARN_SHARE, most: int = LEARN_GRAMS) -> Model:
    """Learns from the columns doc_id, text, lang (at most 64 languages, in the order of their names)."""
    train = train.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return Model(["und"], np.zeros(1 << SLOT_BITS, np.uint8), np.zeros(1))
    if len(languages) > 64:
        raise ValueError("a mask holds at most 64 languages")
    rate = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, learn_docs / counts[k])))))
    chosen = train.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))

    def run(batches):
        for b in batches:
            tally: dict[str, list] = {}
            for text, lang in zip(filled(b.column(0)), b.column(1).to_pylist(), strict=True):
                tally.setdefault(lang, []).extend(np.unique(g) for g in grams(np.frombuffer(_bytes(text), np.uint8)))
            for lang, seen in tally.items():
                g, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    tally = chosen.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(share * min(counts[k], learn_docs)))))
    ranked = tally.where(F.col("n") >= least[F.col("lang")]).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    kept = ranked.where(F.col("at") <= most).select("lang", "gram").toPandas()  # at most `most` rows a language
    kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= n)
    slots = np.zeros(1 << SLOT_BITS, kind)
    for k, lang in enumerate(languages):
        for s in _slots(kept.gram[kept.lang == lang].to_numpy(np.int64).astype(np.uint64)):
            slots[np.unique(s)] |= kind(1 << k)
    fill = np.array([(slots >> kind(k) & kind(1)).mean() for k in range(len(languages))])
    return Model(languages, slots, fill ** len(HASHES))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row, repeated ones too; null texts and texts without a letter are `und` with score 0.

    Texts of any length are read whole, in blocks. An empty table gives no rows; other columns of docs are left aside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOT_BITS masks, whatever the corpus

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lang, score = shared.value.predict(filled(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
