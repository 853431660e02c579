"""Quality rules of repetition: how much of a text lies in n-grams and lines that come again.

Words become numbers, and the hashes of n-grams of several lengths roll over them in numpy: the hash of n + 1 words is that
of n words times a constant plus the next word. Equal hashes are compared word by word, so coverage is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: A text fails by its n-grams where more than `share` percent of its words' characters lie in n-grams of that length found twice or more.
NGRAMS = {5: 30, 7: 28, 10: 25}
#: A text fails by its lines where equal ones before them hold more than so many percent of its lines, or of its characters.
LINES, LINE_CHARS = 40, 20
#: The base rules: fewest words, the n-gram, and the most percent of words in repeated ones.
FEWEST, BASE_NGRAM, BASE_SHARE = 50, 3, 50
SYMBOLS, SPACES = "[#*$%&|<>]"[1:-1], " \t\n\v\f\r"
_STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd constant


def rolling(ids: np.ndarray, lengths: tuple[int, ...]):
    """(n, hashes of all windows of n words) for each length, each rolled on from the one before."""
    plain = ids.astype(np.uint64)
    h, at = plain, 1
    for n in sorted(lengths):
        while at < n and len(h) > 1:
            h = h[:-1] * _STEP + plain[at:]
            at += 1
        yield n, h if at == n else h[:0]


def repeated(ids: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    """Which windows of n words are found twice or more. Windows of one hash that differ are told apart by their words."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    if not same.any():
        return out
    left, right = order[:-1][same], order[1:][same]
    if all(np.array_equal(ids[left + k], ids[right + k]) for k in range(n)):
        out[left] = out[right] = True
        return out
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)  # two windows share a hash by chance
    some = np.unique(np.concatenate([left, right]))
    _, group, count = np.unique(windows[some], axis=0, return_inverse=True, return_counts=True)
    out[some] = count[group.ravel()] > 1
    return out


def covered(windows: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in one of the marked windows."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(windows)
    edge[at] += 1
    edge[at + n] -= 1  # each window starts elsewhere
    return edge.cumsum()[:-1] > 0


def measure(text: str, ngrams: dict[int, int] = NGRAMS) -> dict:
    """All measures of a text, and the verdict of the rules."""
    raw = text.encode().split()  # by ASCII white space
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in raw), np.int64, len(raw))
    chars = len(text) - sum(map(text.count, SPACES))
    lengths = None
    out = {"n_words": len(raw), "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_repeat_words": 0} | {f"chars_{n}": 0 for n in ngrams}
    for n, hashes in rolling(ids, (BASE_NGRAM, *ngrams)) if len(seen) < len(raw) else ():
        found = repeated(ids, n, hashes)
        if not found.any():
            break  # no longer one comes twice either
        words = covered(found, n, len(ids))
        if n == BASE_NGRAM:
            out["n_repeat_words"] = int(words.sum())
        if n in ngrams:
            if lengths is None:
                lengths = np.fromiter(map(len, raw) if text.isascii() else (len(w.decode()) for w in raw), np.int64, len(raw))
            out[f"chars_{n}"] = int(lengths[words].sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    again = len(lines) - len(set(lines))
    before: set[str] = set()
    dup_chars = sum(len(x) for x in lines if x in before or before.add(x)) if again else 0
    out |= {"n_lines": len(lines), "n_dup_lines": again, "dup_line_chars": dup_chars, "line_chars": sum(map(len, lines)) if again else len(text)}
    failed = out["n_words"] < FEWEST or 100 * out["n_repeat_words"] > BASE_SHARE * out["n_words"]
    bad = [f"{n}-grams" for n, share in ngrams.items() if 100 * out[f"chars_{n}"] > share * chars]
    bad += ["lines"] * (100 * again > LINES * len(lines)) + ["line characters"] * (100 * dup_chars > LINE_CHARS * out["line_chars"])
    return out | {"base_failed": failed, "kept": not failed and not bad, "failed_rules": ", ".join(["base"] * failed + bad)}


def quality_rules(docs: DataFrame, ngrams: dict[int, int] = NGRAMS) -> DataFrame:
    """A row for each row of docs (doc_id, text): the base measures and verdict, characters in repeated n-grams and lines, kept, and the rules that failed.

    A null or empty text has no words and fails the base rules. Repeated rows are measured each by itself, other columns are
    left out, an empty table gives no rows. A very long text costs some 60 bytes a word while its task measures it.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [*(f"chars_{n}" for n in ngrams), "n_lines", "dup_line_chars"]
    kinds = {c: pa.int64() for c in counts} | {"base_failed": pa.bool_(), "kept": pa.bool_()} | {c: pa.int64() for c in more} | {"failed_rules": pa.string()}

    def run(batches):
        for b in batches:
            found = [measure(t.as_py() or "", ngrams) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[c] for f in found], k) for c, k in kinds.items())], ["doc_id", *kinds])

    sql = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {sql[k]}" for c, k in kinds.items()))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_CHARS = "list_sum(list_transform({}, lambda x: length(x)))"


def _grams(n: int) -> str:
    """Words (places from 1) in n-grams found twice or more, by document."""
    gram = f"SELECT doc_id, i, list_slice(w, i, i + {n - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)"
    return f"""g{n} AS ({gram}), t{n} AS (SELECT doc_id, g FROM g{n} GROUP BY doc_id, g HAVING count(*) > 1),
c{n} AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT g.doc_id, g.i, unnest(range(0, {n})) AS k FROM g{n} g JOIN t{n} t ON g.doc_id = t.doc_id AND g.g = t.g)),
m{n} AS (SELECT c.doc_id, count(*) AS n, sum(length(w[i])) AS chars FROM c{n} c JOIN d ON c.doc_id = d.doc_id GROUP BY c.doc_id)"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, x),
ln AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS again, sum((n - 1) * length(x)) AS dup_chars, sum(n * length(x)) AS line_chars FROM l GROUP BY doc_id),
{", ".join(map(_grams, sorted({BASE_NGRAM, *NGRAMS})))},
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce({_CHARS.format('w')}, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(ln.again, 0)::BIGINT AS n_dup_lines, coalesce(m{BASE_NGRAM}.n, 0)::BIGINT AS n_repeat_words, {", ".join(f"coalesce(m{n}.chars, 0)::BIGINT AS chars_{n}" for n in NGRAMS)},
  coalesce(ln.n_lines, 0)::BIGINT AS n_lines, coalesce(ln.dup_chars, 0)::BIGINT AS dup_line_chars, coalesce(ln.line_chars, 0) AS line_chars
  FROM d LEFT JOIN ln ON d.doc_id = ln.doc_id {" ".join(f"LEFT JOIN m{n} ON d.doc_id = m{n}.doc_id" for n in sorted({BASE_NGRAM, *NGRAMS}))}),
f AS (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {BASE_SHARE} * n_words AS base_failed, {", ".join(f"100 * chars_{n} > {s} * word_chars AS f{n}" for n, s in NGRAMS.items())},
  100 * n_dup_lines > {LINES} * n_lines AS fl, 100 * dup_line_chars > {LINE_CHARS} * line_chars AS fc FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(f"f{n}" for n in NGRAMS)} OR fl OR fc) AS kept,
  {", ".join(f"chars_{n}" for n in NGRAMS)}, n_lines, dup_line_chars, concat_ws(', ', CASE WHEN base_failed THEN 'base' END, {", ".join(f"CASE WHEN f{n} THEN '{n}-grams' END" for n in NGRAMS)},
  CASE WHEN fl THEN 'lines' END, CASE WHEN fc THEN 'line characters' END) AS failed_rules FROM f
"""
