"""Removal of passages that repeat across documents.

Every 50-byte string contains the smallest of its 24-byte grams (by hash), wherever it stands, so equal strings share such
an anchor at the same offset. One pass finds the anchors that stand in more than one document, by halves of their hashes. The
text around each of those (all 50-byte strings whose smallest gram it is) goes to the anchor's bucket, once for each batch if its
surroundings are the same. In a bucket, suffix order comes from Burrows-Wheeler transforms of shards, merged by interleave
refinement, which also gives the common prefixes; an interval of rows with 50 bytes in common is one string, and its smallest
doc_id decides. Strings around anchors that so many batches hold that a bucket would fill up with them, or that crowd one batch,
are rows of a table instead, one for each string of a batch with all its places, and the smallest doc_id of each is a sum that
Spark makes before and after its shuffle, so that no bucket grows with them. The number of buckets follows from the bytes of text.

What is taken as equal by hash across batches agrees in two 64-bit hashes: of the anchor and of its surroundings, or of a string
and of its first half.

Documents are kept in batches of a few MB in a table bucketed by batch, so text is never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated
from .common import arrow_rows, materialise, scratch, table, text_or_empty, workspace

WINDOW, GRAM = 50, 24
REACH = WINDOW - GRAM  # bytes on either side of an anchor that its strings may take in
#: A string by itself takes several times the room of its share of an anchor's surroundings; an anchor's in HOT_BATCHES batches take some 3 MB.
BATCH_BYTES, HOT_BATCHES, CROWD = 2 << 20, 32_768, 64
#: Text of a bucket of anchors, and of a bucket of the table of batches (Spark allows MOST_BUCKETS of these).
HOME_BYTES, TABLE_BYTES, MOST_BUCKETS = 8 << 20, 64 << 20, 100_000
_draw = np.random.Generator(np.random.PCG64(11))
_BYTE = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C17  # odd, and 1 less is no multiple of 4
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: What a batch's post says of an anchor, and what the answer says of it.
_MANY, _CROWD = _SHARED, _HOT = 1, 2
#: A place of an anchor, as it goes to the anchor's bucket beside its text; the hashes are made from the text again, a MB or so at once.
_PLACE, HASHED_BYTES = np.dtype([("doc", "<i8"), ("start", "<i4"), ("length", "u1"), ("left", "u1")]), 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(32)


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of x[i : i + n] for each i, by doubling."""
    y, have = x, 1
    while have < n:
        step = min(have, n - have)
        y = best(y[:-step], y[step:])
        have += step
    return y


class Hashes:
    """Hashes of any range of a text, from sums of powers."""

    def __init__(self, text: np.ndarray):
        power = np.full(len(text) + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.full(len(text) + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[text] * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def all(self, n: int) -> np.ndarray:
        return _mixed((self.sums[n:] - self.sums[:-n]) * self.back[:-n])


def anchors(text: np.ndarray, ends: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and document (by number) of each anchor; the least hash within each string, from REACH places before the text on."""
    none = np.zeros(0, np.int64)
    if len(text) < WINDOW:
        return none, none.astype(np.uint64), none, none.astype(np.uint32)
    gram = hashes.all(GRAM)
    short = _short(gram)
    least = _slide(short, REACH + 1, np.minimum)  # of the window from each place
    for a, z in zip(np.maximum(0, ends - WINDOW + 1), ends, strict=True):
        least[a:z] = 0  # windows that leave their document
    least = np.concatenate([np.zeros(REACH, np.uint32), least, np.zeros(REACH, np.uint32)])
    at = np.flatnonzero(_slide(least, REACH + 1, np.maximum) == short)
    return at, gram[at], np.searchsorted(ends, at, side="right"), least


def _short(gram: np.ndarray) -> np.ndarray:
    """What decides which gram is the smallest; 0 is left for strings that leave their document."""
    return np.maximum((gram >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def _extent(at: np.ndarray, gram: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings whose smallest gram is the anchor begin and end; they follow one another without a gap."""
    mine = least[at[:, None] + np.arange(REACH + 1)] == _short(gram)[:, None]
    return at - REACH + mine.argmax(axis=1), at - mine[:, ::-1].argmax(axis=1) + WINDOW


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["text"], np.uint8), np.frombuffer(row["ends"], np.int64), np.frombuffer(row["ids"], np.int64)


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of values, from 0."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    out = np.zeros(len(a), np.int64)
    out[order[1:]] = np.cumsum((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    return out


def _first_of(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc of each row's group."""
    _, back = np.unique(group, return_inverse=True)
    least = np.full(back.max() + 1 if len(back) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, back, doc)
    return least[back]


def _batched(most: int):
    """Rows of batch, ids, ends, text: documents one after another, a few MB a row."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row():
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([ends.tobytes()]), pa.array([b"".join(texts)])], names=["batch", "ids", "ends", "text"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= most:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    return run


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):  # one Arrow row at a time: it holds MBs
            yield {name: b.column(j)[k].as_py() for j, name in enumerate(b.schema.names)}


def _post_hashes(buckets: int, crowded: int):
    def run(batches):
        for row in _rows(batches):
            text, ends, _ = _unpack(row)
            _, gram, doc, _ = anchors(text, ends, Hashes(text))
            order = np.lexsort((doc, gram))
            g, d = gram[order], doc[order]
            new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
            many = np.zeros(new.sum(), bool)  # in several documents of this batch
            many[(np.cumsum(new) - 1)[1:][~new[1:] & (d[1:] != d[:-1])]] = True
            crowd = np.diff(np.append(np.flatnonzero(new), len(g))) >= crowded
            home, order = _dealt(g[new], buckets)
            half, flags = (g[new] >> np.uint64(32)).astype("<u4")[order], (many * _MANY + crowd * _CROWD).astype(np.uint8)[order]
            cuts = _cuts(home)
            yield pa.RecordBatch.from_arrays([pa.array(home[cuts[:-1]], pa.int64()), pa.array([row["batch"]] * (len(cuts) - 1), pa.int64()), pa.array(_pieces(half, cuts), pa.binary()), pa.array(_pieces(flags, cuts), pa.binary())], names=["bucket", "batch", "grams", "flags"])

    return run


def _dealt(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' buckets in order, and the anchors' places in that order."""
    home = (gram % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return home[order], order


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.diff(sorted_, prepend=sorted_[:1] - 1)), len(sorted_))


def _pieces(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    whole, at = values.tobytes(), (cuts * values.itemsize).tolist()
    return [whole[a:z] for a, z in zip(at, at[1:], strict=False)]


def _shared(rows: pd.DataFrame, hot_batches: int) -> pd.DataFrame:
    """For each batch of a bucket, which of its grams stand in several documents, and which of these in very many batches or crowded in one.

    Grams are told apart by half of their hash, as the bucket says the rest; of two that agree in it more is handed on than need be.
    """
    gram, said = np.frombuffer(b"".join(rows["grams"]), "<u4"), np.frombuffer(b"".join(rows["flags"]), np.uint8)
    order = np.argsort(gram)
    cuts = _cuts(gram[order].astype(np.int64))
    count = np.diff(cuts)
    crowded = np.bitwise_or.reduceat(said[order], cuts[:-1]) & _CROWD > 0
    found = np.empty(len(gram), np.uint8)
    found[order] = np.repeat((count > 1) * _SHARED + ((count > hot_batches) | crowded) * _HOT, count)
    found |= said & _MANY
    return pd.DataFrame({"bucket": rows["bucket"], "batch": rows["batch"], "flags": _pieces(found, np.cumsum([0, *map(len, rows["flags"])]))})


def _around(hashes: Hashes, start: np.ndarray, stop: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of an anchor's surroundings and of where in them it stands."""
    return hashes.of(start, stop) ^ _mixed((at - start).astype(np.uint64) << np.uint64(8) | (stop - start).astype(np.uint64))


def _surroundings(buckets: int):
    """Of each batch: spans that the batch itself decides, and what goes to buckets (by anchor, or by string if hot)."""
    names = ["batch", "kind", "bucket", "data", "text"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for row in _rows(batches):
            text, ends, ids = _unpack(row)
            hashes = Hashes(text)
            at, gram, doc, least_gram = anchors(text, ends, hashes)
            order = np.argsort(gram)
            cuts = _cuts(gram[order].view(np.int64))
            said = np.empty(len(cuts) - 1, np.uint8)
            said[_dealt(gram[order[cuts[:-1]]], buckets)[1]] = np.frombuffer(b"".join(p["flags"] for p in sorted(row["parts"], key=lambda p: p["bucket"])), np.uint8)
            flags = np.empty(len(gram), np.uint8)
            flags[order] = np.repeat(said, np.diff(cuts))
            at, gram, doc, is_hot = (x[flags & _SHARED > 0] for x in (at, gram, doc, flags & _HOT > 0))
            start, stop = _extent(at, gram, least_gram)
            around = _around(hashes, start, stop, at)
            docs = ids[doc]
            least = _first_of(around, docs)
            sure = docs > least
            spans = [np.stack([start[sure], stop[sure]], axis=1)]
            out: list[list] = [[] for _ in names]

            def put(kind, bucket, data, body):
                for column, x in zip(out, (row["batch"], kind, bucket, data, body), strict=True):
                    column.append(x)

            rest = np.flatnonzero(~sure & ~is_hot)
            home, order = _dealt(gram[rest], buckets)
            rest, cuts = rest[order], _cuts(home)
            place, size = np.empty(len(rest), _PLACE), (stop - start)[rest]
            for name, x in zip(_PLACE.names, (docs, start, stop - start, at - start), strict=True):
                place[name] = x[rest]
            begin = np.cumsum(size) - size
            texts = text[np.repeat(start[rest] - begin, size) + np.arange(size.sum())]
            for b, data, body in zip(home[cuts[:-1]].tolist(), _pieces(place, cuts), _pieces(texts, np.append(begin, len(texts))[cuts]), strict=True):
                put(1, b, data, pack(body))
            hot_at = np.flatnonzero(~sure & is_hot)
            n = stop[hot_at] - start[hot_at] - WINDOW + 1
            first = np.repeat(start[hot_at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, one = np.unique(first, return_index=True)
            d = np.repeat(docs[hot_at], n)[one]
            string = hashes.of(first, first + WINDOW)
            least = _first_of(string, d)
            spans.append(np.stack([first[d > least], first[d > least] + WINDOW], axis=1))
            open_ = np.flatnonzero(d == least)  # all of a string in one document
            if len(open_):
                open_ = open_[np.argsort(string[open_], kind="stable")]
                cuts = _cuts(string[open_].view(np.int64))
                one = open_[cuts[:-1]]
                half = hashes.of(first[one], first[one] + WINDOW // 2)
                put(2, row["batch"], np.stack([string[one].view(np.int64), half.view(np.int64), d[one], np.diff(cuts)]).astype("<i8").tobytes(), first[open_].astype("<i4").tobytes())
            spans = np.concatenate(spans)
            if len(spans):
                put(0, row["batch"], _joined(spans).tobytes(), None)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    return run


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans (start, stop) in order, overlapping ones as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    stop = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > stop[:-1]])
    return np.stack([spans[new, 0], stop[np.concatenate([new[1:], [True]])]], axis=1)


def _emit(batch: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pd.DataFrame:
    order = np.argsort(batch, kind="stable")
    found, first = np.unique(batch[order], return_index=True)
    parts = np.split(order, first[1:]) if len(found) else []
    return pd.DataFrame({"batch": found.astype(np.int64), "spans": [_joined(np.stack([start[p], stop[p]], axis=1)).tobytes() for p in parts]})


def _common(texts: np.ndarray, gram: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """How many bytes from `at` in the direction of step each string has in common with any other of its gram."""
    out, key, alive = np.zeros(len(at), np.int64), gram.view(np.uint64).copy(), np.arange(len(at))
    for k in range(REACH):
        place = at[alive] + step * k
        alive, place = alive[place != stop[alive]], place[place != stop[alive]]
        key[alive] = _mixed(key[alive] ^ _BYTE[texts[place]])
        _, back, n = np.unique(key[alive], return_inverse=True, return_counts=True)
        alive = alive[n[back] > 1]
        out[alive] = k + 1
    return out


def _hashed(texts: np.ndarray, start: np.ndarray, length: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors in texts and of their surroundings, as their batches have them."""
    out = np.empty((2, len(start)), np.int64)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(texts), HASHED_BYTES)), len(start))).tolist()
    for a, z in zip(cuts, cuts[1:], strict=False):
        begin, end = start[a], start[z - 1] + length[z - 1]
        hashes, at = Hashes(texts[begin:end]), start[a:z] - begin
        out[0, a:z] = hashes.of(at + left[a:z], at + left[a:z] + GRAM).view(np.int64)
        out[1, a:z] = _around(hashes, at, at + length[a:z], at + left[a:z]).view(np.int64)
    return out[0], out[1]


def _by_anchor(rows: pd.DataFrame) -> pd.DataFrame:
    batch = np.repeat(rows["batch"].to_numpy(np.int64), [len(x) // _PLACE.itemsize for x in rows["data"]])
    place = np.frombuffer(b"".join(rows["data"]), _PLACE)
    doc, start, length, left = (place[name].astype(np.int64) for name in _PLACE.names)
    unpack = zstandard.ZstdDecompressor().decompress
    texts = np.frombuffer(b"".join(map(unpack, rows["text"])), np.uint8)
    text_at = np.cumsum(length) - length
    gram, around = _hashed(texts, text_at, length, left)
    group = _numbered(gram, around)
    least = _first_of(group, doc)
    full = doc > least
    out = [(batch[full], start[full], start[full] + length[full])]
    # one string for each different surroundings, of anchors that have several and in several documents
    _, one, back = np.unique(group, return_index=True, return_inverse=True)
    g, first_doc = gram[one], least[one]
    _, kind, n = np.unique(g, return_inverse=True, return_counts=True)
    pick = np.flatnonzero((n[kind] > 1) & (_first_of(g, first_doc) != -_first_of(g, -first_doc)))
    # what no other string of the anchor shares is cut off its ends
    begin = text_at[one[pick]]
    middle = begin + left[one[pick]]
    before = _common(texts, g[pick], middle - 1, begin - 1, -1)
    after = _common(texts, g[pick], middle + GRAM, begin + length[one[pick]], 1)
    enough = before + after >= REACH
    pick, begin, middle, before, after = (x[enough] for x in (pick, begin, middle, before, after))
    if len(pick):
        string, offset, interval = repeated(texts, middle - before, before + GRAM + after, WINDOW)
        offset = offset + (middle - before - begin)[string]
        covered = first_doc[pick][string] > _first_of(interval, first_doc[pick][string])
        string, offset = pick[string[covered]], offset[covered]
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        new = np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(string) else np.zeros(0, bool)
        last = np.concatenate([new[1:], [True]]) if len(string) else new
        s, a, z = string[new], offset[new], offset[last] + WINDOW
        # every open place with these surroundings
        places = np.flatnonzero(~full)
        places = places[np.argsort(back[places], kind="stable")]
        lo, hi = np.searchsorted(back[places], s, side="left"), np.searchsorted(back[places], s, side="right")
        at = places[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        out.append((batch[at], start[at] + np.repeat(a, hi - lo), start[at] + np.repeat(z, hi - lo)))
    return _emit(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans of each batch, from a bucket of one kind: decided by the batch itself, or by anchor. What is decided by string (kind 2) is handed on."""
    kind = int(rows["kind"].iloc[0])
    found = _by_anchor(rows).assign(text=None) if kind == 1 else rows[["batch", "data", "text"]].rename(columns={"data": "spans"})
    return found.assign(kind=kind)[["batch", "spans", "kind", "text"]]


def _places(batches):
    """A row for each string of a batch that is decided by string, with the places where it begins."""
    for b in batches:
        for batch, data, first in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            *x, n = np.frombuffer(data, "<i8").reshape(4, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch)), *map(pa.array, x), pa.array(_pieces(np.frombuffer(first, "<i4"), np.cumsum([0, *n])), pa.binary())], names=["batch", "string", "half", "doc", "first"])


def _by_string(handed: DataFrame) -> DataFrame:
    """batch, spans of the strings that a smaller doc_id holds too: the smallest doc_id of each is found before the shuffle and after it."""
    places = handed.select("batch", "spans", "text").mapInArrow(_places, "batch long, string long, half long, doc long, first binary")
    least = places.groupBy("string", "half").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    covered = places.join(least, ["string", "half"]).where("doc > least").select("batch", "first")

    def spans(rows):
        first = np.frombuffer(b"".join(rows["first"]), "<i4").astype(np.int64)
        return _emit(np.repeat(rows["batch"].to_numpy(np.int64), [len(x) // 4 for x in rows["first"]]), first, first + WINDOW)

    return covered.groupBy("batch").applyInPandas(spans, "batch long, spans binary")


def _results(text_too: bool):
    def run(batches):
        for row in _rows(batches):
            text, ends, ids = _unpack(row)
            change = np.zeros(len(text) + 1, np.int32)
            for part in row["parts"] or ():
                spans = np.frombuffer(part, np.int64).reshape(-1, 2)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            out: list[list] = [[] for _ in range(5)]
            begin = 0
            for end in ends:
                mine = gone[begin:end]
                left = text[begin:end][~mine].tobytes()
                runs = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if len(mine) else 0
                for column, x in zip(out, (int(end - begin), int(mine.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", errors="ignore") if text_too else None), strict=True):
                    column.append(x)
                begin = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
            yield made if text_too else made.drop_columns(["kept_text"])

    return run


def remove_repeats(docs: DataFrame, text_too: bool = False, batch_bytes: int = BATCH_BYTES, hot_batches: int = HOT_BATCHES, crowded: int = CROWD, home_bytes: int = HOME_BYTES) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with text_too kept_text.

    Null texts are empty. Strings are compared between documents of different doc_id only; rows of one doc_id don't count
    against each other, and rows without doc_id are left whole and count against none. kept_text leaves out the bytes of
    a character that was cut in two. Texts of any length are taken whole; an empty table gives no rows; other columns of docs
    are left aside. The result is written to the shared folder; all else that is written is removed, after a failure too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(least, total // TABLE_BYTES + 1))
    homes = max(2 * least, total // home_bytes + 1)  # buckets of anchors
    name = f"text_batches_{uuid.uuid4().hex}"
    held = docs.where("doc_id IS NOT NULL").mapInArrow(_batched(batch_bytes), "batch long, ids binary, ends binary, text binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * text_too
    path = scratch(spark, "kept")
    try:
        held.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).bucketBy(buckets, "batch").format("parquet").saveAsTable(name)
        kept = spark.table(name)
        posted = kept.mapInArrow(_post_hashes(homes, crowded), "bucket long, batch long, grams binary, flags binary")
        shared = posted.groupBy("bucket").applyInPandas(lambda rows: _shared(rows, hot_batches), "bucket long, batch long, flags binary")
        with workspace(spark, "repeats"), arrow_rows(spark, 16):  # a row holds a batch
            answers = materialise(shared, "answers").groupBy("batch").agg(F.collect_list(F.struct("bucket", "flags")).alias("parts"))  # what is said of one batch's anchors
            around = kept.join(answers, "batch").select("batch", "ids", "ends", "text", "parts").mapInArrow(_surroundings(homes), "batch long, kind int, bucket long, data binary, text binary")
            decided = materialise(around.groupBy("kind", "bucket").applyInPandas(_decide, "batch long, spans binary, kind int, text binary"), "spans")
            spans = decided.where("kind < 2").select("batch", "spans").union(_by_string(decided.where("kind = 2")))
            by_batch = spans.groupBy("batch").agg(F.collect_list("spans").alias("parts"))  # spans of one batch's text
            out = materialise(kept.join(by_batch, "batch", "left").select("batch", "ids", "ends", "text", "parts").mapInArrow(_results(text_too), schema), "kept", path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    whole = docs.where("doc_id IS NULL").select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").cast("string").alias("kept_text")] * text_too))
    return out.union(whole)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
