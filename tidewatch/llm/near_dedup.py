"""Near-duplicate detection by an inverted join over MinHash signature coordinates.

Documents of one shingle set are one representative. A representative is posted under its (coordinate, value) pairs; a
linked pair agrees on at least MATCH of COORDINATES (but for a chance of about 3e-7 at a similarity of 0.75). Each list of
pairs is ordered from rare to common; two lists with MATCH pairs in common meet within the first COORDINATES - MATCH + 1 of
each, so only these prefixes are posted, and pairs that nobody else has needn't be posted at all: a document with
fewer than MATCH shared pairs is skipped. Collisions are then counted on packed signatures, and what reaches the
threshold is confirmed on full sets.

First each posting list is tested against its smallest member only, which ties a large group together in as many tests as
it has members. Then only members that still belong to different components are tested against each other, so no link
between components is lost and no group is expanded into all its pairs. Short lists are merged by a join. The members of
long ones (as of pages of one template, alike but not linked) are dealt to blocks of a bounded size, those of a large
component apart from all others, and each pair of blocks that meet in a list is tested once, by counting the collisions of
longer signatures in arrays; what reaches their threshold is confirmed on full sets at once, and only links leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, filled, materialise, scratch, table, workspace
from .components import components

WORDS, COORDINATES, MATCH = 5, 64, 31
#: A longer signature of those that are posted, one bit a coordinate; at a similarity of 0.75 no fewer agree than this but
#: for a chance of about 3e-6 (1792 are expected, with a deviation of 15).
LONG, LONG_MATCH = 2048, 1724
#: A posting list with more members is long; about so many bytes of sets and signatures are a block.
SHORT_LIST, BLOCK_BYTES = 64, 4 << 20
PERCENT = 75
_draw = np.random.Generator(np.random.PCG64(7))
_A = _draw.integers(0, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, LONG, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


class _Words(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


def shingles(text: str, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; fewer words are one shingle; none, an empty set."""
    found = text.encode(errors="surrogatepass").lower().split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(len(h), WORDS)):
        total = total + h[k : k + n] * _POWERS[k]
    return np.unique(_mixed(total))


def signature(found: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    least, step = np.full(n, np.iinfo(np.uint64).max), (1 << 17) // n
    for at in range(0, len(found), step):
        np.minimum(least, (found[at : at + step, None] * _A[:n] + _B[:n]).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen to a number."""
    four = (_mixed(least) >> np.uint64(60)).reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(four, axis=1).view(np.int64)


def long_signature(found: np.ndarray) -> np.ndarray:
    """One bit of each of LONG coordinates, 64 to a number."""
    one = _mixed(signature(found, LONG)) >> np.uint64(63)
    return np.bitwise_or.reduce(one.reshape(-1, 64) << np.arange(64, dtype=np.uint64), axis=1).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, s1 and s2 (digest of the set), keys (coordinate in the last six bits), sketch (four bits a coordinate)."""

    def run(batches):
        words = _Words()
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                n, s1, s2, keys, sketch = [], [], [], [], []
                for text in filled(part.column(1)):
                    found = shingles(text, words)
                    d = xxhash.xxh3_128_intdigest(found.tobytes())
                    n.append(len(found))
                    s1.append((d >> 64) - (1 << 63))
                    s2.append((d & (1 << 64) - 1) - (1 << 63))
                    least = signature(found)
                    keys.append((least & ~np.uint64(63) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64) if len(found) else [])
                    sketch.append(packed(least))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, s1, s2)), pa.array(keys, longs), pa.array(sketch, longs)], names=["doc_id", "n", "s1", "s2", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        words = _Words()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = [shingles(t, words) for t in filled(part.column(1))]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in found], longs), pa.array([long_signature(x) for x in found], longs)], names=["rep", "found", "long"])

    return docs.mapInArrow(run, "rep long, found array<long>, long array<long>")


_NIBBLES = 0x1111111111111111


def _alike(a: str, b: str) -> str:
    """SQL: sizes allow a link, and enough coordinates agree (four-bit values, so never too few)."""
    same = " + ".join(f"bit_count((({x} | shiftright({x}, 1)) | shiftright(({x} | shiftright({x}, 1)), 2)) & {_NIBBLES}L)" for x in (f"({a}.sketch[{k}] ^ {b}.sketch[{k}])" for k in range(4)))
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) AND {COORDINATES} - ({same}) >= {MATCH}"


def _nearly(a: str, b: str) -> str:
    """SQL: enough coordinates of the longer signatures agree, and this key is the first that the two prefixes share."""
    differ = f"zip_with({a}.long, {b}.long, (x, y) -> bit_count(x ^ y))"
    return f"{LONG} - aggregate({differ}, 0, (s, c) -> s + c) >= {LONG_MATCH} AND element_at(array_intersect({a}.prefix, {b}.prefix), 1) = {a}.key"


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("found").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("found").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= PERCENT * (F.size("x") + F.size("y") - common)).select("a", "b")


def _blocks(hot: DataFrame, block_bytes: int) -> DataFrame:
    """A block for each member of long lists (key, rep, component, n, m): rep, component, block, single.

    A member goes by its longest list. What a component has there, if it is over half a block, is dealt to blocks of its own
    (single is that component), by the hash of the member; smaller components are dealt by their hash, so each stays whole.
    """
    size = 8 * F.col("n") + LONG // 8 + 64
    home = materialise(hot.groupBy("rep", "component", "n").agg(F.max(F.struct("m", "key"))["key"].alias("home")), "homes")
    sizes = home.groupBy("home", "component").agg(F.sum(size).alias("own")).withColumn("big", F.col("own") > block_bytes // 2)
    small = sizes.where("not big").groupBy("home").agg(F.sum("own").alias("all"))
    parts = lambda c: F.ceil(F.col(c) / block_bytes)
    alone = F.xxhash64("home", "component", F.pmod(F.xxhash64("rep"), parts("own")))
    mixed = F.xxhash64("home", F.lit("mixed"), F.pmod(F.xxhash64("component"), parts("all")))
    seats = home.join(sizes, ["home", "component"]).join(small, "home", "left")
    return seats.select("rep", "component", F.when(F.col("big"), alone).otherwise(mixed).alias("block"), F.when(F.col("big"), F.col("component")).alias("single"))


def _unpack(members) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """rep, component, long signature and sorted set of each member of a block (an Arrow array of structs)."""
    longs = members.field("long").flatten().to_numpy().view(np.uint64).reshape(len(members), -1)
    found = members.field("found")
    ends = np.cumsum(found.value_lengths().to_numpy())[:-1]
    return members.field("rep").to_numpy(), members.field("component").to_numpy(), longs, np.split(found.flatten().to_numpy(), ends)


def links_between(a, b) -> list[tuple[int, int]]:
    """Links between two blocks' members of different components; one that others of these links imply is left out."""
    (rep_a, own_a, long_a, set_a), (rep_b, own_b, long_b, set_b) = a, b
    n_a, n_b = np.array([len(x) for x in set_a]), np.array([len(x) for x in set_b])
    tied: dict[int, int] = {}

    def root(c: int) -> int:
        while c in tied:
            c = tied[c]
        return c

    out = []
    for at in range(0, len(rep_a), 128):
        part = slice(at, at + 128)
        differ = np.zeros((len(rep_a[part]), len(rep_b)), np.uint16)
        for k in range(long_a.shape[1]):
            differ += np.bitwise_count(long_a[part, k, None] ^ long_b[None, :, k])
        x, y = n_a[part, None], n_b[None, :]
        near = (differ <= LONG - LONG_MATCH) & (own_a[part, None] != own_b[None, :]) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y))
        for i, j in np.argwhere(near) + (at, 0):
            p, q = root(own_a[i]), root(own_b[j])
            if p != q:
                common = len(np.intersect1d(set_a[i], set_b[j], assume_unique=True))
                if 100 * common >= PERCENT * (n_a[i] + n_b[j] - common):
                    tied[max(p, q)] = min(p, q)
                    out.append((int(rep_a[i]), int(rep_b[j])))
    return out


def _long_lists(hot: DataFrame, sets: DataFrame, block_bytes: int) -> DataFrame:
    """Links (a, b) between members of different components that meet in a long list (key, rep, component, n, m)."""
    seats = materialise(_blocks(hot, block_bytes), "seats")
    touch = hot.select("key", "rep").join(seats, "rep").select("key", "block", "single").distinct()
    apart = "a.key = b.key AND a.block <= b.block AND (a.single IS NULL OR b.single IS NULL OR a.single <> b.single)"
    meet = touch.alias("a").join(touch.alias("b"), F.expr(apart)).select(F.col("a.block").alias("block"), F.col("b.block").alias("other")).distinct()
    # a block holds about block_bytes
    held = seats.join(sets, "rep").groupBy("block").agg(F.collect_list(F.struct("rep", "component", "found", "long")).alias("mine"))
    held = materialise(held, "blocks")
    both = materialise(meet, "meetings").join(held, "block").join(held.select(F.col("block").alias("other"), F.col("mine").alias("theirs")), "other").select("mine", "theirs")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                found = links_between(_unpack(b.column(0)[k].values), _unpack(b.column(1)[k].values))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    with arrow_rows(hot.sparkSession, 8):
        return materialise(both.mapInArrow(run, "a long, b long"), "between")


def near_duplicates(docs: DataFrame, short_list: int = SHORT_LIST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Texts without words (null, empty, white space) have no shingles and stand alone. Repeated rows with one doc_id are all
    kept if their doc_id is the component's. A doc_id should name one text; rows without one are components of their
    own set's smallest doc_id (null if no row of the set has one). Texts of any length are taken whole; an empty table gives
    no rows; other columns of docs are left out. Of what is written on the way, the signatures and the components stay.
    """
    docs, spark = docs.select(F.col("doc_id").cast("long"), "text"), docs.sparkSession
    found, path = materialise(signatures(docs), "signatures"), scratch(spark, "components")
    with workspace(spark, "near-duplicates"):
        named = materialise(_components(docs, found, short_list, block_bytes), "components", path)
    out = found.select("doc_id", "n", "s1", "s2").join(named.hint("merge"), ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("named", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def _components(docs: DataFrame, found: DataFrame, short_list: int, block_bytes: int) -> DataFrame:
    """s1, s2, named: the component of each set of shingles."""
    reps = found.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "keys", "sketch"), "doc_id").alias("v"))
    reps = materialise(reps.select("s1", "s2", "rep", "v.*"), "reps")

    shared = reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = reps.select("rep", F.explode("keys").alias("key")).join(shared, "key")
    lists = held.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("list")).where(F.size("list") >= MATCH)  # at most COORDINATES
    prefix = materialise(lists.select("rep", F.slice("list", F.lit(1), F.size("list") - MATCH + 1).alias("prefix")), "prefixes")
    posted = prefix.join(reps.select("rep", "n", "sketch"), "rep").select("rep", "n", "sketch", F.explode("prefix.key").alias("key"))
    posted = materialise(posted, "postings")

    centres = posted.groupBy("key").agg(F.min("rep").alias("rep"), F.min_by(F.struct("n", "sketch"), "rep").alias("v")).select("key", "rep", "v.*")
    star = centres.alias("a").join(posted.alias("b"), F.expr(f"a.key = b.key AND a.rep < b.rep AND {_alike('a', 'b')}"))
    star = materialise(star.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct(), "star")

    wanted = posted.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(_sets(docs.join(wanted, "doc_id", "left_semi")).dropDuplicates(["rep"]), "sets")
    links = materialise(_confirmed(star, sets), "links")
    tied = components(links)

    labelled = posted.join(tied.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = materialise(labelled, "labelled")
    size = F.count(F.lit(1)).alias("m")
    open_keys = materialise(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), size).where("lo < hi").select("key", "m"), "open")
    short = open_keys.where(F.col("m") <= short_list).select("key")
    lists = prefix.select("rep", F.col("prefix.key").alias("prefix")).join(sets.select("rep", "long"), "rep")
    rest = labelled.join(short, "key").join(lists, "rep")
    across = rest.alias("a").join(rest.alias("b"), F.expr(f"a.key = b.key AND a.rep < b.rep AND a.component <> b.component AND {_alike('a', 'b')} AND {_nearly('a', 'b')}"))
    across = across.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).join(star, ["a", "b"], "left_anti")
    more = materialise(_confirmed(materialise(across, "across"), sets), "more")
    long = open_keys.where(F.col("m") > short_list)
    if long.limit(1).count():
        more = more.union(_long_lists(labelled.join(long, "key").select("key", "rep", "component", "n", "m"), sets, block_bytes))
    if more.limit(1).count():
        tied = components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    named = reps.select("s1", "s2", "rep").join(tied.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select("s1", "s2", F.coalesce("component", "rep").alias("named"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
