"""Byte-pair encoding and decoding by a deterministic tokenization automaton.

Start from one state with a loop for each byte, and apply the merges in order. The gadget for a merge u v -> w copies the
state that u's arcs enter, takes arc v out of the copy, points u's arcs there, and adds arc w beside each arc u, into the
state that v's arcs enter (for u = v the state before the copy). So every token's arcs enter one state, and what a state
lacks is decided by the gadgets: the one of u v takes arc v, and each arc made beside it later, from u's state and from each
state copied from that later.

States that come from one another by copying are numbered next to each other, and so are arcs that were made beside one
another, later ones first. What a gadget takes away is then a range of arcs in a range of states, and the table of
transitions has, for each state, the ranges of arcs that it lacks; any other arc leads to the state of its token.

A path is a correct tokenization just if the automaton has it, and each byte string has one. Encoding follows it
from table entry to table entry; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import array
import bisect
import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, byte_alphabet, default_tokenizer, filled, known_split, library, table, vocabulary

#: A worker forgets its words when it knows so many; bounds its memory, not what is encoded.
WORDS = 800_000


class _Tree:
    """Tokens numbered so that a token and what was made from it stand together, of its children the youngest first."""

    def __init__(self, parent: dict[int, int], born: dict[int, int], tokens):
        below: dict[int, list[int]] = {}
        for w, p in parent.items():
            below.setdefault(p, []).append(w)
        for group in below.values():
            group.sort(key=lambda w: -born[w])
        self.at: dict[int, int] = {}
        stack = [t for t in tokens if t not in parent]
        while stack:
            t = stack.pop()
            self.at[t] = len(self.at)
            stack.extend(reversed(below.get(t, ())))
        size = dict.fromkeys(self.at, 1)
        for t in sorted(parent, key=lambda w: -self.at[w]):
            size[parent[t]] += size[t]
        self.end = {t: self.at[t] + n for t, n in size.items()}
        self.ages = {p: ([-born[w] for w in group], [self.at[w] for w in group]) for p, group in below.items()}

    def range(self, t: int, rank: int, too: bool) -> tuple[int, int]:
        """Numbers of t and of what was made from it after the rank (too: or at it)."""
        ages, at = self.ages.get(t, ((), ()))
        k = bisect.bisect_right(ages, -rank) if too else bisect.bisect_left(ages, -rank)
        return self.at[t], at[k] if k < len(at) else self.end[t]


class Automaton:
    def __init__(self, path: str):
        self.ids, self.special = vocabulary(path)
        self.labels = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.reach: dict[bytes, int] = {}  # the longest token that starts with these three bytes
        for t in self.ids:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        of = byte_alphabet()
        as_id = lambda t: self.ids[bytes(of[c] for c in t)]
        cut: dict[tuple[int, int], int] = {}  # arc v taken out of u's state: at which merge
        born: dict[int, int] = {}
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        self.useless: set[int] = set()
        for rank, pair in enumerate(merges):
            u, v = map(as_id, pair if isinstance(pair, list) else pair.split(" "))
            w = self.ids[self.labels[u] + self.labels[v]]
            if w not in born:  # else a second way to the same token: its arc exists, only the cut is new
                if u in self.useless or v in self.useless or self._taken(u, v, cut, born, left, right):
                    self.useless.add(w)
                born[w], left[w], right[w] = rank, u, v
            cut.setdefault((u, v), rank)
        self._compile(cut, _Tree(right, born, self.ids.values()), _Tree(left, born, self.ids.values()))

    @staticmethod
    def _taken(u: int, v: int, cut: dict, born: dict, left: dict, right: dict) -> bool:
        """Whether a gadget so far took arc v from u's state: one of v's making, in u's state or one that it was copied from."""
        y, y_born = u, None
        while y is not None:
            t, t_born = v, None
            while t is not None:
                rank = cut.get((y, t))
                if rank is not None and (y_born is None or rank < y_born) and (t_born is None or rank <= t_born):
                    return True
                t_born, t = born.get(t), left.get(t)
            y_born, y = born.get(y), right.get(y)
        return False

    def _compile(self, cut: dict[tuple[int, int], int], states: _Tree, arcs: _Tree) -> None:
        """The table: for each state, from row[state] to row[state + 1], first arcs and ends of the ranges that it lacks."""
        spans = np.array([(*states.range(u, rank, False), *arcs.range(v, rank, True)) for (u, v), rank in cut.items()], np.int64).reshape(-1, 4)
        high = spans[:, 1] - spans[:, 0]
        state = np.repeat(spans[:, 0], high) + np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high)
        first, end = np.repeat(spans[:, 2], high), np.repeat(spans[:, 3], high)
        order = np.lexsort((first, state))
        wide = len(self.labels) + 1
        first, end = state[order] * wide + first[order], state[order] * wide + end[order]  # in a row of its own
        reach = np.maximum.accumulate(end) if len(end) else end
        new = np.concatenate([[True], first[1:] > reach[:-1]]) if len(first) else np.zeros(0, bool)
        first, end = first[new], reach[np.concatenate([new[1:], [True]])] if len(first) else reach
        self.row = np.searchsorted(first, np.arange(len(states.at) + 1) * wide).tolist()
        self.first, self.end = array.array("q", (first % wide).tolist()), array.array("q", (end - first + first % wide).tolist())
        self.state, self.arc = ([tree.at.get(t, -1) for t in range(max(self.labels) + 1)] for tree in (states, arcs))

    def has(self, last: int, token: int) -> bool:
        """Whether the state that `last` enters has the token's arc."""
        s, a = self.state[last], self.arc[token]
        k = bisect.bisect_right(self.first, a, self.row[s], self.row[s + 1]) - 1
        return k < self.row[s] or self.end[k] <= a

    def encode(self, word: bytes) -> list[int]:
        """Ids of the one path that spells the word: the longest arc first, back where no arc goes on.

        A prefix has one correct path too, so a position that was left once is never entered again.
        """
        ids, useless, reach, n = self.ids, self.useless, self.reach.get, len(word)
        row, first, end, arc, state, place = self.row, self.first, self.end, self.arc, self.state, bisect.bisect_right
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, last, k = 0, -1, reach(word[:3], 2)
        while at < n:
            while k:
                t = ids.get(word[at : at + k]) if at + k <= n else None
                if t is not None and at + k not in dead and t not in useless:
                    if last < 0:
                        break
                    a, r = arc[t], row[state[last]]  # as in has()
                    i = place(first, a, r, row[state[last] + 1]) - 1
                    if i < r or end[i] <= a:
                        break
                k -= 1
            if k:
                out.append(t)
                starts.append(at)
                at, last = at + k, t
                k = reach(word[at : at + 3], 2)
            else:
                dead.add(at)
                at, k = starts[-1], at - starts.pop() - 1
                out.pop()
                last = out[-1] if out else -1
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=1)
def automaton(path: str) -> Automaton:
    return Automaton(path)


class Codec:
    """Encodes whole texts; words seen before are looked up."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.auto, self.path, self.words, self.known = automaton(path), path, {}, known_split(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.auto.special)) + ")").split if self.auto.special else None

    def _pieces(self, text: str) -> list[str]:
        if self.known and ((text.isascii() and text.isprintable()) or not ODD.search(text)):
            return self.split(text)
        return [text[a:z] for _, (a, z) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[tuple[str, bytes]]:
        """Of each word: its ids as decimal text, and the labels of its arcs."""
        if self.at_special and any(s in text for s in self.auto.special):
            return [x for k, t in enumerate(self.at_special(text)) if t for x in ([self._part([self.auto.special[t]])] if k % 2 else self._plain(t))]
        return self._plain(text)

    def _part(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join(map(str, ids)), b"".join(map(self.auto.labels.__getitem__, ids))

    def _plain(self, text: str) -> list[tuple[str, bytes]]:
        words, pieces = self.words, self._pieces(text)
        if len(words) > WORDS:
            words.clear()
        for w in pieces:
            if w not in words:
                words[w] = self._part(self.auto.encode(w.encode()))
        return list(map(words.__getitem__, pieces))


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of each row; null texts are empty.

    Repeated rows are all encoded, texts of any length whole; an empty table gives no rows; other columns of docs are left
    aside. The tokenizer must be byte-level BPE; where its split into words isn't the known one, the library splits.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        codec = Codec(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for text in filled(b.column(1)):
                parts = codec.parts(text)
                line = ",".join([p[0] for p in parts])
                n.append(line.count(",") + 1 if line else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[1] for p in parts]).decode("utf-8", errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
