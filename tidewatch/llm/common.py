"""The tokenizer, and what else several operators share; tables are the library's."""

from __future__ import annotations

import contextlib
import functools
import json
import re

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.tables import materialise, release, scratch, workspace  # noqa: F401
from ..functions.tables import read as table  # noqa: F401


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Jobs that start within hand at most n rows at once to Python; for rows that hold MBs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes and id of each ordinary token, text and id of each special one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of = byte_alphabet()
    ordinary = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return ordinary, special


@functools.lru_cache(maxsize=2)
def known_split(path: str) -> bool:
    """Whether the file changes nothing in a text and splits it by the pattern that plain_words follows."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    steps = pre.get("pretokenizers", [pre])
    byte_level = bool(steps) and steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space")
    whole = len(steps) == 1 and steps[0].get("use_regex", True)
    split = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["pattern"].get("Regex") == public_tokenizers.PATTERN and not steps[1].get("use_regex", True)
    return spec["normalizer"] is None and byte_level and (whole or split)


#: Characters on whose classes all Unicode versions agree; a text with others is split by the tokenizers library itself.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")


@functools.lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


# The file's split into words, for texts without odd characters, with their letters, numbers and white space named.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t\\n\\r \\xa0"
_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: A worker forgets its words when it knows so many; bounds its memory, not what is encoded.
WORDS, AT_ONCE = 800_000, 2000


def plain_words(text: str) -> list[str] | None:
    """The words into which the tokenizer file splits a text; None if the text has odd characters."""
    return None if (not text.isascii() or not text.isprintable()) and ODD.search(text) else _WORD.findall(text)


class Encoder:
    """The tokenizers library's ids of whole texts; a word that was encoded before is looked up."""

    def __init__(self, path: str):
        self.library, self.special, self.known, self.plain = library(path), tuple(vocabulary(path)[1]), {}, known_split(path)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            found = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, cuts = np.array(found.ids, "<u4"), np.searchsorted(found.word_ids, np.arange(len(part) + 1)).tolist()
            for w, a, z in zip(part, cuts, cuts[1:], strict=False):
                self.known[w] = ids[a:z].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, equal to the library's encode(text, add_special_tokens=False).

        Texts with odd characters or with strings of special tokens go to the library as they are, and all texts do where the
        file splits in another way.
        """
        split = [None if not self.plain or any(s in t for s in self.special) else plain_words(t) for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        new = set().union(*(x for x in split if x is not None))
        self._learn([w for w in new if w not in self.known])
        whole = [t for t, x in zip(texts, split, strict=True) if x is None]
        others = iter(self.library.encode_batch(whole, add_special_tokens=False))
        return [np.array(next(others).ids, "<u4") if x is None else np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<u4") for x in split]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    return _encoder(path).encode(texts)


def filled(column) -> list[str]:
    """An Arrow text column as a list, null as empty."""
    return [t or "" for t in column.to_pylist()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
