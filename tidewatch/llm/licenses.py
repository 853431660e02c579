"""License scan with a positional index of licence words.

Every template (a phrase, a notice, a short reference, or a whole licence text) has its words posted with their positions. Of each file, the
licence words with the highest IDF (over the whole corpus) are looked up, for every template whose mandatory phrases' words
the file has at all. Their postings are intersected by relative position: the shifts between file and template on which
several of these words agree place the template. There its mandatory phrases must stand word for word, and enough of
its words in their order.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, table

#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice, its label, and the key phrase that must stand in it.
NOTICES = (
    ("released under the mit license", "mit", "mit license"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license"),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "general public license version 3"),
    ("licensed under the gnu general public license version 2", "gpl-2.0", "general public license version 2"),
    ("gnu lesser general public license", "lgpl", "lesser general public license"),
    ("gnu affero general public license", "agpl", "affero general public license"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", "redistribution and use in source and binary forms"),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla public license"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", "permission to use copy modify"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "permission is hereby granted free of charge"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
)
#: How short references name a licence, as words, and its label. Each stands behind an SPDX tag, too.
SPDX = {
    "mit": "mit", "apache 2 0": "apache-2.0", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "mpl 2 0": "mpl", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib", "bsl 1 0": "bsl-1.0", "cc0 1 0": "cc0",
}
#: Names that say a licence by themselves.
NAMES = {
    "apache license 2 0": "apache-2.0", "apache license version 2 0": "apache-2.0", "gnu gpl v2": "gpl-2.0", "gnu gpl v3": "gpl-3.0", "gnu gpl version 2": "gpl-2.0", "gnu gpl version 3": "gpl-3.0", "gplv2": "gpl-2.0", "gplv3": "gpl-3.0",
    "gnu general public license v2": "gpl-2.0", "gnu general public license v3": "gpl-3.0", "gnu lgpl": "lgpl", "gnu agpl": "agpl", "mozilla public license 2 0": "mpl", "bsd 2 clause license": "bsd-2-clause", "bsd 3 clause license": "bsd-3-clause", "boost software license": "bsl-1.0",
    "creativecommons org publicdomain zero 1 0": "cc0",
}
#: Terms of Creative Commons addresses (creativecommons.org/licenses/<terms>/<version>) and their labels.
CC_TERMS = {"by": "cc-by-url", "by sa": "cc-by-sa", "by nc": "cc-by-nc", "by nd": "cc-by-nd", "by nc sa": "cc-by-nc-sa", "by nc nd": "cc-by-nc-nd"}
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")


def references() -> list[tuple[str, str]]:
    """Short references to a licence, which must stand word for word, and their labels."""
    tags = [(f"spdx license identifier {k}", x) for k, x in SPDX.items()]
    return tags + list(NAMES.items()) + [(f"creativecommons org licenses {k} {v}", x) for k, x in CC_TERMS.items() for v in CC_VERSIONS]


_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: Whole licence texts (or the notice that a licence itself prescribes), label, and phrases that must stand in them.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS, "mit", ("permission is hereby granted free of charge", "the software is provided as is")),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc", ("permission to use copy modify", "the author disclaims all warranties")),
    (_BSD + " " + _BSD_END, "bsd-2-clause", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    (_BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END, "bsd-3-clause", ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2.0", ("apache license version 2 0", "you may not use this file except in compliance")),
    (_GPL.format("general public license", "2"), "gpl-2.0", ("gnu general public license", "either version 2 of the license")),
    (_GPL.format("general public license", "3"), "gpl-3.0", ("gnu general public license", "either version 3 of the license")),
    (_GPL.format("lesser general public license", "3"), "lgpl", ("gnu lesser general public license",)),
    (_GPL.format("affero general public license", "3"), "agpl", ("gnu affero general public license",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl", ("mozilla public license",)),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "unlicense", ("free and unencumbered software", "dedicate any and all copyright interest")),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", ("the origin of this software must not be misrepresented",)),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so", "bsl-1.0", ("any person or organization obtaining a copy of the software",)),
)
#: Words of a file that are looked up for a template, and the share of a template's words that must agree besides its phrases.
RARE, AGREE = 4, 0.6
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and any other than ASCII characters."""
    return text.encode(errors="surrogatepass").translate(_FOLD).split()


@dataclass
class Template:
    words: list[bytes]
    label: str
    phrases: list[tuple[int, int]]  # where the mandatory phrases stand in words
    base: bool
    slack: int  # how far a file may depart from the template's positions

    def __post_init__(self):
        self.at: dict[bytes, list[int]] = {}
        for p, w in enumerate(self.words):
            self.at.setdefault(w, []).append(p)
        self.mandatory = frozenset(w for a, z in self.phrases for w in self.words[a:z])


def templates() -> list[Template]:
    out = []
    for text, label, phrases, base in [(p, x, (p,), True) for p, x in BASE.items()] + [(t, x, (p,), False) for t, x, p in NOTICES] + [(t, x, (t,), False) for t, x in references()] + [(*x, False) for x in TEXTS]:
        words = text.encode().split()
        spans = []
        for phrase in phrases:
            k = phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            spans.append((at, at + len(k)))
        out.append(Template(words, label, spans, base, len(words) // 8 if len(words) >= 24 else 0))
    return out


class Index:
    def __init__(self, found: list[Template], df: dict[bytes, int], n_docs: int):
        self.templates = found
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for t in found for w in t.at}
        # a template's rarest mandatory word says cheaply that the file doesn't have it
        self.gates: dict[bytes, list[int]] = {}
        for k, t in enumerate(found):
            self.gates.setdefault(self.rarest(t.mandatory, 1)[0], []).append(k)

    def rarest(self, words, n: int) -> list[bytes]:
        return sorted(words, key=lambda w: (-self.idf[w], w))[:n]

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, and the best agreement."""
        places, base, labels, best = [], set(), set(), 0.0
        present = set(words)
        possible = [self.templates[k] for w in self.gates.keys() & present for k in self.gates[w] if self.templates[k].mandatory <= present]
        if not possible:
            return places, base, labels, best
        looked_up = [self.rarest(t.at.keys() & present, RARE) for t in possible]
        phrases = {words_[a] for t in possible for a, _ in t.phrases for words_ in (t.words,)}
        where: dict[bytes, list[int]] = {w: [] for w in phrases.union(*looked_up)}
        for i, w in enumerate(words):
            if w in where:
                where[w].append(i)
        for t, rare in zip(possible, looked_up, strict=True):
            for shift in self._shifts(t, rare, where):
                if not all(self._stands(t, a, z, shift, words, where) for a, z in t.phrases):
                    continue
                same = _agreement(t, shift, words)
                if t.base:
                    places.append(shift)
                    base.add(t.label)
                if t.base or same >= AGREE:
                    labels.add(t.label)
                    best = max(best, same)
        return places, base, labels, best

    @staticmethod
    def _shifts(t: Template, rare: list[bytes], where: dict[bytes, list[int]]) -> list[int]:
        """Shifts on which at least two of the words looked up (of a base phrase, all) agree, within the slack."""
        votes = sorted((i - p, k) for k, w in enumerate(rare) for i in where[w] for p in t.at[w])
        need = len(rare) if t.base else min(2, len(rare))
        out, lo, last = [], 0, None
        tally = [0] * len(rare)
        for shift, k in votes:
            tally[k] += 1
            while votes[lo][0] < shift - t.slack:
                tally[votes[lo][1]] -= 1
                lo += 1
            if sum(n > 0 for n in tally) >= need and (last is None or shift > last + t.slack):
                out.append(shift)
                last = shift
        return out

    @staticmethod
    def _stands(t: Template, a: int, z: int, shift: int, words: list[bytes], where: dict[bytes, list[int]]) -> bool:
        """Whether the phrase t.words[a:z] stands in the file about where the shift puts it."""
        at = where[t.words[a]]
        for i in at[bisect.bisect_left(at, shift + a - 2 * t.slack) : bisect.bisect_right(at, shift + a + 2 * t.slack)]:
            if words[i : i + z - a] == t.words[a:z]:
                return True
        return False


def _agreement(t: Template, shift: int, words: list[bytes]) -> float:
    """The share of the template's words that the file has in their order; words put in or left out move the rest by up to the slack."""
    same, n = 0, len(words)
    for j, w in enumerate(t.words):
        i = shift + j
        if 0 <= i < n and words[i] == w:
            same += 1
        elif t.slack:
            following = t.words[j : j + 3]
            for d in range(-t.slack, t.slack + 1):
                if 0 <= i + d < n and words[i + d] == w and words[i + d : i + d + 3] == following:
                    shift, same = shift + d, same + 1
                    break
    return same / len(t.words)


def frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all documents; the words are those of the templates."""
    wanted = frozenset(w for t in templates() for w in t.words)

    def run(batches):
        tally, n = dict.fromkeys(wanted, 0), 0
        for b in batches:
            n += b.num_rows
            for text in filled(b.column(0)):
                for w in wanted.intersection(words_of(text)):
                    tally[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in tally), ""]), pa.array([*tally.values(), n], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a licence word
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document. Null texts count as empty: no words, no labels (''), score 0. Repeated rows are all scanned.

    Texts of any length are scanned whole; an empty table gives no rows; other columns of docs are left aside. Base labels
    are always among the labels; the score is the greatest share of a found template's words.
    """
    index = Index(templates(), *frequencies(docs))

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in filled(b.column(1)):
                words = words_of(text)
                places, base, labels, best = index.scan(words)
                for column, x in zip(out, (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 6)), strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
