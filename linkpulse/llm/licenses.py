"""License scans: every text block that contains enough of a license template's words.

An exact set-similarity join of text blocks with templates. Blocks are the lines, the paragraphs (lines without a blank
one between them, so hard-wrapped notices are whole), and, across blank lines, all runs of `SPAN` times as many words as
the template has. A block matches a template when it holds at least `CONTAINMENT` percent of the template's distinct
words. A paragraph or run is reported where it holds more than each matching block inside it. The words of all templates are put
in the order of their frequency in the whole corpus, rare ones first. Then

- prefix: a match must hold one of the template's first (size - needed + 1) words, so only blocks with such a word
  are looked at, through an index from word to templates;
- length: a block with fewer distinct words than needed can't match;
- positions: words of the template before the first one that the block holds are lost; if too few remain, it can't match.

The filters are applied to the whole text first, which holds all its blocks, then to each block. A run needs no filter of
its own: one with enough words holds a prefix word. What passes is counted in full. Templates are a parameter, bounded by `MOST_TEMPLATE_WORDS` words in all (an error beyond), so
their index goes with the tasks and blocks need no shuffle, whatever their number or skew.

Besides, fixed phrases are found word by word; each carries a label of its own.

Defined results: null and empty texts have no words, labels or places, and score 0. Repeated rows get equal results.
An empty table gives an empty result. Templates equal in words share their matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .words import flat

#: Phrases and the labels they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short public notices, in this project's own choice.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
CONTAINMENT = 90
#: Words of a run across blank lines, as a multiple of the template's.
SPAN = 2
MOST_TEMPLATE_WORDS = 200_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _span in (range(48, 58), range(97, 123)):
    _FOLD[list(_span)] = list(_span)
_FOLD[65:91] = np.arange(97, 123)
FOLD = _FOLD.tobytes()
_FOLD_LINES = _FOLD.copy()
_FOLD_LINES[10] = 10
FOLD_LINES = _FOLD_LINES.tobytes()


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return raw.translate(FOLD).split()


def template_words(templates: Mapping[str, str]) -> dict[str, frozenset[bytes]]:
    out = {name: frozenset(words_of(text.encode())) for name, text in templates.items()}
    if sum(map(len, out.values())) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates may have {MOST_TEMPLATE_WORDS} distinct words in all")
    return {name: words for name, words in out.items() if words}


def frequencies(docs: DataFrame, words: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each of the given words occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            data, at = flat(batch.column(0))
            raw = data.tobytes().translate(FOLD)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                total.update(filter(words.__contains__, raw[a:b].split()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["w", "n"]
        )

    rows = docs.select(text_of(docs, text).alias("text")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {r["w"].encode(): r["n"] for r in rows.collect()}


class TemplateIndex:
    """Templates in the corpus's order of words, with the prefixes that find them."""

    def __init__(self, templates: Mapping[str, str], frequency: Mapping[bytes, int], percent: int):
        self.names, self.ordered, self.needed, self.span = [], [], [], []
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}
        for name, words in sorted(template_words(templates).items()):
            ordered = sorted(words, key=lambda w: (frequency.get(w, 0), w))
            needed = -(-len(ordered) * percent // 100)
            for place, w in enumerate(ordered[: len(ordered) - needed + 1]):
                self.by_word.setdefault(w, []).append((len(self.names), place))
            self.names.append(name)
            self.ordered.append(ordered)
            self.needed.append(needed)
            self.span.append(SPAN * len(words_of(templates[name].encode())))
        self.first_words = frozenset(self.by_word)

    def matches(self, block: frozenset[bytes] | set[bytes]) -> dict[int, int]:
        """Templates that the block contains, with the number of their words it holds."""
        first: dict[int, int] = {}
        for w in self.first_words & block:
            for t, place in self.by_word[w]:
                first[t] = min(place, first.get(t, place))
        out = {}
        for t, place in first.items():
            ordered, needed = self.ordered[t], self.needed[t]
            if len(block) < needed or len(ordered) - place < needed:
                continue
            held = sum(w in block for w in ordered[place:])
            if held >= needed:
                out[t] = held
        return out

    def runs(self, words: list[bytes], t: int) -> list[tuple[int, int, int]]:
        """Where `span` words in a row hold enough of a template: first and last of its words there, and how many different.

        Of runs that overlap, the first of those that hold most.
        """
        wanted, out = set(self.ordered[t]), []
        hits = [i for i, w in enumerate(words) if w in wanted]
        inside: Counter[bytes] = Counter()
        left = 0
        for i in hits:
            inside[words[i]] += 1
            while i - hits[left] >= self.span[t]:
                w = words[hits[left]]
                inside[w] -= 1
                if not inside[w]:
                    del inside[w]
                left += 1
            if len(inside) >= self.needed[t]:
                run = (hits[left], i, len(inside))
                if not out or run[0] > out[-1][1]:
                    out.append(run)
                elif run[2] > out[-1][2]:
                    out[-1] = run
        return out

    def found(self, lines: list[list[bytes]], possible: Iterable[int]) -> list[tuple[int, int, int]]:
        """Matching blocks of a text: first line, template, words held. `possible`: the templates that the whole text matches."""
        out: list[tuple[int, int, int, int]] = []  # template, first line, last line, words held

        def add(first: int, last: int, t: int, held: int) -> None:
            if all(o[0] != t or o[1] > last or o[2] < first or o[3] < held for o in out):
                out.append((t, first, last, held))

        paragraphs: list[list[int]] = []
        for i, line in enumerate(lines):
            if not line:
                continue
            if i and lines[i - 1]:
                paragraphs[-1].append(i)
            else:
                paragraphs.append([i])
            if not self.first_words.isdisjoint(line):
                out.extend((t, i, i, held) for t, held in self.matches(set(line)).items())
        for p in paragraphs:
            if len(p) > 1:
                own = {w for i in p for w in lines[i]}
                if not own.isdisjoint(self.first_words):
                    for t, held in self.matches(own).items():
                        add(p[0], p[-1], t, held)
        if len(paragraphs) > 1:
            words = [w for line in lines for w in line]
            line_of = [i for i, line in enumerate(lines) for _ in line]
            paragraph_of = {i: k for k, p in enumerate(paragraphs) for i in p}
            for t in possible:
                for a, b, held in self.runs(words, t):
                    if paragraph_of[line_of[a]] != paragraph_of[line_of[b]]:
                        add(line_of[a], line_of[b], t, held)
        return sorted((first, t, held) for t, first, _, held in out)


_SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "blocks",
            T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("template", T.StringType()), T.StructField("containment", T.DoubleType())])),
        ),
    ]
)


def scan_text(raw: bytes, index: TemplateIndex, phrases: list[tuple[bytes, str]]) -> dict:
    """One text's phrase places, template matches by block, labels and score."""
    folded = raw.translate(FOLD_LINES)
    words = folded.split()
    places, base = [], set()
    joined = b" " + b" ".join(words) + b" "
    for phrase, label in phrases:
        at, counted, word = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)  # on from the last place: a long text is gone through once
            counted = at
            places.append(word)
            base.add(label)
            at = joined.find(phrase, at + 1)
    blocks, labels, score = [], set(base), 1.0 if base else 0.0
    if not index.first_words.isdisjoint(words) and (possible := index.matches(set(words))):
        for number, t, held in index.found([line.split() for line in folded.split(b"\n")], possible):
            share = held / len(index.ordered[t])
            blocks.append({"line": number, "template": index.names[t], "containment": share})
            labels.add(index.names[t])
            score = max(score, share)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "blocks": blocks,
    }


def _scan_udf(index: TemplateIndex, phrases: Mapping[str, str]):
    wanted = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]

    @F.arrow_udf(_SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        data, at = flat(texts)
        raw = data.tobytes()
        rows = [scan_text(raw[a:b], index, wanted) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        kind = pa.struct(
            [
                ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                ("blocks", pa.list_(pa.struct([("line", pa.int64()), ("template", pa.string()), ("containment", pa.float64())]))),
            ]
        )
        return pa.array(rows, kind)

    return scan


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, percent: int = CONTAINMENT
) -> DataFrame:
    """Per document: counts, first and last phrase place, labels, score and the matching `blocks` (first line, template, containment)."""
    every = frozenset().union(*template_words(templates).values()) if templates else frozenset()
    index = TemplateIndex(templates, frequencies(docs, every), percent)
    return docs.select("doc_id", _scan_udf(index, phrases)(text_of(docs)).alias("x")).select("doc_id", "x.*")
