"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice of m characters with at most k edits, split into k+1 pieces, keeps at least one piece whole; plain searches for
the pieces locate the candidates, and the regular expression library's bounded-error matching verifies each, counts its
edits and gives its span.  The word that names the license may have none: three edits make any short name of another.  Both work on a normal form of the text: lower-cased words joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import _LOWER, Words, split_words, steps
from .common import documents, mapped

#: Phrases of the base and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    name: str = ""
    """The word that names the license and must stand as it is; empty where the wording itself tells it."""


#: Short notices in normal form, the edits allowed, the word that must be exact.
NOTICES = (
    Notice("licensed under the gnu general public license", "gpl", 4, "gnu"),
    Notice("gnu general public license", "gpl", 3, "gnu"),
    Notice("released under the gpl license", "gpl", 3, "gpl"),
    Notice("gnu lesser general public license", "lgpl", 3, "lesser"),
    Notice("gnu affero general public license", "agpl", 3, "affero"),
    Notice("licensed under the apache license version 2 0", "apache", 4, "apache"),
    Notice("apache license version 2 0", "apache", 3, "apache"),
    Notice("released under the mit license", "mit", 3, "mit"),
    Notice("licensed under the mit license", "mit", 3, "mit"),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("released under the bsd license", "bsd", 3, "bsd"),
    Notice("licensed under the bsd license", "bsd", 3, "bsd"),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("released under the isc license", "isc", 3, "isc"),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", 1, "nc"),
    Notice("licensed under cc by sa 4 0", "cc-by-sa", 1, "sa"),
    Notice("licensed under cc by 4 0", "cc-by", 1, "by"),
    Notice("creative commons attribution", "cc-by", 3, "attribution"),
    Notice("mozilla public license", "mpl", 2, "mozilla"),
    Notice("eclipse public license", "epl", 2, "eclipse"),
    Notice("boost software license", "bsl", 2, "boost"),
    Notice("free and unencumbered software released into the public domain", "unlicense", 6),
)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
_SEP = ~_WORD


def pieces(notice: Notice) -> list[tuple[int, bytes]]:
    """The notice in edits+1 pieces of nearly equal length, with their places."""
    raw, n = notice.text.encode(), notice.edits + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=None)
def matcher(notice: Notice):
    import regex

    return regex.compile(b"(?b)(?:" + regex.escape(notice.text.encode()) + b"){e<=%d}" % notice.edits)


def normal_form(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts' words, lower-cased and joined by spaces; the texts' offsets in that; each word's start in it."""
    keep = ~_SEP[w.raw]
    low = np.where(keep, _LOWER[w.raw], 0x20).astype(np.uint8)
    gap = w.end[w.end < len(w.raw)]
    keep[gap[_SEP[w.raw[gap]]]] = True
    place = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return low[keep].tobytes(), place[w.text_at], place[w.start]


def find_all(hay: bytes, needle: bytes) -> list[int]:
    found, at = [], hay.find(needle)
    while at >= 0:
        found.append(at)
        at = hay.find(needle, at + 1)
    return found


def named(notice: Notice, hay: bytes, start: int, end: int, low: int, high: int) -> bool:
    """Whether the words that a stretch touches, in its document from ``low`` to ``high``, include the notice's name."""
    if not notice.name:
        return True
    stop = hay.find(b" ", end, high)
    return notice.name.encode() in hay[max(low, hay.rfind(b" ", low, start) + 1) : high if stop < 0 else stop].split(b" ")


def fuzzy(hay: bytes, at: np.ndarray, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, str, float]]:
    """(document, start, end, label, likeness) of the notices in a normal form with its documents at ``at``."""
    found = set()
    for notice in notices:
        m, k, seen = len(notice.text), notice.edits, {}
        for offset, piece in pieces(notice):
            for hit in find_all(hay, piece):
                doc = int(np.searchsorted(at, hit, "right")) - 1
                if hit + len(piece) > at[doc + 1]:
                    continue  # it runs over into the next document
                seen.setdefault((doc, hit - offset), None)
        last = None
        for doc, start in sorted(seen):
            a, b = max(int(at[doc]), start - k), min(int(at[doc + 1]), start + m + k)
            if last and last[0] == doc and a >= last[1] and b <= last[2]:
                continue
            x = matcher(notice).search(hay, a, b)
            if x and named(notice, hay, x.start(), x.end(), int(at[doc]), int(at[doc + 1])):
                found.add((doc, x.start() - int(at[doc]), x.end() - int(at[doc]), notice.label, 1 - sum(x.fuzzy_counts) / m))
                last = (doc, x.start(), x.end())
    return sorted(found)


def exact(w: Words, hay: bytes, word_at: np.ndarray, phrases=PHRASES) -> list[tuple[int, int, str]]:
    """(document, word, label) of every place where a phrase's words stand consecutively."""
    found, ends = [], word_at + (w.end - w.start)
    for phrase, label in phrases:
        n = phrase.count(" ") + 1
        for hit in find_all(hay, phrase.encode()):
            i = int(np.searchsorted(word_at, hit))
            if i < len(word_at) and word_at[i] == hit and ends[i + n - 1] == hit + len(phrase):
                doc = int(np.searchsorted(w.at, i, "right")) - 1
                if i + n <= w.at[doc + 1]:
                    found.append((doc, i - int(w.at[doc]), label))
    return found


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,score:double>>"


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, phrases=PHRASES) -> DataFrame:
    """doc_id and the findings of every row; spans are byte offsets in the normal form.

    Null and empty texts have no words and no labels; rows with equal ids are scanned each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                n = batch.num_rows
                w = split_words(batch.column("text"), _SEP)
                hay, at, word_at = normal_form(w)
                base: list[list] = [[] for _ in range(n)]
                more: list[list] = [[] for _ in range(n)]
                for doc, word, label in exact(w, hay, word_at, phrases):
                    base[doc].append((word, label))
                for doc, a, b, label, score in fuzzy(hay, at, notices):
                    more[doc].append({"start": a, "end": b, "label": label, "score": score})
                places = [[p for p, _ in x] for x in base]
                names = [{x for _, x in b} for b in base]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(w.at).astype(np.int64)), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                     pa.array([",".join(sorted(x)) for x in names], pa.string()), pa.array([",".join(sorted(x | {s["label"] for s in m})) for x, m in zip(names, more, strict=True)], pa.string()),
                     pa.array([1.0 if p else max((s["score"] for s in m), default=0.0) for p, m in zip(places, more, strict=True)], pa.float64()),
                     pa.array(more, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())])))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return mapped(docs.select("doc_id", "text"), scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


QUERIES = {"op9_license_scans": op9_license_scans}
