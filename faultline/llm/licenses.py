"""Fuzzy search for short licence notices.

Texts are normalised to lower-case words with single spaces. A notice of ``k`` allowed edits is split into ``k + 1``
pieces, of which at least one stands unchanged in every text within ``k`` edits of it (pigeonhole). One
Aho-Corasick pass over the pieces of all notices gives candidate places; there the regex library matches the notice
with bounded errors, which counts the edits and gives the span. A place without edits between word boundaries is
an exact one.

Each text is searched whole and by itself: nulls count as empty and have no places, repeated rows give equal
results, further columns are not read, and an empty table gives an empty result. Where several notices or several
offsets of one notice match with errors at the same word, each notice keeps its best span that starts there (fewest
edits, then shortest).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from faultline.llm import lexing


@dataclass(frozen=True)
class Notice:
    """A phrase in normalised words, and whether it is one of the base phrases."""

    label: str
    phrase: str
    base: bool = False

    @property
    def edits(self) -> int:
        """One edit per ten characters; none in phrases below ten, where an edit makes another phrase."""
        return min(4, len(self.phrase) // 10)


#: Names of the four base phrases, then sentences that stand in the notices of common licences.
NOTICES = (
    Notice("gpl", "gnu general public license", True), Notice("apache", "apache license", True),
    Notice("cc-by", "cc by", True), Notice("mit", "mit license", True),
    Notice("apache", "licensed under the apache license version 2 0"),
    Notice("agpl", "gnu affero general public license"), Notice("lgpl", "gnu lesser general public license"),
    Notice("mpl", "mozilla public license"), Notice("epl", "eclipse public license"), Notice("isc", "isc license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification"),
    Notice("cc-by", "creative commons attribution"), Notice("cc0", "creative commons zero"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    Notice("reserved", "all rights reserved"),
)

PLACES = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("base", T.BooleanType()),
    T.StructField("edits", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("matched", T.StringType())]), False)


@cache
def _normal_bytes() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


def pieces(phrase: str, n: int) -> list[tuple[int, str]]:
    """``n`` pieces of about equal length with their offsets."""
    cuts = [round(i * len(phrase) / n) for i in range(n + 1)]
    return [(lo, phrase[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


class Searcher:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, piece in pieces(f" {notice.phrase} ", notice.edits + 1):
                seeds.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?= )") if n.edits else None for n in notices]

    def search(self, data: bytes) -> tuple[int, list[dict]]:
        """Number of words, and the places of notices in one text."""
        tokens = data.translate(_normal_bytes()).split()
        text = f" {b' '.join(tokens).decode()} " if tokens else ""
        found: dict[tuple[int, int], tuple[int, int]] = {}  # (notice, start) -> (edits, end)
        loose: dict[int, set[int]] = {}
        for last, (length, owners) in self.seeds.iter(text):
            for i, offset in owners:
                start, phrase = last - length + 1 - offset, self.notices[i].phrase
                if start >= 0 and text.startswith(f" {phrase} ", start):
                    found[i, start + 1] = (0, start + 1 + len(phrase))
                elif self.notices[i].edits:
                    loose.setdefault(i, set()).add(start + 1)
        for i, starts in loose.items():
            notice, upto = self.notices[i], -1
            for start in sorted(starts):
                if start <= upto:
                    continue
                # the match of this place lies within the edits around it; a run of places is searched as one window
                upto = start
                while any(s in starts for s in range(upto + 1, upto + notice.edits + 2)):
                    upto = max(s for s in range(upto + 1, upto + notice.edits + 2) if s in starts)
                lo, hi = max(0, start - notice.edits - 1), min(len(text), upto + len(notice.phrase) + notice.edits + 1)
                for m in self.patterns[i].finditer(text, lo, hi, overlapped=True):
                    key, value = (i, m.start()), (sum(m.fuzzy_counts), m.end())
                    if m.end() > m.start() and text[m.start()] != " " and text[m.end() - 1] != " " and value < found.get(key, (99, 0)):
                        found[key] = value
        exact = [(s, e) for (_, s), (k, e) in found.items() if k == 0]
        places = [(s, e, i, k) for (i, s), (k, e) in found.items()
                  if k == 0 or not any(s < e2 and s2 < e for s2, e2 in exact)]  # an exact place explains what overlaps it
        return len(tokens), [self._place(data, text, *p) for p in sorted(places)]

    def _place(self, data: bytes, text: str, start: int, end: int, i: int, edits: int) -> dict:
        notice, word = self.notices[i], text.count(" ", 0, start) - 1
        return {"label": notice.label, "phrase": notice.phrase, "base": notice.base and edits == 0, "edits": edits, "word": word,
                "n_words": text.count(" ", start, end) + 1, "matched": text[start:end]}

    def spans(self, data: bytes, places: list[dict]) -> None:
        """Add each place's span of characters in the original text."""
        if not places:
            return
        blank, bounds, inside = data.translate(_normal_bytes()), [], False
        for at, byte in enumerate(blank):
            if (byte != 32) != inside:
                bounds.append(at)
                inside = not inside
        if inside:
            bounds.append(len(blank))
        for place in places:
            lo, hi = bounds[2 * place["word"]], bounds[2 * (place["word"] + place["n_words"] - 1) + 1]
            place["start"], place["end"] = len(data[:lo].decode()), len(data[:hi].decode())


@cache
def searcher(notices: tuple[Notice, ...]) -> Searcher:
    return Searcher(notices)


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words`` and ``places``: label, phrase, edits, first word, number of words, characters from
    ``start`` to ``end`` of the original text, and the normalised text that matched. ``base`` marks exact base phrases."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches):
        own, places_type = searcher(notices), None
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches):
            n_words, places = [], []
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n, found = own.search(raw[a:b])
                own.spans(raw[a:b], found)
                n_words.append(n)
                places.append(found)
            places_type = places_type or pa.list_(pa.struct([
                ("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("word", pa.int64()),
                ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(places, places_type)],
                                             names=["key", "n_words", "places"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("n_words", T.LongType()), T.StructField("places", PLACES)])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def summarise(found: DataFrame, *keep: str) -> DataFrame:
    """One row per text: counts and first and last word of base places, labels, and the best likeness of a notice."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    likeness = F.transform("places", lambda p: 1 - p["edits"] / F.length(p["phrase"]))
    return found.select(
        *keep, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"))


