"""Quality rules from tokeniser fertility, beside simple counts of words, symbols and repetition.

A public sentencepiece vocabulary with byte fallback encodes every word. Per document: characters per token, the share
of byte-fallback tokens, and the entropy of the token distribution in bits. Each script has a band for them; text
outside its band is rejected. Prose stays well inside: the bands catch symbol soup and encoding damage (few
characters per token, many bytes), long unbroken junk, and a few tokens said over and over. Symbols and digits can cost as few tokens a character as rare prose, so texts with too few
letters, and those with too many symbols between their words, are told by their characters and rejected whatever their
script.

Whole texts count, each by itself. Nulls count as empty: all counts are 0, measures are null, and the document is
rejected as too short. Repeated rows give equal results, further columns are not read, an empty table gives an empty
result. Words, lines and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from faultline.llm import lexing


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, least entropy (bits) of long texts."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: First and last code point of the blocks of each script; letters elsewhere count as "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)), "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
BANDS = {
    "latin": Band(1.6, 9.0, 0.2, 4.0), "greek": Band(0.8, 6.0, 0.5, 4.0), "cyrillic": Band(1.0, 8.0, 0.3, 4.0),
    "hebrew": Band(0.5, 6.0, 0.7, 3.5), "arabic": Band(0.5, 6.0, 0.7, 3.5), "devanagari": Band(0.4, 6.0, 0.9, 3.0),
    "thai": Band(0.3, 6.0, 0.9, 3.0), "hangul": Band(0.3, 4.0, 0.9, 3.0), "kana": Band(0.3, 4.0, 0.9, 3.0),
    "han": Band(0.3, 4.0, 0.9, 3.0), "other": Band(0.2, 9.0, 1.0, 3.0),
}
#: Texts of fewer tokens can't show a low entropy reliably and pass that rule.
LONG_TOKENS = 100
MIN_WORDS = 50
#: Least share of letters and combining marks, and most of symbols, among the characters of words. A clean
#: sentence in fourteen languages measured 0.80 to 0.99 of letters alone (Hindi 0.61, without its marks), shouted text of
#: the given tables, with "!!" after each word, 0.59 at least.
LEAST_LETTERS = 0.55
MOST_SYMBOLS = 0.2
_NAMES = [*SCRIPTS, "other"]
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "n_letters", "n_odd")
_SALT = np.uint64(0xD6E8FEB86659FD93)


@cache
def _script_of() -> np.ndarray:
    table = np.full(0x110000, len(SCRIPTS), np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            table[lo: hi + 1] = i
    table[lexing.classes() != lexing.LETTER] = 255
    return table


@cache
def _kinds() -> np.ndarray:
    """1: letter or combining mark, 2: symbol other than the punctuation of prose, 0: all else."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        table[i] = 1 if kind[0] in "LM" else 2 if kind[0] == "S" or chr(i) in "#%&*@/\\_{}[]" else 0
    return table


@cache
def _symbols() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(b"#*$%&|<>")] = True
    return table


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive positions ``at``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def _key(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return lexing.mix(hashes + owner.astype(np.uint64) * _SALT)


class Meter:
    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.lexicon = lexing.Lexicon(self._pieces)

    def _pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(names, num_threads=1)
        lengths = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(lengths.sum())), lengths

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """All counts, the entropy and the script of the texts of a block."""
        import pandas as pd

        n_texts = len(offsets) - 1
        starts, ends, first = lexing.words(data, offsets)
        owner = np.repeat(np.arange(n_texts), np.diff(first))
        solid, lead = ~lexing._blank_bytes()[data], (data & 0xC0) != 0x80
        out = {"n_words": np.diff(first), "word_chars": _per_text(solid & lead, offsets), "n_symbols": _per_text(_symbols()[data], offsets)}

        breaks = data == 10
        head = breaks.copy()
        head[1:], head[:1] = breaks[:-1], False
        head[np.unique(offsets[offsets < len(data)])] = True
        line = np.flatnonzero(head)
        line_end = np.append(line[1:], len(data))[: len(line)]
        line_end = line_end - (breaks[line_end - 1] if len(line) else 0)
        line_owner = np.searchsorted(offsets, line, side="right") - 1
        held = np.zeros(len(data) + 1, np.int64)
        np.cumsum(solid, out=held[1:])
        full = held[line_end] > held[line]
        line, line_end, line_owner = line[full], line_end[full], line_owner[full]
        again = pd.Series(_key(line_owner, lexing.span_hashes(data, line, line_end))).duplicated().to_numpy()
        out["n_dup_lines"] = np.bincount(line_owner[again], minlength=n_texts)

        hashes = lexing.span_hashes(data, starts, ends)
        covered = np.zeros(len(starts), bool)
        if len(starts) > 2:
            whole = owner[2:] == owner[:-2]
            windows = lexing.mix(lexing.mix(hashes[:-2]) * np.uint64(3) + lexing.mix(hashes[1:-1] + np.uint64(1)) * np.uint64(5) + hashes[2:])
            where = np.flatnonzero(whole)
            codes, _ = pd.factorize(_key(owner[where], windows[where]))
            often = where[np.bincount(codes)[codes] >= 2] if len(codes) else where
            for k in range(3):
                covered[often + k] = True
        out["n_repeat_words"] = _per_text(covered, first)

        tokens, lengths = self.lexicon.values(self.lexicon.look_up(data, starts, ends))
        token_at = np.concatenate([[0], np.cumsum(lengths)])[first]
        n = np.diff(token_at)
        out["n_tokens"], out["n_byte_tokens"] = n, _per_text(self.is_byte[tokens], token_at)
        token_owner = np.repeat(np.arange(n_texts), n)
        codes, keys = pd.factorize(token_owner * self.size + tokens.astype(np.int64))
        counts = np.bincount(codes) if len(codes) else np.zeros(0, np.int64)
        weighted = np.bincount(keys // self.size, weights=counts * np.log2(counts), minlength=n_texts) if len(codes) else np.zeros(n_texts)
        out["entropy"] = np.where(n > 0, np.log2(np.maximum(n, 1)) - weighted / np.maximum(n, 1), 0.0)

        points, at = lexing.code_points(data, offsets)
        kinds = _kinds()[points]
        out["n_letters"], out["n_odd"] = _per_text(kinds == 1, at), _per_text(kinds == 2, at)
        script = _script_of()[points]
        letters = np.flatnonzero(script != 255)
        point_owner = np.repeat(np.arange(n_texts), np.diff(at))
        table = np.bincount(point_owner[letters] * len(_NAMES) + script[letters], minlength=n_texts * len(_NAMES)).reshape(n_texts, len(_NAMES))
        out["script"] = np.where(table.sum(axis=1) > 0, table.argmax(axis=1), len(_NAMES) - 1)
        return out


@cache
def meter(model_path: str) -> Meter:
    return Meter(model_path)


def measure(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts, ``entropy`` and ``script`` of each text."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches):
        own = meter(model_path)
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches):
            found = own.measure(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(lo, hi - lo), *(pa.array(found[c].astype(np.int64)) for c in _COUNTS),
                 pa.array(found["entropy"]), pa.array([_NAMES[s] for s in found["script"]], pa.string())],
                names=["key", *_COUNTS, "entropy", "script"])

    schema = T.StructType([T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in _COUNTS),
                           T.StructField("entropy", T.DoubleType()), T.StructField("script", T.StringType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def judge(measured: DataFrame, bands: dict[str, Band] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Add characters per token, byte share, ``base_failed``, the broken rule of the band (null: none), and ``kept``."""
    bands = bands or BANDS
    limits = F.create_map(*(x for name, b in bands.items() for x in (F.lit(name), F.struct(
        F.lit(b.least_chars).alias("lo"), F.lit(b.most_chars).alias("hi"), F.lit(b.most_bytes).alias("bytes"), F.lit(b.least_entropy).alias("bits")))))
    band = F.coalesce(limits[F.col("script")], limits[F.lit("other")])
    rule = (F.when(F.col("chars_per_token") < band["lo"], "too few characters per token")
            .when(F.col("chars_per_token") > band["hi"], "too many characters per token")
            .when(F.col("byte_share") > band["bytes"], "too many byte tokens")
            .when((F.col("n_tokens") >= LONG_TOKENS) & (F.col("entropy") < band["bits"]), "too low entropy")
            .when(F.col("n_letters") < LEAST_LETTERS * F.col("word_chars"), "too few letters")
            .when(F.col("n_odd") > MOST_SYMBOLS * F.col("word_chars"), "too many symbols"))
    tokens = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    return (measured.withColumn("chars_per_token", F.col("word_chars") / tokens).withColumn("byte_share", F.col("n_byte_tokens") / tokens)
            .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
            .withColumn("broken_rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("broken_rule").isNull()))
