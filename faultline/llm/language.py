"""Language identification by compression.

Each language has a raw-content zstandard dictionary: pieces of a bounded, hash-chosen sample of its labelled texts.
Texts are put in lower case with everything but letters of a word as one space, so that case, digits and symbols
don't decide. A text is encoded once per language in blocks of ``BLOCK`` bytes, each against the dictionary alone, and
the language with the smallest total wins. The score is how much larger the runner-up is (with two languages or more); texts
below ``margin`` are rejected, texts without a letter are ``und``.

The sample is the only bounded part: at most ``sample_docs`` labelled texts a language, one piece of ``PIECE`` bytes at a
hash-chosen place of each. Every text is then encoded whole. Ties go to the first language by code point. Null and
empty texts are ``und`` with score 0; rows without a language are not learned from; repeated rows give equal results;
further columns are not read; without any labelled row every text is ``und``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK = 2048
PIECE = 1024
SAMPLE_DOCS = 256
LEVEL = 3
#: A runner-up less than this much larger (as a share) leaves the language open.
MARGIN = 0.005
UNKNOWN = "und"


_SPACED = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """Lower-case UTF-8 with single spaces instead of ASCII characters that aren't letters."""
    return b" ".join(text.lower().encode().translate(_SPACED).split())


@dataclass(frozen=True)
class Profile:
    lang: str
    content: bytes


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, piece: int = PIECE, seed: int = 7) -> list[Profile]:
    """Dictionaries from ``doc_id``, ``text``, ``lang`` (null languages and blank texts are skipped).

    Of each language the texts with the smallest hashes are taken. A threshold from its count leaves about twice as
    many as are needed before any row is ranked, so that no window sees a whole language.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)).select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("draw")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not counts:
        return []
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2.0 * sample_docs + 32) / r["n"])))))
    near = usable.select("lang", "text", "doc_id", draw).filter(F.col("draw") <= share[F.col("lang")])
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).filter(F.col("rank") <= sample_docs)
    room = F.greatest(F.length("text") - piece + 1, F.lit(1))
    rows = ranked.select("lang", "rank", F.substring("text", F.pmod(F.xxhash64("doc_id"), room).cast("int") + 1, F.lit(piece)).alias("part")).collect()
    pieces: dict[str, list[tuple[int, str]]] = {}
    for row in rows:
        pieces.setdefault(row["lang"], []).append((row["rank"], row["part"]))
    return [Profile(lang, b" ".join(normalise(p) for _, p in sorted(found, reverse=True))) for lang, found in sorted(pieces.items())]


class Classifier:
    def __init__(self, profiles: list[Profile], level: int = LEVEL):
        import regex
        import zstandard

        self.langs = [p.lang for p in profiles]
        self.letter = regex.compile(r"\p{L}")
        self.compressors = []
        for profile in profiles:
            content = zstandard.ZstdCompressionDict(profile.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, list[int]]:
        """Language, score, and the encoded size per language."""
        if not self.langs or not text or not self.letter.search(text):
            return UNKNOWN, 0.0, []
        data = normalise(text)
        parts = [data[i: i + BLOCK] for i in range(0, max(1, len(data)), BLOCK)]
        sizes = [sum(len(c.compress(p)) for p in parts) for c in self.compressors]
        best = int(np.argmin(sizes))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best])
        return self.langs[best], min(1.0, (rest - sizes[best]) / max(rest, 1)), sizes


def classify(docs: DataFrame, profiles: list[Profile], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``id_col`` with ``lang_pred``, ``score``, ``rejected`` and the ``sizes`` by language."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    langs = [p.lang for p in profiles]

    def run(batches):
        own = Classifier(profiles)
        for batch in batches:
            found = [own.classify(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([list(zip(langs, x[2], strict=False)) for x in found], pa.map_(pa.string(), pa.int64()))],
                names=["key", "lang_pred", "score", "sizes"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("sizes", T.MapType(T.StringType(), T.LongType()))])
    return (source.mapInArrow(run, schema).withColumnRenamed("key", id_col)
            .withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < margin)))


def known(docs: DataFrame, profiles: list[Profile], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, in its columns."""

    def run(batches):
        own = Classifier(profiles)
        for batch in batches:
            found = [own.classify(t.as_py()) for t in batch.column(text_col)]
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= margin for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def held_out(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n
