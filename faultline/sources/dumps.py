"""Dump files read in one pass that survives damage.

A task inflates its file piece by piece and cuts the text at the braces that close an object, with the state of strings and
escapes kept from piece to piece; never more than one object and a piece are held. Every file gives its objects in order,
whatever else stands between them, and one row more if it ends early or is damaged, so that nothing is lost without trace.

An object that lacks its closing brace ends where a brace opens that no JSON can have there (after another closing brace, say).
If a missing quote hides those places, the text is cut at its joints instead, and the pieces that are whole objects are kept.

Files of the local or a mounted file system, and of any store that Arrow opens, are streamed; those of other stores come as the
content column of Spark's reader (at most 2 GB as compressed).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.sources.raw_json import repair_escapes

#: Bytes of a piece, and longest text that is held as one object.
PIECE, LONGEST = 1 << 20, 64 << 20
COLUMNS = "source_file string, position long, text string, problem string"

OUTSIDE = "text outside of objects"
FOLLOWED = "other text follows the object"
UNFINISHED = "the object does not end"
ENCODING = "not UTF-8"
EARLY = "the file ends early"

_TOKEN = re.compile(rb'(?s)[{}]|"(?:[^"\\]++|\\.)*+("?)')
_JOINT = re.compile(rb"(?<=\})(?=\{)")
_BLANK = b" \t\r\n"


class Damage(Exception):
    """The rest of a file can't be read."""


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The text of a gzip file of any number of members; a file without the mark of gzip is passed on as it is."""
    member, started, rest = None, False, b""
    for piece in pieces:
        rest += piece
        if not started and len(rest) < 2:
            continue
        if not started and rest[:2] != b"\x1f\x8b":
            yield rest
            rest = b""
            continue
        started = True
        while rest:
            if member is None:
                if len(rest) < 2:
                    break
                if rest[:2] != b"\x1f\x8b":
                    if not rest.strip(b"\0"):  # padding
                        rest = b""
                        break
                    raise Damage("no gzip data where a member should begin")
                member = zlib.decompressobj(31)
            before = member.copy()
            try:
                text = member.decompress(rest, PIECE)
            except zlib.error as error:
                yield _up_to_damage(before, rest)
                raise Damage(str(error)) from None
            if text:
                yield text
            if member.eof:
                rest, member = member.unused_data, None
            else:
                rest = member.unconsumed_tail
                if not rest and not text:
                    break
    while member is not None and not member.eof and rest:
        text, rest = member.decompress(rest, PIECE), member.unconsumed_tail
        yield text
    if member is not None:
        raise Damage(EARLY)
    if rest:
        if started:
            raise Damage(EARLY)
        yield rest


def _up_to_damage(member, data: bytes) -> bytes:
    """What a member gives, byte by byte, before it fails."""
    out = []
    try:
        for byte in range(len(data)):
            out.append(member.decompress(data[byte: byte + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def cut(pieces: Iterable[bytes], longest: int = LONGEST) -> Iterator[tuple[bytes, str | None]]:
    """(text, None) of every object and (text, what is wrong) of all else but blanks, in order."""
    text, at, start, depth, strays = b"", 0, None, 0, b""

    def pieces_of(broken: bytes) -> Iterator[tuple[bytes, str | None]]:
        held = b""
        for part in _JOINT.split(broken):
            if not _is_whole(part):
                held += part
                continue
            if held:
                yield held, UNFINISHED
                held = b""
            yield part, None
        if held:
            yield held, UNFINISHED

    for piece in pieces:
        text += piece
        while True:
            if start is None:
                opening = text.find(b"{", at)
                strays += text[at:] if opening < 0 else text[at:opening]
                if len(strays) > longest or opening >= 0:
                    if strays.strip(_BLANK):
                        yield strays.strip(_BLANK), OUTSIDE
                    strays = b""
                if opening < 0:
                    text, at = b"", 0
                    break
                start, at, depth = opening, opening + 1, 1
            ended = False
            for token in _TOKEN.finditer(text, at):
                sign = token.group()
                if sign == b"}":
                    depth -= 1
                    at = token.end()
                    if not depth:
                        yield text[start:at], None
                        start, ended = None, True
                        break
                elif sign == b"{":
                    before = text[start:token.start()].rstrip(_BLANK)[-1:]
                    if before in (b":", b"[", b","):
                        depth += 1
                    else:  # a new object begins before this one has ended
                        yield text[start:token.start()].rstrip(_BLANK), UNFINISHED
                        start, depth = token.start(), 1
                    at = token.end()
                elif not token.group(1):  # the string goes on in the next piece
                    break
                else:
                    at = token.end()
            if not ended:
                if start:
                    text, at, start = text[start:], at - start, 0
                if len(text) > longest:
                    yield from pieces_of(text)
                    text, at, start = b"", 0, None
                break
    if start is not None:
        yield from pieces_of(text[start:].rstrip(_BLANK))
    if strays.strip(_BLANK):
        yield strays.strip(_BLANK), OUTSIDE


def _is_whole(text: bytes) -> bool:
    depth = 0
    if not text.startswith(b"{"):
        return False
    for token in _TOKEN.finditer(text):
        sign = token.group()
        if sign in (b"{", b"}"):
            depth += 1 if sign == b"{" else -1
            if not depth:
                return token.end() == len(text)
        elif not token.group(1):
            return False
    return False


def followed(rows: Iterable[tuple[bytes, str | None]]) -> Iterator[tuple[bytes, str | None]]:
    """An object and the text outside of objects that follows it as one faulty row."""
    held = None
    for text, problem in rows:
        if problem == OUTSIDE and held is not None and held[1] in (None, FOLLOWED):
            held = (held[0] + b" " + text, FOLLOWED)
            continue
        if held is not None:
            yield held
        held = (text, problem)
    if held is not None:
        yield held


def _rows(pieces: Iterable[bytes], strict: bool) -> Iterator[tuple[str | None, str | None]]:
    damage: list[str] = []

    def readable() -> Iterator[bytes]:
        try:
            yield from inflated(pieces)
        except (Damage, OSError) as error:
            damage.append(str(error))

    found = cut(readable())
    for text, problem in followed(found) if strict else found:
        try:
            yield text.decode(), problem
        except UnicodeDecodeError:
            yield text.decode(errors="replace"), problem or ENCODING
    for reason in damage:
        yield None, reason


def _streamed(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as stream:
        while piece := stream.read(PIECE):
            yield piece


def arrow_opens(path: str) -> bool:
    """Whether Arrow knows the store of a path."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def cut_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of dump files: ``source_file``, ``position`` in it, ``text`` and ``problem``.

    ``files`` has ``path`` and, where its store can't be streamed, ``content``. Objects have no problem; a null text is the row
    of a file that ends early or is damaged. Where ``strict``, an object that other text follows is one faulty row with that
    text; otherwise both are rows of their own. Null paths and contents give no rows.
    """
    columns = [c for c in ("path", "content") if c in files.columns]

    def run(batches):
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                content = batch.column(1)[i].as_py() if len(columns) == 2 else None
                if path is None or (len(columns) == 2 and content is None):
                    continue
                pieces = _streamed(path) if content is None else (content[at: at + PIECE] for at in range(0, len(content), PIECE))
                held, size, position = [], 0, 0
                for text, problem in _rows(pieces, strict):
                    held.append((path, position, text, problem))
                    position, size = position + 1, size + len(text or "")
                    if size > PIECE:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    rows = files.select(*columns).mapInArrow(run, COLUMNS)
    return rows.withColumn("text", F.when(F.col("problem").isNull(), repair_escapes(F.col("text"))).otherwise(F.col("text")))


def _batch(rows: list[tuple[str, int, str | None, str | None]]) -> pa.RecordBatch:
    source, position, text, problem = (list(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(position, pa.int64()), pa.array(text, pa.string()), pa.array(problem, pa.string())],
                                      names=["source_file", "position", "text", "problem"])


def read_dumps(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """``cut_files`` over files, folders or patterns; each file is one task's work and is read once."""
    listed = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    first = listed.select("path").first()
    streamed = first is None or arrow_opens(first["path"])
    files = listed.select("path") if streamed else listed.select("path", "content")
    return cut_files(files.repartition(F.col("path")) if streamed else files, strict)
