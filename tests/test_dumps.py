"""Dump files with every kind of damage: what is whole is kept, all else is reported."""

from __future__ import annotations

import gzip
import json
import random

import pytest

from faultline.plans import prediction
from faultline.sources import dumps, raw_json


def pieces(data: bytes, size: int):
    return [data[at: at + size] for at in range(0, len(data), size)]


def cut(text: str, size: int = 7, **options):
    return [(t.decode(), p) for t, p in dumps.cut(pieces(text.encode(), size), **options)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_cutting(size):
    assert cut('{"id":1},{"id":2}', size) == [('{"id":1}', None), (",", dumps.OUTSIDE), ('{"id":2}', None)]
    assert cut('{"id":3}] junk {"id":4}', size) == [('{"id":3}', None), ("] junk", dumps.OUTSIDE), ('{"id":4}', None)]
    assert cut('{"id":6}, junk', size) == [('{"id":6}', None), (", junk", dumps.OUTSIDE)]
    assert cut(' \n{"a":"}{ \\" {"}\t{"b":[{"c":{}},{"d":"é\\\\"}]} ', size) == [('{"a":"}{ \\" {"}', None), ('{"b":[{"c":{}},{"d":"é\\\\"}]}', None)]
    assert cut('{"a":{"b":1}{"c":2}{"d":3', size) == [('{"a":{"b":1}', dumps.UNFINISHED), ('{"c":2}', None), ('{"d":3', dumps.UNFINISHED)]
    assert cut('{"a":"x}{"b":2}{"c":3}', size)[-1] == ('{"c":3}', None)  # a quote is missing
    assert cut('junk "with a quote {"a":1}} ', size) == [('junk "with a quote', dumps.OUTSIDE), ('{"a":1}', None), ("}", dumps.OUTSIDE)]
    assert cut("", size) == [] and cut(" \n ", size) == []
    assert list(dumps.followed(iter([(b"{}", None), (b"x", dumps.OUTSIDE), (b"{}", None)]))) == [(b"{} x", dumps.FOLLOWED), (b"{}", None)]


def test_cutting_equals_parser():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth < 4 else 3)
        if kind < 3:
            return (rng.randrange(9), "".join(rng.choice('ab{}[]"\\, é') for _ in range(rng.randrange(6))), None)[kind]
        if kind == 3:
            return {f"k{i}": value(depth + 1) for i in range(rng.randrange(4))}
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {"x": value(depth + 1)}

    objects = [json.dumps({"v": value(0)}, ensure_ascii=rng.random() < 0.5) for _ in range(500)]
    assert cut("".join(objects), 13) == [(o, None) for o in objects]
    # one object of ten loses its last brace: only those are lost
    broken = [o[:-1] if i % 10 == 0 else o for i, o in enumerate(objects)]
    assert [t for t, p in cut("".join(broken), 64) if p is None] == [o for i, o in enumerate(objects) if i % 10]


def test_a_text_without_end_is_bounded():
    text = '{"a":"' + "x" * 5_000 + '{"id":1}{"id":2}'
    found = cut(text, 100, longest=1_000)
    assert len(found) >= 5 and sum(len(t) for t, _ in found) >= len(text) - 10


def read(data: bytes, size: int = 50, strict=False):
    return list(dumps._rows(pieces(data, size), strict))


def test_inflating():
    objects = [json.dumps({"id": i, "text": f"{i * 7919 % 1009:x}" * 20}) for i in range(300)]
    whole = gzip.compress("".join(objects).encode())
    assert read(whole) == [(o, None) for o in objects]
    assert read(b"".join(gzip.compress(o.encode()) for o in objects)) == [(o, None) for o in objects]  # a member for each
    assert read("".join(objects).encode()) == [(o, None) for o in objects]  # not compressed at all
    early = read(whole[: len(whole) // 2])
    assert early[-1] == (None, dumps.EARLY) and early[-2][1] == dumps.UNFINISHED and [t for t, p in early if p is None] == objects[: len(early) - 2] and len(early) > 50
    assert read(whole[:-3]) == [(o, None) for o in objects] + [(None, dumps.EARLY)]  # the check sum is cut off
    harmed = bytearray(whole)
    harmed[-6] ^= 0xFF
    assert read(bytes(harmed))[-1][0] is None and read(bytes(harmed))[:-1] == [(o, None) for o in objects]
    members = gzip.compress(b'{"a":1}') + b"no gzip" + gzip.compress(b'{"a":2}')
    assert [t for t, _ in read(members)] == ['{"a":1}', None]
    assert read(b"") == [] and read(gzip.compress(b"")) == [] and read(gzip.compress(b'{"a":"\xff"}'))[0][1] == dumps.ENCODING


def test_large_member_is_inflated_in_pieces():
    text = b'{"a":"' + b"x" * (9 << 20) + b'"}'
    sizes = [len(p) for p in dumps.inflated([gzip.compress(text)])]
    assert sum(sizes) == len(text) and max(sizes) <= dumps.PIECE


@pytest.mark.parametrize("with_content", [False, True])
def test_files_are_read_once_and_damage_is_reported(spark, tmp_path, with_content):
    text = "".join(f'{{"id":{i},"name":"\\x41 {i * 7919 % 100003}"}}' for i in range(400)).encode()
    (tmp_path / "a.gz").write_bytes(gzip.compress(text))
    (tmp_path / "b.gz").write_bytes(gzip.compress(text)[: -1000])
    (tmp_path / "c.gz").write_bytes(gzip.compress(b'{"id":1},{"id":2} tail'))
    (tmp_path / "d.gz").write_bytes(b"")
    if with_content:
        rows = dumps.cut_files(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"), strict=False)
    else:
        rows = dumps.read_dumps(spark, str(tmp_path), strict=False)
    got = {}
    for r in rows.orderBy("source_file", "position").collect():
        got.setdefault(r["source_file"].rsplit("/", 1)[1], []).append((r["text"], r["problem"]))
    assert len(got["a.gz"]) == 400 and got["a.gz"][1] == ('{"id":1,"name":"\\u0041 7919"}', None)
    assert got["b.gz"][-1] == (None, dumps.EARLY) and 50 < len(got["b.gz"]) < 400
    assert got["c.gz"] == [('{"id":1}', None), (",", dumps.OUTSIDE), ('{"id":2}', None), ("tail", dumps.OUTSIDE)] and "d.gz" not in got
    good, bad = raw_json.parse_records(rows.filter("problem IS NULL"), schema="id bigint, name string", cut=True)
    assert bad.count() == 0 and good.count() == 400 + len(got["b.gz"]) - 2 + 2


def test_the_job_keeps_what_stands_before_the_damage(spark, tmp_path):
    stamp = {"sequence": {"$numberLong": "1"}}
    record = lambda v, s: json.dumps({"machineId": "Integrex", "components": [{"id": "c", "samples": [{"id": "load", "value": v, "timestamp": {"$date": 1000 * s}, **stamp}]}]})
    (tmp_path / "a.gz").write_bytes(gzip.compress((record(1.0, 1) + " tail").encode()))
    (tmp_path / "b.gz").write_bytes(gzip.compress(record(2.0, 2).encode()) + gzip.compress(record(3.0, 3).encode())[:-4])
    (tmp_path / "c.gz").write_bytes(gzip.compress(b'{"machineId":"Integrex","components":[{"id":7}]}]{"machineId":1,"components":"none"}'))
    samples, bad = prediction.extract(spark, str(tmp_path), "Integrex", keep_before_damage=True)
    assert sorted(r["num_value"] for r in samples.collect()) == [1.0, 2.0, 3.0]
    assert sorted((r["source_file"].rsplit("/", 1)[1], r["text"] or "-", r["reason"]) for r in bad.select("source_file", "text", "reason").collect()) == [
        ("a.gz", "tail", dumps.OUTSIDE), ("b.gz", "-", dumps.EARLY), ("c.gz", "]", dumps.OUTSIDE), ("c.gz", '{"machineId":1,"components":"none"}', "no record")]
    samples, bad = prediction.extract(spark, str(tmp_path), "Integrex")
    assert samples.count() == 0 and {r["source_file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.gz", "b.gz", "c.gz"}


def test_objects_after_the_outermost_brace_are_not_lost(spark):
    rows = [(1, '{"id":1},{"id":2}'), (2, '{"id":3}] junk {"id":4}'), (3, '{"id":6}, junk'), (4, '{"id":7}],[{"id":8}'), (5, '{"id":9}}'), (6, '{"id":10,"name":"}, {"}'),
            (7, ' {"id":11} \n'), (8, None), (9, ""), (10, '{"id":12} } '), (11, '{"id":13}}}'), (12, '{"id":14}},')]
    df = spark.createDataFrame(rows, "n long, text string")
    good, bad = raw_json.parse_records(df, schema="id bigint, name string")
    assert sorted(r["n"] for r in good.collect()) == [5, 6, 7, 10] and sorted(r["n"] for r in bad.collect()) == [1, 2, 3, 4, 8, 9, 11, 12]
    flat, bad = raw_json.flatten_objects(df)
    assert {r["n"] for r in flat.collect()} == {5, 6, 7, 10} and bad.count() == 8
