"""Machine dumps: JSON objects written one after the other without separator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from faultline.functions.names import col, pick
from faultline.functions.times import from_epoch_us
from faultline.session import settle

# The separator of concatenated objects, the invalid hex escape and its repair.
JOINT = "}{"
HEX_ESCAPE = r"(?<!\\)(?:\\{2})*\\x([0-9a-fA-F]{2})"
UNICODE_ESCAPE = r"\\u00$1"

_STAMP = "timestamp struct<`$date`: bigint>, sequence struct<`$numberLong`: string>"

# Fields of a raw record.
RECORD_SCHEMA = (
    "_id struct<`$oid`: string>, className string, machineId string, components array<struct<"
    "id: string, name: string, componentType: string, "
    f"samples: array<struct<id: string, name: string, type: string, subType: string, value: double, {_STAMP}>>, "
    f"events: array<struct<id: string, name: string, eventType: string, state: string, {_STAMP}>>, "
    f"conditions: array<struct<id: string, name: string, errorCode: double, message: string, status: string, {_STAMP}>>>>"
)
CATEGORIES = {"samples": ("value", "name", "type", "subType"), "events": ("state", "name", "eventType"),
              "conditions": ("errorCode", "name", "message", "status")}
CORRUPT = "_corrupt_record"


def repair_escapes(text: Column) -> Column:
    r"""``\xHH``, which JSON does not know, to ``\u00HH``."""
    return F.regexp_replace(text, HEX_ESCAPE, UNICODE_ESCAPE)


def read_fragments(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per object of (gzipped) dump files: (source_file, text).

    The joint between two objects is used as the line separator, so a file is streamed object by
    object; it is never held as one string. The separator takes a brace from either neighbour; both
    are put back. The last object of a file keeps its own closing brace, and the JSON reader
    ignores the extra one.
    """
    lines = spark.read.option("lineSep", JOINT).text(paths).select(F.col("_metadata.file_path").alias("source_file"), F.col("value"))
    opened = F.when(F.ltrim("value").startswith("{"), F.col("value")).otherwise(F.concat(F.lit("{"), F.col("value")))
    return lines.filter(F.length(F.trim("value")) > 0).select("source_file", repair_escapes(F.concat(opened, F.lit("}"))).alias("text"))


def split_objects(df: DataFrame, text: str, out: str = "text") -> DataFrame:
    """S2 on a text column that already holds concatenated objects: one row per object, with its position."""
    parts = F.split(col(text), r"(?<=\})(?=\{)")
    rest = [c for c in df.columns if c != text]
    exploded = df.select(*pick(rest), F.posexplode(parts).alias("position", "__part"))
    return exploded.select(*pick(rest), "position", repair_escapes(F.col("__part")).alias(out))


_SIGNS = r'"(?:[^"\\]++|\\.)*+"|([{}])'  # braces outside of strings


def trailing_text(text: Column) -> Column:
    """Whether something follows the object's closing brace, which the parser would ignore; one brace too many doesn't count.

    Braces are counted off: positive numbers are the depth, negative ones the braces from the closing one on.
    """
    signs = F.filter(F.regexp_extract_all(text, F.lit(_SIGNS), 1), lambda c: c != "")
    state = F.aggregate(signs, F.lit(0), lambda s, c: F.when(s < 0, s - 1).when(c == "{", s + 1).when(s == 1, F.lit(-1)).otherwise(s - 1))
    return ~(((state == -1) & text.rlike(r"\}\s*$")) | ((state == -2) & text.rlike(r"\}\s*\}\s*$")))


def parse_records(df: DataFrame, text: str = "text", schema: str = RECORD_SCHEMA, cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """S2 + S10: (records, quarantine). An object that does not parse, or that other text follows, does not stop the others.

    Texts that ``dumps.cut_files`` has ``cut`` end with their object and aren't looked through again.

    The parsed value passes through a one-element explode: the optimizer would otherwise copy the parser
    into the filter and into every field access and parse each text many times.
    """
    value = F.from_json(col(text), f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    parsed = df.select("*", F.explode(F.array(value)).alias("record"))
    bad = F.col(f"record.{CORRUPT}").isNotNull() | F.col("record").isNull()
    if not cut:
        bad = bad | trailing_text(col(text))
    return parsed.filter(~bad).drop(text), parsed.filter(bad).select(*pick(df.columns))


def _leaves(value: Column, dtype: T.DataType, path: Column) -> Column:
    """Array of (field, value) for everything below ``value``; list positions become name parts."""
    empty = F.array().cast("array<struct<field:string,value:string>>")
    if isinstance(dtype, T.StructType):
        inner = [_leaves(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in dtype.fields]
        return F.concat(*inner)
    if isinstance(dtype, T.ArrayType):
        nested = F.transform(value, lambda x, i: _leaves(x, dtype.elementType, F.concat(path, F.lit("."), i.cast("string"))))
        return F.coalesce(F.flatten(nested), empty)
    leaf = F.array(F.struct(path.alias("field"), value.cast("string").alias("value")))
    return F.when(value.isNotNull(), leaf).otherwise(empty)


def flatten_record(df: DataFrame, record: str = "record") -> DataFrame:
    """S3: long rows (…, field, value), nested keys joined by '.', list index as a key part."""
    fields = df.schema[record].dataType.fields
    cells = F.concat(*[_leaves(F.col(record).getField(f.name), f.dataType, F.lit(f.name)) for f in fields])
    rest = [c for c in df.columns if c != record]
    return df.select(*pick(rest), F.explode(cells).alias("__cell")).select(*pick(rest), "__cell.*")


def flatten_objects(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """S3 + S10 on JSON text of any fields: (long rows (…, field, value), quarantine).

    Level by level, so no schema names the fields. Every leaf is a row; a null has a null value, an empty object or list is
    ``{}`` or ``[]``. Text that isn't an object, that names a key twice, or that other text follows goes to the quarantine.
    """
    rest = [c for c in df.columns if c != text]
    parsed = df.select("*", F.explode(F.array(F.try_parse_json(col(text)))).alias("__v"))
    is_object = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT<"), F.lit(False))
    good = is_object & ~trailing_text(col(text))
    kind, shown = F.schema_of_variant("__v"), F.to_json("__v")
    inner = (kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~shown.isin("{}", "[]")
    value = F.when(kind == "VOID", None).when(kind == "STRING", F.col("__v").try_cast("string")).otherwise(shown)
    level = settle(parsed.filter(good).select(*pick(rest), F.lit(None).cast("string").alias("__field"), F.to_json("__v").alias("__text")), "objects")
    flat = None
    while True:
        spark = df.sparkSession
        below = level.withColumn("__v", F.parse_json("__text")).lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        name = F.concat_ws(".", "__field", F.coalesce("key", F.col("pos").cast("string")))
        cells = below.select(*pick(rest), name.alias("__field"), F.col("value").alias("__v"))
        cells = settle(cells.select(*pick(rest), "__field", inner.alias("__inner"), F.when(inner, shown).otherwise(value).alias("__text")), "fields")
        leaves = cells.filter("NOT __inner").select(*pick(rest), F.col("__field").alias("field"), F.col("__text").alias("value"))
        flat = leaves if flat is None else flat.unionByName(leaves)
        level = cells.filter("__inner").drop("__inner")
        if level.isEmpty():
            return flat, parsed.filter(~good | col(text).isNull()).select(*pick(df.columns))


def from_epoch_ms(ms: Column) -> Column:
    """Epoch milliseconds to a zone-less timestamp with whole seconds."""
    return from_epoch_us((ms - F.pmod(ms, F.lit(1000))) * F.lit(1000))


def convert_timestamps(df: DataFrame) -> DataFrame:
    """S4 on every integer column whose name contains 'timestamp'."""
    times = [f.name for f in df.schema.fields if "timestamp" in f.name and isinstance(f.dataType, (T.LongType, T.IntegerType))]
    return df.withColumns({c: from_epoch_ms(col(c)) for c in times})


def component_items(records: DataFrame, record: str = "record", keep: Sequence[str] = ()) -> DataFrame:
    """R1 + R2: one row per item of a component, named by ids instead of list positions.

    Columns: kept ones, machine_id, component_id, category, item_id, ts, seq, num_value, str_value and
    the remaining fields of the item. Components and items without an id fall out.
    """
    component = F.col("component")
    parts = records.select(*pick(keep), F.col(f"{record}.machineId").alias("machine_id"),
                           F.explode(F.col(f"{record}.components")).alias("component")).filter(component["id"].isNotNull())

    def field(item: Column, category: str, name: str) -> Column:
        return item[name].cast("string") if name in CATEGORIES[category] else F.lit(None).cast("string")

    def items(category: str) -> Column:
        numeric = {"samples": "value", "conditions": "errorCode"}.get(category)
        return F.transform(component[category], lambda x: F.struct(
            F.lit(category).alias("category"), x["id"].alias("item_id"),
            x["timestamp"]["$date"].alias("ms"), x["sequence"]["$numberLong"].alias("sequence"),
            (x[numeric] if numeric else F.lit(None)).cast("double").alias("num_value"),
            field(x, category, "state").alias("str_value"),
            field(x, category, "name").alias("name"), field(x, category, "message").alias("message"),
            field(x, category, "status").alias("status"),
        ))

    empty = F.array().cast("array<struct<category:string,item_id:string,ms:bigint,sequence:string,num_value:double,"
                           "str_value:string,name:string,message:string,status:string>>")
    every = F.concat(*[F.coalesce(items(c), empty) for c in CATEGORIES])
    rows = parts.select(*pick(keep), "machine_id", component["id"].alias("component_id"), F.explode(every).alias("item"))
    return rows.filter(F.col("item.item_id").isNotNull()).select(
        *pick(keep), "machine_id", "component_id", "item.category", "item.item_id",
        from_epoch_ms(F.col("item.ms")).alias("ts"), F.col("item.sequence").try_cast("double").alias("seq"),
        "item.num_value", "item.str_value", "item.name", "item.message", "item.status",
    )


def series_name(field: Column) -> Column:
    """components.<component>.<category>.<item>.<field>; digits and dots do not belong to a category."""
    category = F.regexp_replace("category", r"[0-9.]", "")
    return F.concat_ws(".", F.lit("components"), F.col("component_id"), category, F.col("item_id"), field)


def field_samples(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """R2 with every field that the name groups keep as a series of its own: the value, code or state of an item, and a
    condition's message and status. Fields without a value fall out."""
    nothing = F.lit(None).cast("string")
    number = F.when(F.col("category") == "samples", "value").when(F.col("category") == "conditions", "errorCode")
    cells = F.array(
        F.struct(number.alias("field"), F.col("num_value").alias("num"), nothing.alias("text")),
        *[F.struct(F.lit(name).alias("field"), F.lit(None).cast("double").alias("num"), F.col(source).alias("text"))
          for name, source in (("state", "str_value"), ("message", "message"), ("status", "status"))])
    used = F.filter(cells, lambda c: c["num"].isNotNull() | c["text"].isNotNull())
    rows = items.select("*", F.explode(used).alias("__cell"))
    return rows.select(*pick(keep), "machine_id", series_name(F.col("__cell.field")).alias("series"), "ts", "seq",
                       F.col("__cell.num").alias("num_value"), F.col("__cell.text").alias("str_value"))


def item_samples(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """R2 names on long rows, with the main field of each item: (machine_id, series, ts, seq, num_value, str_value)."""
    main = F.when(F.col("category") == "samples", "value").when(F.col("category") == "conditions", "errorCode").otherwise("state")
    return items.select(*pick(keep), "machine_id", series_name(main).alias("series"), "ts", "seq", "num_value", "str_value")


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated column names get the suffix _1, _2, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        count = seen.get(name, 0)
        out.append(name if count == 0 else f"{name}_{count}")
        seen[name] = count + 1
    return out


def join_side_by_side(parts: Sequence[DataFrame], keys: Sequence[str], expected: int | None = None) -> DataFrame:
    """Parts joined on their keys; repeated names numbered; raises when columns were lost."""
    names = unique_names([c for p in parts for c in p.columns if c not in keys])
    at, joined = 0, None
    for part in parts:
        own = [c for c in part.columns if c not in keys]
        renamed = part.select(*pick(keys), *[col(c).alias(names[at + i]) for i, c in enumerate(own)])
        at += len(own)
        joined = renamed if joined is None else joined.join(renamed, list(keys), "full")
    if expected is not None and len(joined.columns) < expected:
        raise ValueError(f"columns are not consistent, {expected - len(joined.columns)} were lost")
    return joined
