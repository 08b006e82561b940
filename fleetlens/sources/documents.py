"""Configuration documents, state snapshots, marker and lock files (SRC1-SRC4).

One folder per cluster holds its documents: ``<root>/<cluster>/config.yaml``,
``state.json`` and marker files.  The folder name is the cluster's name on its
controller.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.times import parse_rfc3339
from fleetlens.schemas import CONFIG, STATE
from fleetlens.sources.listing import list_folders

# The placeholder password of the sample documents, and the names
# of the marker files.
PASSWORD_PLACEHOLDER = "YOUR_HMC_PASSWORD"
MARKERS = {"managed": ".managed", "failed": ".failed", "deleted": ".deleted", "locked": ".lock"}


def folder_of(path: Column, up: int = 1) -> Column:
    return F.element_at(F.split(path, "/"), F.lit(-1 - up))


# Plain words for null, and words that a yes-or-no field takes.
NULLS = ("", "~", "null", "Null", "NULL")
YES, NO = ("y", "yes", "on", "true"), ("n", "no", "off", "false")


@functools.cache
def _loader():
    """Scalars stay as written (``4.20``, ``010``, ``on``, ``10:20:30``); only null and merge keys are told apart."""
    import yaml

    class Plain(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    plain = {text: "tag:yaml.org,2002:null" for text in NULLS} | {"<<": "tag:yaml.org,2002:merge"}

    def resolve(self, kind, value, implicit):
        """The resolver's own rules for null and merge alone, looked up instead of matched."""
        if kind is yaml.ScalarNode:
            return plain.get(value, self.DEFAULT_SCALAR_TAG) if implicit[0] else self.DEFAULT_SCALAR_TAG
        return self.DEFAULT_SEQUENCE_TAG if kind is yaml.SequenceNode else self.DEFAULT_MAPPING_TAG

    Plain.resolve = resolve
    return Plain


def _check(node, above: set[int], done: set[int]) -> None:
    """Refuse keys given twice and anchors that contain themselves.  Scalars, most of all nodes, are not visited."""
    if id(node) in done:
        return
    if id(node) in above:
        raise ValueError("anchor contains itself")
    above.add(id(node))
    parts = node.value
    if node.id == "mapping":
        names = [key.value for key, _ in parts if key.id == "scalar"]
        if len(names) != len(set(names)):
            raise ValueError(f"key given twice: {next(n for n in names if names.count(n) > 1)}")
        parts = [part for pair in parts for part in pair]
    for child in parts:
        if child.id != "scalar":
            _check(child, above, done)
    above.discard(id(node))
    done.add(id(node))


def _null(node) -> bool:
    return node.id == "scalar" and node.tag.endswith(":null")


def _entries(node) -> dict:
    """Key texts and value nodes of a mapping; its own keys go before merged ones."""
    own, merged = {}, {}
    for key, value in node.value:
        if key.tag.endswith(":merge"):
            for source in value.value if value.id == "sequence" else [value]:
                if source.id != "mapping":
                    raise ValueError("merge of something that is no mapping")
                merged = _entries(source) | merged
        elif key.id == "scalar":
            own[key.value] = value
    return merged | own


def _whole(text: str) -> int:
    bare = text.replace("_", "")
    try:
        if bare.lstrip("+-").isdigit() and bare.lstrip("+-").startswith("0"):
            return int(bare, 8)
        return int(bare, 0)
    except ValueError:
        return int(float(bare))


def _fit(node, kind: T.DataType, place: str):
    """The node as a value of the wanted type; ValueError where it has another shape."""
    if node.id == "scalar":
        if _null(node):
            return None
        if isinstance(kind, T.StringType):
            return node.value
        word = node.value.lower()
        if not node.style and isinstance(kind, T.BooleanType) and word in YES + NO:
            return word in YES
        if not node.style and isinstance(kind, T.IntegralType):
            number = _whole(node.value)
            if abs(number) < 2 ** (31 if isinstance(kind, T.IntegerType) else 63):
                return number
    elif node.id == "mapping":
        if isinstance(kind, T.StructType):
            have = _entries(node)
            return {f.name: _fit(have[f.name], f.dataType, f"{place}.{f.name}") for f in kind.fields if f.name in have}
        if isinstance(kind, T.MapType):
            return {name: _fit(value, kind.valueType, f"{place}.{name}") for name, value in _entries(node).items()}
    elif isinstance(kind, T.ArrayType):
        return [_fit(value, kind.elementType, place) for value in node.value]
    raise ValueError(f"wrong type at {place.lstrip('.')}")


def _yaml_to_json(text: str | None, schema: T.StructType) -> tuple[str | None, str | None]:
    """One document as JSON of the schema's types, with the password replaced by a presence flag.

    Whatever is wrong with a document becomes its error text.
    """
    try:
        loader = _loader()(text or "")
        try:
            node = loader.get_single_node()
        finally:
            loader.dispose()
        if node is None or _null(node):
            return "{}", None
        if node.id != "mapping":
            return None, "document is not a mapping"
        _check(node, set(), set())
        doc = _fit(node, schema, "")
        if isinstance(doc.get("hmc"), dict):
            password = _entries(_entries(node)["hmc"]).get("password")
            given = None if password is None else _fit(password, T.StringType(), "hmc.password")
            doc["hmc"]["password_set"] = bool(given) and given != PASSWORD_PLACEHOLDER
        return json.dumps(doc), None
    except Exception as err:  # one bad document must not end the job
        return None, (str(err).splitlines() or [type(err).__name__])[0]


def parse_configs(df: DataFrame) -> DataFrame:
    """Add the parsed document to rows carrying its text in ``raw``.

    A document that does not parse, gives a key twice, contains itself or has a
    value of the wrong type keeps its row, with nulls and ``_error``.
    """
    schema = T.StructType.fromDDL(CONFIG)
    shape = T.StructType([*df.schema.fields, T.StructField("_json", T.StringType()),
                          T.StructField("_error", T.StringType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_yaml_to_json(value, schema) for value in batch.column("raw").to_pylist()]
            added = [pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_json", "_error"])

    parsed = df.mapInArrow(convert, shape)
    return parsed.withColumn("_doc", F.from_json("_json", schema)).select(*df.columns, "_doc.*", "_error")


def read_configs(spark: SparkSession, glob: str) -> DataFrame:
    """One row per document.  Files are packed into partitions by size."""
    files = spark.read.text(glob, wholetext=True).select(
        folder_of(F.col("_metadata.file_path")).alias("directory"),
        F.col("_metadata.file_modification_time").alias("snapshot_ts"),
        F.col("value").alias("raw"))
    return parse_configs(files)


def parse_states(df: DataFrame, text: str = "raw") -> DataFrame:
    """State documents held as text; an unreadable one has ``status`` null and ``corrupt`` set."""
    schema = T.StructType.fromDDL(STATE).add("_corrupt", T.StringType())
    doc = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("_doc", doc)
    keep = [c for c in df.columns if c != text]
    fields = [f"_doc.{f.name}" for f in schema.fields if f.name != "_corrupt"]
    bad = F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull()
    return out.select(*keep, *fields, bad.alias("corrupt"))


def read_states(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.text(glob, wholetext=True).select(
        folder_of(F.col("_metadata.file_path")).alias("directory"),
        F.col("_metadata.file_modification_time").alias("snapshot_ts"),
        F.col("value").alias("raw"))
    return parse_states(files)


def marker_flags(files: DataFrame) -> DataFrame:
    """File paths to one row of flags per cluster folder."""
    named = files.select(folder_of(F.col("path")).alias("cluster_name"), folder_of(F.col("path"), 0).alias("file"))
    flags = [F.bool_or(F.col("file") == name).alias(flag) for flag, name in MARKERS.items()]
    return named.groupBy("cluster_name").agg(*flags)


def read_markers(spark: SparkSession, root: str) -> DataFrame:
    """Flags of every cluster folder below ``root``; a folder without any file has all flags down."""
    flags = [F.coalesce(F.bool_or(F.col("name") == name), F.lit(False)).alias(flag) for flag, name in MARKERS.items()]
    return list_folders(spark, root).groupBy(F.col("folder").alias("cluster_name")).agg(*flags)


def parse_locks(df: DataFrame, text: str = "content") -> DataFrame:
    """``Locked at: <time>`` and ``PID: <pid>`` lines; unreadable text gives nulls."""
    pid = F.regexp_extract(F.col(text), r"(?m)^PID: \s*(\d+)", 1)
    since = F.regexp_extract(F.col(text), r"(?m)^Locked at: (\S+)", 1)
    return df.withColumns({"lock_pid": pid.try_cast("bigint"), "lock_time": parse_rfc3339(since)})


def read_locks(spark: SparkSession, root: str) -> DataFrame:
    """Lock files below ``root``: when each was written, by whom and since when."""
    name = MARKERS["locked"]
    held = list_folders(spark, root, (name,)).filter(F.col("name") == name).select(
        F.col("folder").alias("cluster_name"), F.col("mtime").alias("modified_at"), "content")
    return parse_locks(held).drop("content")
