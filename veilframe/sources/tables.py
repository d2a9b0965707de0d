"""Loaders of labelled record tables, and sinks.

A loader returns a ``Loaded``: rows (features as doubles, label as string), the features' names, the label's name and the
normal label. Files are read by Spark's readers only, so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import functools
import heapq
import math
import pickle
import posixpath
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime
from veilframe.functions import scalars
from veilframe.operators import longform

NSL, UNSW, CIC, UNKNOWN = "NSL-KDD", "UNSW-NB15", "CIC-IDS-2017", "UNKNOWN"

# Columns of the header-less flow records in their true order (41 features, label, difficulty).
NSL_COLUMNS = """duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins logged_in
num_compromised root_shell su_attempted num_root num_file_creations num_shells num_access_files num_outbound_cmds is_host_login
is_guest_login count srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate same_srv_rate diff_srv_rate
srv_diff_host_rate dst_host_count dst_host_srv_count dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate
dst_host_srv_diff_host_rate dst_host_serror_rate dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate
label difficulty""".split()
NSL_STRINGS = ("protocol_type", "service", "flag", "label")

# Categories of the class labels, normal labels and dropped columns of each data set.
CATEGORIES = {
    NSL: scalars.LABELS_BY_CLASS,
    UNSW: {
        "Normal": ("Normal", ""), "Fuzzers": ("Fuzzers",), "Analysis": ("Analysis",), "Backdoors": ("Backdoors",), "DoS": ("DoS",), "Exploits": ("Exploits",),
        "Generic": ("Generic",), "Reconnaissance": ("Reconnaissance",), "Shellcode": ("Shellcode",), "Worms": ("Worms",),
    },
    CIC: {
        "Normal": ("BENIGN",), "DDoS": ("DDoS",), "PortScan": ("PortScan",), "Bot": ("Bot",),
        "Web": ("Web Attack – Brute Force", "Web Attack – XSS", "Web Attack – Sql Injection"), "FTP-Patator": ("FTP-Patator",), "SSH-Patator": ("SSH-Patator",),
        "DoS": ("DoS slowloris", "DoS Slowhttptest", "DoS Hulk", "DoS GoldenEye", "Heartbleed"), "Infiltration": ("Infiltration",),
    },
}
NORMAL = {NSL: "normal", UNSW: "Normal", CIC: "BENIGN", UNKNOWN: "normal"}
DROPPED = {
    NSL: ("index", "difficulty", "difficulty_level"),
    UNSW: ("id", "proto", "service", "state", "attack_cat", "label"),
    CIC: ("Flow ID", "Source IP", "Destination IP", "Timestamp", "Fwd Header Length.1"),
    UNKNOWN: ("index", "id", "difficulty_level", "label", "class"),
}


class Loaded(NamedTuple):
    rows: DataFrame
    features: list[str]
    label: str
    normal: str


def detect(path: str) -> str:
    """The data set by the last part of its path."""
    name = posixpath.basename(path.rstrip("/")).lower()
    if "kdd" in name:
        return NSL
    if "unsw" in name:
        return UNSW
    if any(x in name for x in ("cic", "ids-2017", "ids2017", "pcap_iscx", "machinelearningcve")):
        return CIC
    return UNKNOWN


#: One file a task, whatever its size: only its first lines are read.
_HEADERS = {
    "spark.sql.files.maxPartitionBytes": str(1 << 42), "spark.sql.files.openCostInBytes": str(1 << 42),
    "spark.sql.files.ignoreCorruptFiles": "true", "spark.sql.files.ignoreMissingFiles": "true",
}
#: Lines that one header can have, by line breaks in quotes.
_HEADER_LINES = 64


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record of a file that isn't blank, and its number of lines; null where all lines are blank. Reads no further."""
    uri, lines = None, []
    for b in batches:
        for line, uri in zip(*[b[c].to_pylist() for c in ("value", "uri")], strict=True):
            if lines or line.strip("\ufeff \t\r"):
                lines.append(line)
            if lines and (sum(x.count('"') for x in lines) % 2 == 0 or len(lines) == _HEADER_LINES):
                break
        else:
            continue
        break
    if uri is not None:
        whole = sum(x.count('"') for x in lines) % 2 == 0
        lines = lines if whole else lines[:1]
        header = [lines[0] if len(lines) == 1 else "\n".join(lines)] if lines else [None]
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array(header, pa.string()), pa.array([len(lines)], pa.int32())], ["uri", "header", "lines"])


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, length, header, lines, error: one row for each file of a path (a file, a directory or a pattern of them) that isn't empty.

    A job in which each task opens one file and reads its header only. header is null for a file of blank lines, which is no error,
    and for one that can't be read, which is.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", F.col("_metadata.file_path").alias("uri"))
    with runtime.settings(spark, _HEADERS):
        lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select("value", F.col("_metadata.file_path").alias("uri"))
        found = lines.mapInArrow(_first_records, "uri string, header string, lines int")
        error = F.when(F.col("lines").isNull() & (F.col("length") > 0), "unreadable")
        return runtime.materialize(listed.join(found, "uri", "left").select("file", "length", "header", "lines", error.alias("error")), "headers")


class UnreadableFiles(OSError):
    """Files of a scan that can't be read."""


def _names(header: str) -> list[str]:
    """Column names without byte-order mark and surrounding white space; a name that comes again gets .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in scalars.strip_names(next(csv.reader([header], skipinitialspace=True))):
        seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}.{seen[n]}" if seen[n] else n)
    return out


class Scan(NamedTuple):
    """Rows, and the names of the files that were left out as they can't be read (file, error)."""

    rows: DataFrame
    left_out: DataFrame


def scan_csv(spark: SparkSession, path: str, skip_unreadable: bool = False) -> Scan:
    """CSV files united by column name. All columns are strings, so nothing is read twice to infer types; names lose byte-order marks
    and surrounding white space.

    Headers are read in a job (``csv_headers``); files with equal headers are one scan, and a column that a file lacks is null
    there. Empty files have no rows. A file that can't be read raises ``UnreadableFiles``, unless such files are to be
    skipped: then they are in ``left_out``. A file that breaks further down fails when it is read.
    """
    runtime.ship(spark)
    headers = csv_headers(spark, path)
    bad = headers.where("error is not null").select("file", "error")
    kinds = headers.groupBy("header", "lines", "error").agg(F.count("*").alias("n"), F.min("file").alias("first")).orderBy("first").collect()
    if not skip_unreadable and (n_bad := sum(r.n for r in kinds if r.error)):
        raise UnreadableFiles(f"{n_bad} files can't be read, among them {', '.join(r.file for r in bad.limit(20).collect())}")
    every = sum(r.n for r in kinds)
    groups: dict[tuple[str, ...], list[tuple[str, int, int]]] = {}
    for r in kinds:
        if r.header is not None:
            groups.setdefault(tuple(_names(r.header)), []).append((r.header, r.lines, r.n))
    if not groups:
        raise FileNotFoundError(f"no file with a header at {path}")
    scans = []
    for names, same in groups.items():
        reader = spark.read.option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("header", True).option("enforceSchema", True)
        reader = reader.option("multiLine", any(lines > 1 for _, lines, _ in same)).schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        if sum(n for *_, n in same) == every:
            scans.append(reader.csv(path))
        else:
            scans.append(reader.csv([r.file for r in headers.where(F.col("header").isin([h for h, *_ in same])).select("file").orderBy("file").collect()]))
    return Scan(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans), bad)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True, skip_unreadable: bool = False) -> DataFrame:
    """A CSV file, a directory or a pattern of them: by ``scan_csv``, or with a schema, or without headers."""
    if schema is not None or not header:
        reader = spark.read.option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("header", header)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    return scan_csv(spark, path, skip_unreadable).rows


def read_directory(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """All CSV files of a directory, or one of them, by column name."""
    return read_csv(spark, path if path.endswith(".csv") or "*" in path else f"{path.rstrip('/')}/*.csv", skip_unreadable=skip_unreadable)


def nsl_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType() if c in NSL_STRINGS else T.DoubleType()) for c in NSL_COLUMNS])


def text_to_csv(spark: SparkSession, path: str, target: str) -> None:
    """Header-less flow records to CSV with their true column names."""
    write_csv(spark.read.schema(nsl_schema()).csv(path), target)


def _first_values(columns: Sequence[str], rows: int):
    """The first non-null values of each column in a partition with their places; reads no further than it takes."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {c: [] for c in columns}
        place = 0
        for b in batches:
            at = [b[c].to_pylist() for c in ("_file", "_start", "_part")]
            for i, c in enumerate(columns):
                values = b.column(i + 3)
                for j in np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))[: rows - len(found[c])].tolist():
                    found[c].append((at[0][j], at[1][j], at[2][j], place + j, values[j].as_py()))
            place += b.num_rows
            if all(len(v) == rows for v in found.values()):
                break
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

    return first


def label_column(df: DataFrame, normal: str = "normal", rows: int = 50) -> str | None:
    """The first string column among whose first ``rows`` non-null values (by file and place in it) the normal label is, in any case.

    One job for all columns: each task keeps the first values of its part, and partial results merge in a tree.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not columns:
        return None
    runtime.ship(df.sparkSession)
    where = [F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"), F.spark_partition_id().alias("_part")]
    marked = df.select(*where, *[F.lower(F.trim(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(columns)])
    parts = marked.mapInArrow(_first_values(columns, rows), "found binary").rdd
    if not (n := parts.getNumPartitions()):
        return None

    def merged(a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
        return {c: heapq.nsmallest(rows, a[c] + b[c]) for c in a}

    found = parts.map(lambda r: pickle.loads(r[0])).treeReduce(merged, depth=max(2, math.ceil(math.log(n, 32))))
    return next((c for c in columns if any(normal.lower() in v for *_, v in found[c])), None)


def numeric_features(df: DataFrame, exclude: Sequence[str] = DROPPED[UNKNOWN], least: float = 0.95) -> list[str]:
    """Columns of which more than ``least`` reads as a number. One pass; as many rows come back as there are columns."""
    numeric = {r["column"] for r in longform.numeric_profile(df, exclude, least).where("numeric").collect()}
    return [c for c in df.columns if c in numeric]


def _features(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.select(*[scalars.number(F.col(f"`{f}`")).alias(f) for f in features], F.col(f"`{label}`").cast("string").alias(label))


def load_flows(spark: SparkSession, path: str, normal: str = NORMAL[NSL]) -> Loaded:
    """A table whose label column is found by its content and whose features are found by theirs."""
    df = read_csv(spark, path)
    label = label_column(df, normal)
    if label is None:
        raise ValueError(f"no string column of {path} holds {normal!r} among its first values")
    features = [c for c in numeric_features(df) if c != label]
    return Loaded(_features(df, features, label), features, label, normal)


def load_unsw(spark: SparkSession, path: str) -> Loaded:
    """The attack category becomes ``label_str``: blanks and records with label 0 are Normal."""
    df = read_csv(spark, path)
    category = F.trim("attack_cat") if "attack_cat" in df.columns else F.when(F.col("label") == "0", "Normal").otherwise("Attack")
    named = F.when(category.isNull() | F.lower(category).isin("", "nan", "none"), "Normal").otherwise(category)
    if "label" in df.columns:
        named = F.when(F.col("label").try_cast("int") == 0, "Normal").otherwise(named)
    features = [c for c in df.columns if c not in DROPPED[UNSW]]
    return Loaded(_features(df.withColumn("label_str", named), features, "label_str"), features, "label_str", NORMAL[UNSW])


def load_cic(spark: SparkSession, path: str) -> Loaded:
    """One CSV file or a directory; infinities become null."""
    df = read_directory(spark, path)
    features = [c for c in df.columns if c not in (*DROPPED[CIC], "Label")]
    return Loaded(_features(df.withColumn("Label", F.trim("Label")), features, "Label"), features, "Label", NORMAL[CIC])


def load(spark: SparkSession, path: str) -> Loaded:
    """By the data set that the path names."""
    kind = detect(path)
    return load_unsw(spark, path) if kind == UNSW else load_cic(spark, path) if kind == CIC else load_flows(spark, path)


def categories(spark: SparkSession, kind: str) -> DataFrame:
    """label, category: a few dozen rows to join labels with."""
    return spark.createDataFrame([(x, c) for c, labels in CATEGORIES[kind].items() for x in labels], "label string, category string")


def with_category(loaded: Loaded, kind: str) -> DataFrame:
    """Rows and the category of their label; Other where none lists it."""
    few = F.broadcast(categories(loaded.rows.sparkSession, kind).withColumnRenamed("label", "_label"))
    rows = loaded.rows.join(few, F.col(f"`{loaded.label}`") == F.col("_label"), "left").drop("_label")
    return rows.withColumn("category", F.coalesce("category", F.lit("Other")))


def label_counts(loaded: Loaded) -> DataFrame:
    return loaded.rows.groupBy(F.col(f"`{loaded.label}`").alias("label")).agg(F.count("*").alias("n"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty, infinities Infinity."""
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


# Classes and their sizes, and for each feature of a synthetic flow table (mean, deviation, least, greatest) by class, * for all others.
SYNTHETIC_CLASSES = {
    "Normal": 37000, "Generic": 18871, "Exploits": 11132, "Fuzzers": 6062, "DoS": 4089, "Reconnaissance": 3496, "Analysis": 677, "Backdoors": 583, "Shellcode": 378, "Worms": 44,
}
SYNTHETIC_SPECS = {
    "dur": {"*": (0.5, 2.0, 0.0, 60.0), "DoS": (0.01, 0.05, 0.0, 1.0), "Generic": (0.001, 0.01, 0.0, 0.5)},
    "spkts": {"*": (6.0, 10.0, 1.0, 500.0), "DoS": (200, 300, 1, 5000), "Fuzzers": (20, 30, 1, 1000)},
    "dpkts": {"*": (5.0, 9.0, 0.0, 500.0), "DoS": (50, 100, 0, 3000), "Reconnaissance": (3, 5, 0, 50)},
    "sbytes": {"*": (1200, 3000, 40, 1e6), "DoS": (80000, 120000, 100, 5e6), "Exploits": (5000, 8000, 100, 2e5)},
    "dbytes": {"*": (1000, 2500, 0, 1e6), "DoS": (20000, 50000, 0, 3e6)},
    "rate": {"*": (2000, 5000, 0, 1e6), "DoS": (50000, 80000, 0, 5e6), "Generic": (100000, 150000, 0, 1e7)},
    "sttl": {"*": (62, 10, 1, 255), "Generic": (252, 5, 240, 255), "Reconnaissance": (50, 20, 1, 128)},
    "dttl": {"*": (50, 15, 0, 255), "Generic": (252, 5, 240, 255)},
    "sload": {"*": (5000, 15000, 0, 1e6), "DoS": (200000, 300000, 0, 5e6)},
    "dload": {"*": (4000, 12000, 0, 1e6), "DoS": (80000, 150000, 0, 3e6)},
    "sloss": {"*": (0.5, 2.0, 0, 100), "DoS": (10, 20, 0, 500)},
    "dloss": {"*": (0.3, 1.5, 0, 100), "DoS": (5, 10, 0, 300)},
    "sinpkt": {"*": (50, 100, 0, 1000), "DoS": (0.5, 1, 0, 10)},
    "dinpkt": {"*": (60, 110, 0, 1000), "DoS": (1, 2, 0, 20)},
    "sjit": {"*": (20, 50, 0, 500), "DoS": (1, 5, 0, 50)},
    "djit": {"*": (15, 40, 0, 500)},
    "swin": {"*": (200, 100, 0, 255), "Normal": (255, 1, 0, 255)},
    "stcpb": {"*": (1e8, 2e8, 0, 4e9)},
    "dtcpb": {"*": (1e8, 2e8, 0, 4e9)},
    "dwin": {"*": (200, 100, 0, 255), "Normal": (255, 1, 0, 255)},
    "tcprtt": {"*": (0.05, 0.1, 0, 2.0), "Generic": (0.0, 0.001, 0, 0.01)},
    "synack": {"*": (0.03, 0.08, 0, 2.0), "Generic": (0.0, 0.001, 0, 0.01)},
    "ackdat": {"*": (0.02, 0.05, 0, 2.0), "Generic": (0.0, 0.001, 0, 0.01)},
    "smean": {"*": (300, 200, 20, 1500), "DoS": (1400, 100, 100, 1500)},
    "dmean": {"*": (250, 180, 0, 1500), "DoS": (1400, 100, 0, 1500)},
    "trans_depth": {"*": (1.5, 2.0, 0, 10), "Exploits": (3, 2, 0, 20)},
    "response_body_len": {"*": (2000, 8000, 0, 1e6), "Exploits": (10000, 20000, 0, 5e5)},
    "ct_srv_src": {"*": (10, 15, 1, 100), "DoS": (50, 30, 1, 200), "Generic": (60, 30, 1, 200)},
    "ct_state_ttl": {"*": (3, 3, 0, 8)},
    "ct_dst_ltm": {"*": (8, 12, 1, 100)},
    "ct_src_dport_ltm": {"*": (5, 8, 1, 100)},
    "ct_dst_sport_ltm": {"*": (4, 7, 1, 100)},
    "ct_dst_src_ltm": {"*": (10, 14, 1, 100), "DoS": (40, 20, 1, 200)},
    "ct_src_ltm": {"*": (8, 12, 1, 100)},
    "ct_srv_dst": {"*": (9, 14, 1, 100), "DoS": (50, 30, 1, 200)},
    "is_ftp_login": {"*": (0.02, 0.14, 0, 1), "Backdoors": (0.3, 0.46, 0, 1)},
    "ct_ftp_cmd": {"*": (0.05, 0.3, 0, 8), "Backdoors": (1.5, 1.5, 0, 8)},
    "ct_flw_http_mthd": {"*": (0.3, 1.0, 0, 10), "Exploits": (2.0, 2.0, 0, 20)},
    "is_sm_ips_ports": {"*": (0.03, 0.17, 0, 1), "DoS": (0.7, 0.46, 0, 1), "Generic": (0.9, 0.3, 0, 1)},
}


def synthetic_flows(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The synthetic flow table with its classes and features."""
    return synthetic(spark, SYNTHETIC_CLASSES, SYNTHETIC_SPECS, seed=seed)


def synthetic(spark: SparkSession, classes: dict[str, int], specs: dict[str, dict[str, tuple[float, float, float, float]]], normal: str = "Normal", integers: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """id, a column a feature, attack_cat, label (0 for the normal class): clipped normal values by class.

    ``specs``: feature -> class (or ``*`` for all others) -> (mean, deviation, least, greatest). One value in a hundred of a feature that
    reaches beyond 1000 is an outlier between half its greatest value and that. Rows of the classes alternate by a hash.
    """
    total = sum(classes.values())
    edges, upto = [], 0
    for name, n in classes.items():
        upto += n
        edges.append((name, upto))
    place = F.col("_place")
    attack = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        attack = F.when(place < edge, name).otherwise(attack)
    # the multiplier has no factor in common with the total, so places are a permutation of the ids
    step = next(k for k in range(total // 2 + 1, 2 * total + 2) if _coprime(k, total))
    rows = spark.range(1, total + 1).withColumn("_place", (F.col("id") * step + seed) % total).withColumn("attack_cat", attack)
    made = {}
    for j, (feature, by) in enumerate(specs.items()):
        pick = lambda i, by=by: _by_class(by, i)
        mean, sd, lo, hi = (pick(i) for i in range(4))
        x = F.greatest(lo, F.least(hi, mean + sd * F.randn(seed + 3 * j)))  # drawn once
        x = F.when((hi > 1000) & (F.rand(seed + 3 * j + 1) < 0.01), hi / 2 + F.rand(seed + 3 * j + 2) * hi / 2).otherwise(x)
        made[feature] = F.round(x).cast("long") if feature in integers else x
    return rows.withColumns(made).withColumn("label", (F.col("attack_cat") != normal).cast("int")).select("id", *specs, "attack_cat", "label")


def _by_class(by: dict[str, tuple[float, float, float, float]], i: int):
    out = F.lit(float(by["*"][i]))
    for name, values in by.items():
        if name != "*":
            out = F.when(F.col("attack_cat") == name, F.lit(float(values[i]))).otherwise(out)
    return out


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1
