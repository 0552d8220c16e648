"""Text formats at the engine's edges: metric exposition, syslog lines, golden sets, reports, vocabularies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import config_number, opaque_id

FACILITY, NOTICE, WARNING = 13, 5, 4


# -- metrics ----------------------------------------------------------------------------------------------------


def metric_line(name: Column, labels: Column, value: Column) -> Column:
    """name{a="b",c="d"} value, labels by name; labels: a map, perhaps empty."""
    pairs = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))))
    return F.concat(name, F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), value.cast("string"))


def exposition(samples: DataFrame, helps: dict[str, str]) -> DataFrame:
    """One row `text`: the families of samples (metric, labels, value), each after its HELP and TYPE; a few lines by nature."""
    head = F.element_at(F.create_map(*(F.lit(x) for item in helps.items() for x in item)), F.col("metric"))
    lines = samples.select("metric", metric_line(F.col("metric"), F.col("labels"), F.col("value")).alias("line")).groupBy("metric").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    family = F.concat_ws("\n", F.concat(F.lit("# HELP "), "metric", F.lit(" "), head), F.concat(F.lit("# TYPE "), "metric", F.lit(" gauge")), F.array_join("lines", "\n"))
    texts = lines.select(F.struct("metric", family.alias("family")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return texts.select(F.concat(F.array_join(F.transform("x", lambda f: f["family"]), "\n"), F.lit("\n")).alias("text"))


def anomaly_samples(flagged: DataFrame, stats: DataFrame, window_seconds: int, now: float, prefix: str = "corvane") -> DataFrame:
    """(metric, labels, value): flagged identities by signal, the most attempts, the window and the time of the run; no identity."""
    none = F.create_map().cast("map<string,string>")
    by_signal = flagged.select(F.lit(f"{prefix}_flagged_identities").alias("metric"), F.create_map(F.lit("signal"), "signal").alias("labels"), F.col("identities").cast("double").alias("value"))
    most = stats.agg(F.coalesce(F.max("attempts"), F.lit(0)).cast("double").alias("value")).select(F.lit(f"{prefix}_max_attempts").alias("metric"), none.alias("labels"), "value")
    run = stats.sparkSession.range(1)
    fixed = [run.select(F.lit(f"{prefix}_{n}").alias("metric"), none.alias("labels"), F.lit(float(v)).alias("value")) for n, v in (("window_seconds", window_seconds), ("last_run_timestamp_seconds", now))]
    return by_signal.unionByName(most).unionByName(fixed[0]).unionByName(fixed[1])


def quality_samples(metrics: DataFrame, configuration: Column, prefix: str = "corvane_quality") -> DataFrame:
    """(metric, labels, value) of (qid, metric, value): case ids as opaque hashes, and a fingerprint of the configuration as a number."""
    cases = metrics.where("value is not null").select(F.concat(F.lit(prefix + "_"), "metric").alias("metric"), F.create_map(F.lit("case"), opaque_id(F.col("qid"))).alias("labels"), F.col("value").cast("double"))
    mark = metrics.sparkSession.range(1).select(F.lit(prefix + "_configuration").alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), config_number(F.sha2(configuration, 256)).cast("double").alias("value"))
    return cases.unionByName(mark)


# a label of an exposition line: a name, and a quoted value in which a backslash takes the next character with it
LABEL = r'([A-Za-z_][0-9A-Za-z_]*)\s*=\s*"((?:\\.|[^"\\])*)"'


def read_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """(metric, labels, sample) of sample lines, labels in any order; comments and other lines are left out."""
    parts = lambda i: F.regexp_extract(column, r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)\s*$", i)
    rows = lines.where(~F.col(column).startswith("#")).select(parts(1).alias("metric"), parts(2).alias("_l"), parts(3).alias("_v")).where("metric <> ''")
    labels = F.map_from_arrays(F.regexp_extract_all("_l", F.lit(LABEL), F.lit(1)), F.regexp_extract_all("_l", F.lit(LABEL), F.lit(2)))
    number = F.when(F.col("_v") == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(_v as double)"))
    return rows.select("metric", labels.alias("labels"), number.alias("sample")).where("sample is not null")


def stage_histograms(samples: DataFrame, name: str) -> DataFrame:
    """(stage, le, cum, total_sum, total_count) of a histogram's samples."""
    stage = F.element_at("labels", "stage")
    le = F.element_at("labels", "le")
    edge = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.cast("double"))
    buckets = samples.where((F.col("metric") == f"{name}_bucket") & stage.isNotNull() & le.isNotNull()).select(stage.alias("stage"), edge.alias("le"), F.col("sample").alias("cum"))
    total = lambda s: samples.where((F.col("metric") == f"{name}_{s}") & stage.isNotNull()).groupBy(stage.alias("stage")).agg(F.max("sample").alias(f"total_{s}"))
    return buckets.join(total("sum"), "stage", "left").join(total("count"), "stage", "left").fillna(0.0, ["total_sum", "total_count"])


# -- syslog -----------------------------------------------------------------------------------------------------


def syslog_line(service: str, host: str, process: int, facility: int = FACILITY) -> Column:
    """An RFC 5424 line of an audit row (id, actor_sub, actor_username, action, target_id, detail, created_at)."""
    if not 0 <= facility <= 23:
        facility = FACILITY
    priority = facility * 8 + F.when(F.contains("action", F.lit("denied")), WARNING).otherwise(NOTICE)
    stamp = F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    kind = F.substring(F.regexp_replace("action", r"[^!-~]", ""), 1, 32)
    body = F.to_json(F.struct("id", F.lit(service).alias("service"), "actor_sub", "actor_username", "action", "target_id", "detail", stamp.alias("created_at")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("<"), priority.cast("string"), F.lit(">1 "), stamp, F.lit(f" {host} corvane-{service} {process} "), F.when(kind == "", "-").otherwise(kind), F.lit(" - "), body)


def octet_framed(line: Column) -> Column:
    return F.concat(F.octet_length(line).cast("string"), F.lit(" "), line)


def frames_of(data: bytes) -> list[bytes]:
    """The messages of octet-counted frames (a count, a space, as many bytes), as RFC 6587 has them; what follows a broken count is one message."""
    out, at = [], 0
    while at < len(data):
        space = data.find(b" ", at, at + 12)
        count = data[at:space] if space > at else b""
        if not count.isdigit():
            rest = data[at:].strip(b"\n")
            return [*out, rest] if rest else out
        out.append(data[space + 1 : space + 1 + int(count)])
        at = space + 1 + int(count)
        while data[at : at + 1] == b"\n":
            at += 1
    return out


def split_frames(data: Column) -> Column:
    """Lines of a collector's buffer: octet-counted ones if it starts with a count, else split at line ends. The counts are of UTF-8 bytes."""

    def run(buffers: pd.Series) -> pd.Series:
        return buffers.map(lambda x: [m.decode("utf-8", "replace") for m in frames_of((x or "").encode())])

    lines = F.filter(F.split(data, "\n"), lambda x: x != "")
    return F.when(data.rlike(r"^\d+ <"), F.pandas_udf(run, "array<string>")(data)).otherwise(lines)


def send_lines(lines: DataFrame, host: str, port: int, column: str = "line", protocol: str = "udp", authority: str | None = None) -> None:
    """Sends each line from the executors: by udp, or by tcp or tls in octet-counted frames.

    A failure to send is left at that, as auditing must not stop the work. An unknown protocol raises ValueError.
    """
    if protocol not in ("udp", "tcp", "tls"):
        raise ValueError(f"unknown protocol: {protocol!r}")

    def partition(rows):
        import socket
        import ssl

        kind = socket.SOCK_DGRAM if protocol == "udp" else socket.SOCK_STREAM
        try:
            with socket.socket(socket.AF_INET, kind) as plain:
                plain.settimeout(5)
                plain.connect((host, port))
                s = ssl.create_default_context(cafile=authority).wrap_socket(plain, server_hostname=host) if protocol == "tls" else plain
                for row in rows:
                    data = row[column].encode()
                    s.sendall(data if protocol == "udp" else b"%d %s" % (len(data), data))
        except OSError:
            pass

    lines.select(column).foreachPartition(partition)


# -- files of settings and reports ------------------------------------------------------------------------------

GOLDEN = "id string, persona string, query string, expect array<string>, forbid array<string>, reference_answer string, expected_abstention boolean, top_k int, note string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set with `valid`: an id, a query, and 1 to 50 results asked for (5 if unset)."""
    rows = spark.read.schema(GOLDEN).option("multiLine", "true").json(path)
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("top_k", F.coalesce("top_k", F.lit(5))).withColumn("expect", F.coalesce("expect", empty)).withColumn("forbid", F.coalesce("forbid", empty))
    return rows.withColumn("valid", F.coalesce((F.length("id") > 0) & (F.length(F.trim("query")) > 0) & F.col("top_k").between(1, 50), F.lit(False)))


def write_report(report: DataFrame, folder: str, stamp: str) -> str:
    """A report as JSON under its sortable name."""
    path = f"{folder.rstrip('/')}/report-{stamp}"
    report.coalesce(1).write.mode("errorifexists").json(path)  # one row
    return path


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.json(f"{folder.rstrip('/')}/report-*")
    return rows.withColumn("name", F.regexp_extract(F.input_file_name(), r"report-([^/]+)/", 1))


def parse_vocabulary(text: str) -> list[tuple[str, int]]:
    """VALUE:rank,...; a repeated value or rank raises ValueError."""
    pairs = [(v.strip(), int(r)) for v, r in (item.rsplit(":", 1) for item in text.split(",") if item.strip())]
    if not pairs or any(not v for v, _ in pairs) or len({v for v, _ in pairs}) < len(pairs) or len({r for _, r in pairs}) < len(pairs):
        raise ValueError(f"values and ranks must be unique and not empty: {text!r}")
    return pairs


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows are only ever added."""
    rows.write.mode("append").parquet(path)


def query_detail(query: Column, trace_id: Column) -> Column:
    """What an audit row keeps of a query: its length and trace, never its words."""
    return F.to_json(F.struct(F.length(query).alias("query_chars"), trace_id.alias("trace_id")))


def _gauge(rows: DataFrame, name: str, label: str | None, value: str) -> DataFrame:
    labels = F.create_map(F.lit(label), F.col(label).cast("string")) if label else F.create_map().cast("map<string,string>")
    return rows.where(F.col(value).isNotNull()).select(F.lit(name).alias("metric"), labels.alias("labels"), F.col(value).cast("double").alias("value"))


def integrity_samples(outcomes: DataFrame, prefix: str = "corvane_integrity") -> DataFrame:
    """(metric, labels, value) of (outcome, n)."""
    return _gauge(outcomes, f"{prefix}_documents", "outcome", "n")


def calibration_samples(agreement: DataFrame, prefix: str = "corvane_agreement") -> DataFrame:
    """(metric, labels, value) of (suggester, accepted, overridden, unresolved, rate); an undefined rate is left out."""
    out = None
    for c in ("accepted", "overridden", "unresolved", "rate"):
        one = _gauge(agreement, f"{prefix}_{c}", "suggester", c)
        out = one if out is None else out.unionByName(one)
    return out
