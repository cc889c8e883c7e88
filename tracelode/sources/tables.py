"""Scans and sinks: Parquet, JSON Lines, CSV, documents behind a parser, isolated runs and versioned overlays."""

from __future__ import annotations

import datetime as dt
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions import text as X
from ..schemas import conform, schema

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(docs: DataFrame, members: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exactly the documents that a membership list names."""
    return docs.join(members.select(key).distinct(), key, "left_semi")


def read_jsonl(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """JSON Lines by a fixed schema; lines that don't parse raise."""
    return spark.read.schema(schema(entity)).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, entity: str | None = None) -> None:
    (conform(df, entity) if entity else df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_store(spark: SparkSession, path: str, entity: str) -> DataFrame:
    return spark.read.schema(schema(entity)).parquet(path)


def write_store(df: DataFrame, path: str, entity: str, partition_by: tuple[str, ...] = ("doc_id",)) -> None:
    """The evidence store: Parquet in folders by document, clustered first so that a folder gets few files."""
    out = conform(df, entity)
    if partition_by:
        out = out.repartition(*[F.col(c) for c in partition_by])
    out.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays, maps and structures become JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def scan_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], columns: str, pattern: str = "*.pdf") -> DataFrame:
    """Blocks of documents by a parser plug-in: path, file_sha256 and whatever ``columns`` the parser gives a block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                rows = parse(bytes(raw))
                if rows:
                    yield pd.DataFrame(rows).assign(path=p, file_sha256=hashlib.sha256(raw).hexdigest())

    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    return files.mapInPandas(lambda it: (x[["path", "file_sha256", *names]] for x in run(it)), f"path string, file_sha256 string, {columns}")


def pdf_parser() -> Callable[[bytes], list[dict]]:
    """Text blocks with box, page and font by a PDF library, where one is installed."""
    try:
        import fitz  # type: ignore
    except ImportError as e:
        raise RuntimeError("no PDF library is installed; read pages or documents from Parquet") from e

    def parse(raw: bytes) -> list[dict]:
        out = []
        for n, page in enumerate(fitz.open(stream=raw, filetype="pdf"), 1):
            for b in page.get_text("dict")["blocks"]:
                spans = [s for line in b.get("lines", []) for s in line["spans"]]
                if spans:
                    out.append({"page": n, "text": "".join(s["text"] for s in spans), "font": spans[0]["font"], "x0": b["bbox"][0], "y0": b["bbox"][1], "x1": b["bbox"][2], "y1": b["bbox"][3]})
        return out

    return parse


def html_pages(pages: DataFrame) -> DataFrame:
    """Visible text and first heading of pages."""
    h1 = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", ""))
    return pages.select("page_id", "url", h1.alias("title"), X.html_text(F.col("html")).alias("text"))


class Run:
    """An isolated run: everything below its own folder, nothing is ever overwritten, and the manifest says what went in."""

    def __init__(self, root: str, run_id: str, config: Config = CONFIG):
        if not run_id or PurePosixPath(run_id).name != run_id or run_id.startswith("."):
            raise ValueError("a run id is one plain folder name")
        self.path, self.run_id, self.config = f"{root.rstrip('/')}/run_id={run_id}", run_id, config

    def write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return path

    def manifest(self, spark: SparkSession, stage: str, inputs: list[tuple[str, str]], code_sha256: str) -> DataFrame:
        import pyspark

        row = (self.run_id, stage, [{"path": p, "sha256": h} for p, h in inputs], self.config.digest(), code_sha256, {"pyspark": pyspark.__version__, "config": self.config.version}, dt.datetime.now())
        return spark.createDataFrame([row], schema("run_manifest"))


def overlay(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """A corrected output beside the legacy one: both stay, ``version`` tells them apart."""
    base = old if "version" in old.columns else old.withColumn("version", F.lit(1))
    return base.unionByName(new.withColumn("version", F.lit(version)))


def write_workbook(sheets: dict[str, DataFrame], path: str, note: str, most_rows: int = 10_000) -> list[str]:
    """Small result tables as a workbook where its library is installed, else a CSV file a sheet; the note goes with them.

    A sheet of more than ``most_rows`` rows raises: reports are small, tables belong in Parquet.
    """
    frames = {}
    for name, df in sheets.items():
        frames[name] = df.limit(most_rows + 1).toPandas()
        if len(frames[name]) > most_rows:
            raise ValueError(f"{name} is too large for a sheet")
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        out = []
        for name, f in frames.items():
            f.to_csv(f"{path}.{name}.csv", index=False)
            out.append(f"{path}.{name}.csv")
        with open(f"{path}.note.txt", "w", encoding="utf-8") as f:
            f.write(note)
        return [*out, f"{path}.note.txt"]
    with pd.ExcelWriter(path) as w:
        for name, f in {**frames, "note": pd.DataFrame({"note": [note]})}.items():
            f.to_excel(w, sheet_name=name, index=False)
    return [path]


def report(title: str, sections: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A Markdown report from small results; longer ones say that they are cut."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most_rows + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most_rows]]
        if len(rows) > most_rows:
            out.append(f"\nThe first {most_rows} rows.")
    return "\n".join(out) + "\n"


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session that names none gets one of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tracelode-shared-")
    return _local[app]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder; where another session has been faster, its folder stays and ``path`` goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = old.getFileSystem(conf)
    if files.exists(new) or not files.rename(old, new):
        if not files.exists(new):
            raise OSError(f"{path} could not be moved to {to}")
        files.delete(old, True)


def state_of(spark: SparkSession, df: DataFrame) -> str:
    """A hash of the files behind a table, with their sizes and times: another state of the table is another hash."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for f in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        out.append(f"{f} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the folder of ``spark.checkpoint.dir``; only a local session that names none gets one of its own."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelode-checkpoints-"))
    return df.checkpoint()
