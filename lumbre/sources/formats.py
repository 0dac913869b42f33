"""Readers of the formats that corpora, terminologies and graphs come in, and writers of results."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CHUNK = "chunk_id string, guia string, titulo_guia string, version string, fecha_vigencia string, seccion string, pagina int, texto string, tipo string, ambito array<string>, farmacos array<string>, condiciones array<string>, umbrales array<string>, nivel_evidencia string"
TURN = "thread_id string, turn_id int, ts string, user_id string, role string, texto string, nivel int, guias_citadas array<string>, herramientas array<string>, ruta string, hitl boolean, abstenido boolean, pii_directos int, riesgo_reident string, feedback_pulgar int, edicion_medico string, retener_hasta string"
# Columns of a terminology's concept file (pipe-delimited, with a closing pipe).
CONCEPT_COLUMNS = "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()
SOURCES = ["SNOMEDCT_US", "SCTSPA", "MSHSPA", "MSH"]


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, broken lines come out with all columns null and ``_corrupt`` set."""
    whole = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*whole.fields]).add("_corrupt", "string")
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that hold one JSON document or array each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def concepts(spark: SparkSession, path: str, sources: list[str] = SOURCES) -> DataFrame:
    """Concept rows of the wanted sources that are not suppressed, with the folded term; plain or gzipped files."""
    from lumbre.functions.text import fold

    lines = spark.read.text(path).select(F.split("value", r"\|").alias("v"))
    named = lines.select(*[F.col("v")[i].alias(c) for i, c in enumerate(CONCEPT_COLUMNS)])
    kept = named.where(F.col("SAB").isin(sources) & (F.col("SUPPRESS") == "N"))
    return kept.select(fold(F.col("STR")).alias("term_norm"), F.col("STR").alias("term"), F.col("CUI").alias("cui"), F.when(F.col("SAB").isin("SNOMEDCT_US", "SCTSPA"), F.col("SCUI")).alias("sctid"), F.col("SAB").alias("sab"), F.col("TTY").alias("tty"), F.col("LAT").alias("lat"), F.col("ISPREF").alias("ispref"))


def semantics(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    """Semantic types (cui, tui, sty) of the concepts in ``kept``."""
    v = spark.read.text(path).select(F.split("value", r"\|").alias("v"))
    return v.select(F.col("v")[0].alias("cui"), F.col("v")[1].alias("tui"), F.col("v")[3].alias("sty")).join(kept.select("cui").distinct(), "cui", "left_semi")


def code_links(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (child, parent) between codes from links between atoms: both ends looked up, loops and repeats dropped.

    ``atoms``: (aui, sctid); ``pairs``: (child_aui, parent_aui).
    """
    child = atoms.select(F.col("aui").alias("child_aui"), F.col("sctid").alias("child"))
    parent = atoms.select(F.col("aui").alias("parent_aui"), F.col("sctid").alias("parent"))
    return pairs.join(child, "child_aui").join(parent, "parent_aui").where("child <> parent").select("child", "parent").distinct()


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and table rows of a page, in order."""

    KINDS = {"h1": 20.0, "h2": 16.0, "h3": 14.0, "h4": 13.0, "p": 10.0, "li": 10.0, "tr": 0.0}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.kind, self.held = [], None, []

    def _flush(self):
        text = " ".join("".join(self.held).split())
        if text:
            size = self.KINDS.get(self.kind, 10.0)
            self.out.append((f"| {text} |" if self.kind == "tr" else text, size, "tabla" if self.kind == "tr" else "texto"))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in self.KINDS:
            self._flush()
            self.kind = tag
        elif tag in ("td", "th") and "".join(self.held).strip():
            self.held.append(" | ")

    def handle_endtag(self, tag):
        if tag in self.KINDS:
            self._flush()
            self.kind = None

    def handle_data(self, data):
        self.held.append(data)

    def close(self):
        super().close()
        self._flush()


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Blocks (doc_id, ord, pagina, texto, size_max, tipo) of HTML pages; malformed and empty pages give what can be read."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch["key"], batch["html"]):
                parser = _Blocks()
                parser.feed(text)
                parser.close()
                rows += [(k, i, 1, t, s, c) for i, (t, s, c) in enumerate(parser.out)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "pagina", "texto", "size_max", "tipo"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).where("html is not null").mapInPandas(run, f"doc_id {kind}, ord int, pagina int, texto string, size_max double, tipo string")


def database(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A query against a relational database; give partitionColumn, bounds and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{folder}/edges")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def build_once(rows: DataFrame, path: str) -> DataFrame:
    """Write unless it is there already, and read it."""
    rows.write.mode("ignore").parquet(path)
    return rows.sparkSession.read.parquet(path)


def update_by_key(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` with the non-null values of ``changes`` laid over them; changes without a row are ignored.

    ``changes`` must have one row per key.
    """
    news = [c for c in changes.columns if c not in keys]
    laid = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in news])
    joined = current.join(laid, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in news else F.col(c) for c in current.columns])


def not_done(rows: DataFrame, done: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Rows whose key was not processed yet; those that failed are tried again."""
    ready = done if failed is None else done.where(~failed)
    return rows.join(ready.select(key).distinct(), key, "left_anti")


def code_by_file(rows: DataFrame, guides: DataFrame, file: str = "archivo") -> DataFrame:
    """Rows with the code of the guide that their file belongs to, null if none."""
    return rows.join(guides.select(file, "codigo").dropDuplicates([file]), file, "left")
