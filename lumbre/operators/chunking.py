"""Blocks of a document to passages, and deduplication of records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lumbre.functions import text as tx


def marked_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, pagina, texto, size_max, tipo) with heading and table marks; the body's type size is the document's median."""
    distinct = blocks.where("doc_id is not null and ord is not null and texto is not null").dropDuplicates(["doc_id", "ord"])
    size = distinct.groupBy("doc_id").agg(F.median(F.coalesce("size_max", F.lit(0.0))).alias("m")).select("doc_id", F.when(F.col("m") == 0, 10.0).otherwise(F.col("m")).alias("body"))
    marked = distinct.join(size, "doc_id")
    table = (F.col("tipo") == "tabla") | (~tx.is_heading(F.col("texto"), F.col("size_max"), F.col("body")) & tx.is_table(F.col("texto")))
    return marked.select("doc_id", "ord", "pagina", "texto", "tipo", F.coalesce(table, F.lit(False)).alias("is_table"), F.coalesce((F.col("tipo") != "tabla") & tx.is_heading(F.col("texto"), F.col("size_max"), F.col("body")), F.lit(False)).alias("is_heading"))


def pack(blocks: DataFrame, aim: int = 1100, overlap: int = 150) -> DataFrame:
    """Passages (doc_id, idx, pagina, seccion, tipo, texto): text gathered to at least ``aim`` characters with the last ``overlap``
    carried over, flushed at headings and tables, which are passages of their own.

    Sequential within a document, so a document is the unit of work.
    """
    schema = "doc_id string, idx int, pagina int, seccion string, tipo string, texto string"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        section, held, page = "(inicio)", "", None

        def put(text: str, at, kind: str) -> None:
            text = text.strip()
            if text:
                out.append((part["doc_id"].iloc[0], len(out), None if pd.isna(at) else int(at), section, kind, text))

        part = part.sort_values("ord")
        page = part["pagina"].iloc[0]
        for b in part.itertuples(index=False):
            if b.is_table or b.is_heading:
                if held:
                    put(held, page, "texto")
                    held = ""
                if b.is_table:
                    put(b.texto, b.pagina, "tabla")
                else:
                    section = b.texto[:120]
                page = b.pagina
                continue
            if not held:
                page = b.pagina
            held = f"{held} {b.texto}".strip()
            if len(held) >= aim:
                put(held, page, "texto")
                held, page = held[-overlap:], b.pagina
        if held:
            put(held, page, "texto")
        made = pd.DataFrame(out, columns=["doc_id", "idx", "pagina", "seccion", "tipo", "texto"])
        return made.astype({"idx": "int32", "pagina": "Int32"})

    return marked_blocks(blocks).groupBy("doc_id").applyInPandas(run, schema)


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of every key in the given order, then by its other columns.

    A minimum over rows is combined before the shuffle, so a key with a third of all rows is no single task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in rows.columns])


def recommendations(chunks: DataFrame) -> DataFrame:
    """Normative sentences of chunks (chunk_id, guia, fecha_vigencia, seccion, pagina, texto): graded or with a clear deontic verb.

    A sentence whose first 120 characters, spaces levelled, were had before in its guide is dropped; the rest of a chunk are
    numbered from 0.
    """
    s = chunks.select("chunk_id", "guia", "fecha_vigencia", "seccion", "pagina", F.posexplode(tx.sentences(F.col("texto"))).alias("pos", "frase"))
    told = s.withColumn("grado", tx.grade(F.col("frase"))).withColumn("accion", tx.deontic(F.col("frase"))).where("grado is not null or accion <> 'sin_determinar'")
    key = F.left(F.regexp_replace(F.lower("frase"), r"\s+", " "), F.lit(120))
    first = keep_first(told.withColumn("clave", key), ["guia", "clave"], "chunk_id", "pos")
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos")) - 1
    return first.select(F.concat("chunk_id", F.lit("::rec"), n).alias("id"), "chunk_id", "guia", "fecha_vigencia", "seccion", "pagina", F.col("frase").alias("texto"), "grado", "accion")
