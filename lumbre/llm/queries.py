"""Queries of the subpackage, their SQL, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbre.llm import mapping, mixing, neardup, packing, pairs, pii, scans, splitting, topics
from lumbre.sources.store import materialize, table


def _personal(spark: SparkSession, d: str) -> DataFrame:
    """Doctor and assistant texts and already treated texts as rows (origen, clave, texto)."""
    turns = table(spark, d, "turns").select(F.lit("turns").alias("origen"), F.concat("thread_id", F.lit("#"), "turn_id").alias("clave"), "texto")
    messages = table(spark, d, "messages").select(F.lit("messages").alias("origen"), F.col("id").cast("string").alias("clave"), F.col("content").alias("texto"))
    results = table(spark, d, "pii_results").select(F.lit("pii_results").alias("origen"), F.col("result_id").cast("string").alias("clave"), "texto")
    return turns.unionByName(messages).unionByName(results).where("clave is not null")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.scan(_personal(spark, d), "texto", ["origen", "clave"]).select("origen", "clave", F.explode("kinds").alias("tipo")).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.scan(_personal(spark, d), "texto", ["origen", "clave"]).select("origen", "clave", F.col("redacted").alias("texto")).dropDuplicates(["origen", "clave"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_rows(table(spark, d, "chunks"), "chunk_id", "texto", shingle=3, threshold=0.5)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.similar_groups(table(spark, d, "chunks"), "chunk_id", "texto", shingle=3, threshold=0.5)
    return groups.select(F.col("id").alias("chunk_id"), F.col("group").alias("grupo"), F.col("copies").alias("copias"), F.col("links").alias("enlaces"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages").select("id", "thread_id", "role", "content")
    model = pairs.fit_terminal(messages.where("role = 'asistente'"), "id", "content")
    answers = pairs.answer_pairs(messages, "id", "thread_id", "role", "content", "medico", "asistente")
    return pairs.defects(answers, model).select("id", F.col("defect").alias("defecto")).distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_long(table(spark, d, "chunks"), "chunk_id", "texto", ["seccion", "pagina"])
    return cut.select("chunk_id", F.col("piece").alias("pieza"), F.col("start").alias("inicio"), F.col("end").alias("fin"), F.col("piece_text").alias("texto"), "seccion", "pagina")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("pieza = 2").select("chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    decisions = table(spark, d, "anchor_decisions").select(F.lit("anchor_decisions").alias("origen"), F.col("decision_id").alias("clave"), F.col("entidad").alias("value"))
    candidates = table(spark, d, "candidates").select(F.lit("candidates").alias("origen"), F.col("cand_id").alias("clave"), F.col("termino").alias("value"))
    rows = decisions.unionByName(candidates).where("clave is not null and value is not null")
    mapped = mapping.map_values(rows, "value", table(spark, d, "terminos"), "term_norm", "cui")
    return rows.join(mapped, "value").select("origen", "clave", F.col("key").alias("cui")).distinct()


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and chunks as rows (origen, clave, texto, size_max)."""
    blocks = table(spark, d, "blocks").select(F.lit("blocks").alias("origen"), F.concat("doc_id", F.lit("#"), "ord").alias("clave"), "texto", "size_max")
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("origen"), F.col("chunk_id").alias("clave"), "texto", F.lit(None).cast("double").alias("size_max"))
    return blocks.unionByName(chunks).where("clave is not null")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _scanned(spark, d)
    return scans.clean(rows, "texto", ["origen", "clave"], scans.lexicon(rows, "texto"), "size_max").select("origen", "clave", F.explode("kinds").alias("ruido")).distinct()


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs free of noise of the documents of blocks and of every chunk, which is a document by itself (doc_id = chunk_id)."""
    rows = _scanned(spark, d)
    lex = scans.lexicon(rows, "texto")
    blocks = scans.clean(table(spark, d, "blocks").where("doc_id is not null"), "texto", ["doc_id", "ord"], lex, "size_max")
    chunks = scans.clean(table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "texto").distinct(), "texto", ["chunk_id"], lex)
    made = scans.paragraphs(blocks, "doc_id", "ord", "repaired").select(F.lit("blocks").alias("origen"), "doc_id", "number", "text")
    made = made.unionByName(scans.passage_paragraphs(chunks, "chunk_id", "repaired").select(F.lit("chunks").alias("origen"), F.col("chunk_id").alias("doc_id"), "number", "text"))
    return made.select("origen", "doc_id", F.col("number").alias("parrafo"), F.col("text").alias("texto"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    model = topics.fit(documents, table(spark, d, "doc_labels"), table(spark, d, "subject_areas"))
    return topics.score(documents, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d).select("doc_id", F.explode("areas").alias("area")).distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each area, and of none, over all documents."""
    areas = _topics(spark, d).dropDuplicates(["doc_id"]).select(F.explode_outer("areas").alias("area"))
    return areas.groupBy(F.coalesce("area", F.lit("(ninguna)")).alias("area")).agg(F.count("*").alias("documentos"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", F.lower(F.trim("source")).alias("source"))
    clusters = neardup.similar_groups(documents, "doc_id", "text").where("copies > 1 or links > 0").select(F.col("id").alias("key"), F.col("group").alias("cluster"))
    items = packing.sized(documents, "doc_id", "text", carry=["source"]).join(clusters, "key", "left")
    return packing.pack(materialize(items))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(F.col("container").alias("contenedor"), F.col("key").alias("doc_id"), F.col("part").alias("parte"), F.col("first").alias("primero"), "tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = materialize(mixing.measured(table(spark, d, "documents")))
    return mixing.mix(items, table(spark, d, "source_weights"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p9_selection": p9_selection, "p9_shares": p9_shares, "p10_found": p10_found, "p10_composition": p10_composition, "p6_found": p6_found, "p7_found": p7_found, "p7_paragraphs": p7_paragraphs, "p1_found": p1_found, "p1_redacted": p1_redacted, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p2_found": p2_found, "p2_groups": p2_groups}
SQL: dict[str, str] = {
    "p5_found": "select distinct chunk_id from chunks where length(texto) > 1500 and chunk_id is not null",
}
