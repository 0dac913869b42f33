"""The conversation log: registration, retention, feedback, preferences and context.

A turn is (thread_id, turn_id, ...); repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumbre.functions import text as tx

# Preferences that may be set, with their admissible values (none: any).
PREFERENCES = {"verbosidad": ["conciso", "detallado"], "mostrar_grado_evidencia": ["true", "false"], "listar_opciones_descartadas": ["true", "false"], "formato_cita": None, "tono": None, "idioma": None, "subespecialidad": None}
# What a doctor's question says about the preferred form.
DETECTORS = [
    ("verbosidad", "conciso", r"(?iuU)\b(m[aá]s\s+(?:corto|breve|conciso)|res[uú]me|abrevia|demasiado\s+largo)\b"),
    ("verbosidad", "detallado", r"(?iuU)\b(m[aá]s\s+detalle|amplia|exp[ll]ica\s+mejor|m[aá]s\s+extenso)\b"),
    ("mostrar_grado_evidencia", "true", r"(?iuU)\b(grado|nivel)\s+de\s+evidencia\b"),
    ("listar_opciones_descartadas", "true", r"(?iuU)\b(qu[eé]\s+se\s+descarta|opciones?\s+descartad|por\s+qu[eé]\s+no)\b"),
]


def moment(ts: Column) -> Column:
    """Timestamp of the spellings in use: ISO with T or blank, with zone or fraction, day first with slashes, compact."""
    iso = F.try_to_timestamp(F.regexp_replace(F.trim(ts), "Z$", ""))
    return F.coalesce(iso, F.try_to_timestamp(F.trim(ts), F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(F.trim(ts), F.lit("dd/MM/yyyy HH:mm")), F.try_to_timestamp(F.trim(ts), F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(F.trim(ts), F.lit("yyyyMMdd'T'HHmmss")))


def register(turns: DataFrame, days: int = 365) -> DataFrame:
    """Turns as they are stored: text scrubbed, identifiers counted, risk of the original text, date until which they are kept."""
    clean, count, kinds = tx.scrub(F.col("texto"))
    level, reasons = tx.risk(F.col("texto"))
    return turns.select("thread_id", "turn_id", "user_id", "role", clean.alias("texto"), count.alias("pii_directos"), kinds.alias("tipos"), level.alias("riesgo_reident"), reasons.alias("motivos_riesgo"), F.date_format(F.date_add(F.to_date(moment(F.col("ts"))), days), "yyyy-MM-dd").alias("retener_hasta"))


def numbered(rows: DataFrame, thread: str, order: str, block: int = 100_000) -> DataFrame:
    """Rows (thread, order) with their place n from 1 in each thread; repeated rows count once.

    Numbered in runs of ``block`` order values whose counts are added up, so a thread with a third of all rows is no
    single task.
    """
    distinct = rows.select(thread, order).where(F.col(thread).isNotNull() & F.col(order).isNotNull()).distinct().withColumn("__run", F.floor(F.col(order) / block))
    inner = distinct.withColumn("__n", F.row_number().over(Window.partitionBy(thread, "__run").orderBy(order)))
    sizes = distinct.groupBy(thread, "__run").agg(F.count("*").alias("__c"))
    before = sizes.select(thread, "__run", (F.sum("__c").over(Window.partitionBy(thread).orderBy("__run")) - F.col("__c")).alias("__before"))
    return inner.join(before, [thread, "__run"]).select(thread, order, (F.col("__n") + F.col("__before")).cast("long").alias("n"))


def keep(turns: DataFrame, today: Column) -> DataFrame:
    """Turns whose retention date is not past; those without a date are kept."""
    until = F.to_date("retener_hasta")
    return turns.where(until.isNull() | (until >= today))


def apply_feedback(turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """Turns with the feedback (thread_id, turn_id, pulgar, edicion) laid over what they had; keys without a turn are ignored."""
    news = feedback.groupBy("thread_id", "turn_id").agg(F.max("pulgar").alias("__p"), F.max("edicion").alias("__e"))
    joined = turns.join(news, ["thread_id", "turn_id"], "left")
    return joined.withColumn("feedback_pulgar", F.coalesce("__p", "feedback_pulgar")).withColumn("edicion_medico", F.coalesce("__e", "edicion_medico")).drop("__p", "__e")


def infer(turns: DataFrame, least: int = 3, profile: DataFrame | None = None) -> DataFrame:
    """Proposals (user_id, clave, valor, n) where at least ``least`` of a user's questions show a preference.

    Of two values of a preference the one shown more often is proposed, by name if equally often; what the profile
    (user_id, clave, valor) has already is not.
    """
    asked = turns.where("role = 'medico' and user_id is not null").dropDuplicates(["thread_id", "turn_id"])
    signs = F.array(*[F.when(F.col("texto").rlike(p), F.struct(F.lit(k).alias("clave"), F.lit(v).alias("valor"))) for k, v, p in DETECTORS])
    shown = asked.select("user_id", F.explode(F.filter(signs, lambda s: s.isNotNull())).alias("s")).groupBy("user_id", "s.clave", "s.valor").agg(F.count("*").alias("n")).where(f"n >= {least}")
    if profile is not None:
        shown = shown.join(profile.select("user_id", "clave", "valor"), ["user_id", "clave", "valor"], "left_anti")
    order = Window.partitionBy("user_id", "clave").orderBy(F.desc("n"), "valor")
    return shown.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def valid_preferences(changes: DataFrame) -> DataFrame:
    """Changes (user_id, clave, valor, fuente) with a reason (motivo) where they are not admissible, null otherwise."""
    allowed = F.create_map(*[x for k, v in PREFERENCES.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]) if v else F.array().cast("array<string>"))])
    values = F.element_at(allowed, F.col("clave"))
    reason = F.when(values.isNull(), "clave").when((F.size(values) > 0) & ~F.array_contains(values, F.col("valor")), "valor").when(~F.col("fuente").isin("explicita", "inferida_confirmada"), "fuente")
    return changes.withColumn("motivo", reason)


def relevant(queries: DataFrame, turns: DataFrame, k: int = 3, least: int = 1) -> DataFrame:
    """Rows (query_id, thread_id, turn_id, overlap): earlier turns of the query's thread that share most words with it.

    ``queries``: (query_id, thread_id, turn_id, texto). Ties go to the later turn. Only shared words are joined, so a long
    thread costs its turns that share a word.
    """
    asked = queries.select("query_id", "thread_id", F.col("turn_id").alias("before"), F.explode(tx.memory_tokens(F.col("texto"))).alias("word"))
    had = turns.dropDuplicates(["thread_id", "turn_id"]).select("thread_id", "turn_id", F.explode(tx.memory_tokens(F.col("texto"))).alias("word"))
    shared = asked.join(had, ["thread_id", "word"]).where("turn_id < before").groupBy("query_id", "thread_id", "turn_id").agg(F.count("*").alias("overlap")).where(f"overlap >= {least}")
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("turn_id"))
    return shared.withColumn("rn", F.row_number().over(order)).where(f"rn <= {k}").drop("rn")


def context(queries: DataFrame, turns: DataFrame, k: int = 3, recent: int = 2) -> DataFrame:
    """Rows (query_id, context): the last ``recent`` earlier turns and the relevant ones, each once, in order, as lines."""
    distinct = turns.dropDuplicates(["thread_id", "turn_id"])
    # the places before the query's own are looked up, no thread is sorted for a query
    places = numbered(turns.select("thread_id", "turn_id").unionByName(queries.select("thread_id", "turn_id")), "thread_id", "turn_id")
    own = queries.select("query_id", "thread_id", "turn_id").distinct().join(places, ["thread_id", "turn_id"]).select("query_id", "thread_id", F.explode(F.sequence(F.lit(1), F.lit(recent))).alias("back"), "n").select("query_id", "thread_id", (F.col("n") - F.col("back")).alias("n"))
    last = own.join(places, ["thread_id", "n"]).select("query_id", "thread_id", "turn_id")
    chosen = last.unionByName(relevant(queries, turns, k).select("query_id", "thread_id", "turn_id")).distinct()
    lines = chosen.join(distinct.select("thread_id", "turn_id", "role", "texto"), ["thread_id", "turn_id"]).select("query_id", "turn_id", F.concat(F.lit("["), "role", F.lit("] "), F.coalesce("texto", F.lit(""))).alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "line"))), lambda s: s["line"]), "\n").alias("context"))
