"""Queries that put the operators together as a question-answering system does: dense and hybrid retrieval, layered graph
search, judges' pools, verdicts, and the lists its screens show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumbre.functions import providers, similarity as sim, text as tx
from lumbre.operators import chunking, graph, layered, pools, retrieval, seeding
from lumbre.plans.search import Q, _es, _links, _mentions, _pl, _spanish, _texts, all_questions, passages, questions
from lumbre.plans.texts import CHUNKS, _chunks, _q, analyze_sql, tokens_sql
from lumbre.sources.store import materialize, table


def _asked(spark, d):
    return questions(spark, d).select("query_id", providers.embedder()(F.col("text")).alias("v"))


def _dense_passages(spark, d, k):
    vectors = passages(spark, d).where("text is not null").select("id", providers.embedder()(F.col("text")).alias("v"))
    return retrieval.dense(_asked(spark, d), vectors, k)


def dense_passages(spark, d):
    return _dense_passages(spark, d, 10)


def hybrid(spark, d):
    """Lexical and dense pools of 50 fused for every doctor's message, the dense one counting three times."""
    return pools.hybrid(all_questions(spark, d), _texts(spark, d), providers.embedder(), 10, 50, 1.0, 3.0)


def judge_pool(spark, d):
    """Pool of 30 by fusion, then 15 with every guide's best first."""
    pool = retrieval.fuse([(_spanish(spark, d, 30), 1.0), (_dense_passages(spark, d, 30), 1.0)], 30)
    return retrieval.diverse(pool, _chunks(spark, d, "guia").select(F.col("chunk_id").alias("id"), F.col("guia").alias("grp")), 15)


def scored_rerank(spark, d):
    """The lexical pool of 50 reordered by a pair scorer."""
    pairs = _spanish(spark, d, 50).join(questions(spark, d), "query_id").join(passages(spark, d).withColumnRenamed("text", "passage"), "id")
    return retrieval.top(pairs.select("query_id", "id", providers.overlap_scorer(F.col("text"), F.col("passage")).alias("score")), 10, 5)


def _facts(spark, d):
    """Normative sentences as facts: (id, chunk, entities, v)."""
    named = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.array_distinct(F.flatten(F.collect_set("farmacos"))).alias("farmacos"))
    r = chunking.recommendations(_chunks(spark, d, "guia", "fecha_vigencia", "seccion", "pagina", "texto"))
    joined = r.select(F.concat(F.lit("fact:"), "id").alias("id"), "chunk_id", "texto").join(named, "chunk_id")
    names = F.array_intersect(tx.tokens(F.col("texto")), F.coalesce("farmacos", F.array().cast("array<string>")))
    return joined.select("id", F.concat(F.lit("chunk:"), "chunk_id").alias("chunk"), F.transform(names, lambda n: F.concat(F.lit("ent:"), n)).alias("entities"), providers.embedder()(F.col("texto")).alias("v"))


def layered_search(spark, d):
    """Graph search from facts, passages, named entities and their concepts."""
    facts = materialize(_facts(spark, d))
    chunks = table(spark, d, "chunks").where("chunk_id is not null")
    mentions = materialize(chunks.select(F.col("chunk_id").alias("id"), F.explode_outer("farmacos").alias("entity")).distinct())
    asked = materialize(_asked(spark, d))
    frequency = materialize(mentions.where("entity is not null").groupBy(F.concat(F.lit("ent:"), "entity").alias("node")).agg(F.count("*").alias("n")))
    named = questions(spark, d).select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("e")).select("query_id", F.concat(F.lit("ent:"), "e").alias("node")).join(frequency.select("node"), "node", "left_semi").select("query_id", "node")
    vectors = pools.vector_blocks(pools.in_order(passages(spark, d)).select("id", providers.embedder()(F.col("text")).alias("v")))
    dense = pools.nearest(asked, vectors, 100).select("query_id", F.concat(F.lit("chunk:"), "id").alias("id"), "score")
    added = [seeding.fact_seeds(asked, facts, frequency), seeding.passage_seeds(dense), named.select("query_id", "node", F.lit(0.05).alias("weight"))]
    floors = [seeding.concept_seeds(named, _links(spark, d))]
    seeds = materialize(seeding.layered(added, floors))
    placed = seeds.select("query_id", F.when(F.startswith("node", F.lit("ent:")), "entity").when(F.startswith("node", F.lit("chunk:")), "item").otherwise("other").alias("kind"), F.regexp_replace("node", "^(ent|chunk):", "").alias("key"), "weight")
    own = facts.select("id", F.substr("chunk", F.lit(7)).alias("item"), F.transform("entities", lambda e: F.substr(e, F.lit(5))).alias("entities"), "v")
    return layered.mention_search(asked, own, mentions, placed, 10)


def question_edges(spark, d):
    """Doctors' questions as open ones, answers as those that settle them, by thread."""
    m = table(spark, d, "messages").where("content is not null and thread_id is not null").select("id", "thread_id", "role", "content").distinct()
    shaped = m.select("id", F.col("thread_id").alias("item"), "role", F.array_distinct(tx.analyze(F.col("content"))).alias("words"), providers.embedder()(F.col("content")).alias("v"))
    return seeding.question_edges(shaped.where("role = 'medico' and id % 100 = 0"), shaped.where("role = 'asistente'"))


def prompt_context(spark, d):
    """The passages a prompt gets, numbered, at most eight."""
    cited = _spanish(spark, d, 8).join(_chunks(spark, d, "guia", "pagina", "texto"), F.col("id") == F.col("chunk_id"))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("guia", F.lit("?")), F.lit(": "), F.left("texto", F.lit(300)))
    return cited.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("contexto"))


def verdict_merge(spark, d):
    """Verdicts after the numeric lens: with a finding, faithful becomes partial."""
    from lumbre.plans.records import numeric_lens

    m = table(spark, d, "messages").where("role = 'asistente' and veredicto is not null").select("id", "veredicto").distinct()
    found = numeric_lens(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return m.join(found, "id", "left").select("id", F.when((n > 0) & (F.col("veredicto") == "fiel"), "parcial").otherwise(F.col("veredicto")).alias("veredicto"), n.alias("hallazgos"))


def next_step(spark, d):
    """What follows an answer: a human for serious questions, a second try when it is not faithful, else the end."""
    t = table(spark, d, "turns").where("role = 'asistente' and thread_id is not null").select("thread_id", "turn_id", "hitl", "abstenido", "guias_citadas", "nivel").distinct()
    guides = F.size(F.array_distinct(F.coalesce("guias_citadas", F.array().cast("array<string>"))))
    step = F.when(F.col("hitl"), "hitl").when(F.col("abstenido"), "abstenerse").when((F.col("nivel") >= 3) & (guides < 2), "reintentar").otherwise("responder")
    return t.select("thread_id", "turn_id", guides.cast("long").alias("guias"), step.alias("paso"))


def chunk_page(spark, d):
    """Chunks of a guide whose text has a word, with their total and position, the third page of ten."""
    c = _chunks(spark, d, "guia", "texto").where(F.contains(F.lower("texto"), F.lit("cociente")))
    placed = c.select("chunk_id", "guia", F.left("texto", F.lit(120)).alias("vista"), F.row_number().over(Window.partitionBy("guia").orderBy("chunk_id")).alias("n"))
    total = c.groupBy("guia").agg(F.count("*").alias("total"))
    return placed.where("n > 20 and n <= 30").join(total, "guia").select("chunk_id", "guia", "vista", "n", "total")


def anchor_states(spark, d):
    """Decisions by state: rejected, curated (a code), pending (a term or candidates but no code yet), without an anchor."""
    a = table(spark, d, "anchor_decisions").distinct()
    state = F.when(F.lower(F.trim("accion")) == "rechazar", "rechazado").when(F.col("sctid").isNotNull() | F.col("cui").isNotNull(), "curado").when(F.trim("termino") != "", "pendiente").otherwise("sin_anclar")
    return a.groupBy(state.alias("estado")).agg(F.count("*").alias("n"))


def close_terms(spark, d):
    """Closest reference terms of typed values by longest matching blocks, for those whose decision is divisible by 100."""
    choices = table(spark, d, "terminos").where("lat = 'SPA' and ispref = 'Y' and term_norm is not null").select(F.col("term_norm").alias("t")).distinct()
    # the whole list in blocks; the stated queries meet every block
    blocks = choices.groupBy(F.pmod(F.xxhash64("t"), F.lit(64)).alias("b")).agg(F.sort_array(F.collect_list("t")).alias("terms"))
    a = materialize(table(spark, d, "anchor_decisions").where("entidad is not null and decision_id % 100 = 0").select("decision_id", tx.fold(F.trim("entidad")).alias("x")).distinct())
    found = blocks.join(a).select("decision_id", F.explode(providers.close_in_block("x", "terms")).alias("m")).select("decision_id", "m.*")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("decision_id").orderBy(F.desc("ratio"), F.desc("term")))).where("n <= 10")
    joined = best.groupBy("decision_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda p: p["term"]), "|").alias("cercanos"))
    return a.join(joined, "decision_id", "left").select("decision_id", F.coalesce("cercanos", F.lit("")).alias("cercanos"))


def guide_sections(spark, d):
    """Section numbers of chunks and how many each guide has."""
    c = _chunks(spark, d, "guia", "seccion")
    return c.select("guia", tx.section_number(F.col("seccion")).alias("numero")).where("numero is not null").groupBy("guia").agg(F.count_distinct("numero").alias("secciones"), F.count("*").alias("fragmentos"))


def cache_keys(spark, d):
    return _chunks(spark, d, "texto").where("texto is not null").select("chunk_id", F.sha1("texto").alias("clave"), tx.file_safe(F.col("chunk_id")).alias("fichero"))


def type_frequency(spark, d):
    """Kinds of chunk by guide that occur at least twice, with their first fifty chunks as examples."""
    c = _chunks(spark, d, "guia", "tipo")
    counted = c.groupBy("guia", "tipo").agg(F.count("*").alias("n")).where("n >= 2")
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("guia", "tipo").orderBy("chunk_id"))).where("k <= 50")
    examples = first.groupBy("guia", "tipo").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("ejemplos"))
    return counted.join(examples, counted["guia"].eqNullSafe(examples["guia"]) & counted["tipo"].eqNullSafe(examples["tipo"])).select(counted["guia"], counted["tipo"], "n", "ejemplos")


def first_of_level(spark, d):
    """The first five turns of each level."""
    t = table(spark, d, "turns").where("nivel is not null and thread_id is not null").select(F.col("nivel").cast("int").alias("nivel"), F.concat("thread_id", F.lit("#"), "turn_id").alias("clave")).distinct()
    return t.withColumn("n", F.row_number().over(Window.partitionBy("nivel").orderBy("clave"))).where("n <= 5")


def _norms(spark, d):
    r = chunking.recommendations(_chunks(spark, d, "guia", "fecha_vigencia", "seccion", "pagina", "texto"))
    return r.select("id", "chunk_id", tx.tokens(F.col("texto")).alias("words"))


def recommendation_edges(spark, d):
    named = table(spark, d, "chunks").select(F.explode(F.array_distinct("farmacos")).alias("entity")).where("entity is not null").distinct()
    return graph.recommendation_edges(_norms(spark, d), named)


def concept_edges(spark, d):
    """Terms anchored to their codes, and is-a links between parents of the hierarchy's first codes that are anchored as well."""
    t = table(spark, d, "terminos").where("sctid is not null").select(F.col("term_norm").alias("entity"), F.col("sctid").alias("code")).distinct()
    return graph.concept_edges(t, _links(spark, d))


def flat_graph(spark, d):
    c = table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.col("farmacos").alias("entities")).distinct()
    return graph.flat_edges(c)


def hitl_trigger(spark, d):
    """Questions that go to a human: serious decisions, or a patient's without a figure."""
    q = table(spark, d, "messages").where("role = 'medico' and content is not null").select("id", "content").distinct()
    r = tx.route(F.col("content"))
    return q.select("id", (r["decision_seria"] | ((r["tipo_consulta"] == "paciente") & ~r["logica_numerica"])).alias("hitl"), tx.is_class_question(F.col("content")).alias("clase"))


def seeded_sample(spark, d):
    """Twenty messages of each role by a seeded hash of their id: the same whatever the partitions."""
    m = table(spark, d, "messages").where("role is not null").select("id", "role").distinct()
    return m.withColumn("n", F.row_number().over(Window.partitionBy("role").orderBy(F.xxhash64("id", F.lit(13)), "id"))).where("n <= 20").select("id", "role")


QUERIES = {
    f.__name__: f
    for f in (dense_passages, hybrid, judge_pool, scored_rerank, layered_search, question_edges, prompt_context, verdict_merge, next_step, chunk_page, anchor_states, close_terms, guide_sections, cache_keys, type_frequency, first_of_level, recommendation_edges, concept_edges, flat_graph, hitl_trigger, seeded_sample)
}


def _sql():
    from lumbre.plans.search import _UPS
    from lumbre.plans.texts import SQL as _TEXTS

    from lumbre.plans.records import SQL as records

    lens = records["numeric_lens"]
    recs = _TEXTS["recommendations"]
    return {
        "scored_rerank": f"with {CHUNKS}, {Q}, {_es('a', 50)}, s as (select query_id, id, round(len(list_intersect(list_distinct({analyze_sql('text')}), {analyze_sql('texto')})) / len(list_distinct({analyze_sql('text')})), 5) as score from a join q using (query_id) join c on chunk_id = id) select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10",
        "prompt_context": f"with {CHUNKS}, {Q}, {_es('a', 8)} select query_id, string_agg('[' || rank || '] ' || coalesce(guia, '?') || ': ' || left(texto, 300), chr(10) order by rank) as contexto from a join c on chunk_id = id group by query_id",
        "verdict_merge": f"with l as ({lens}), n as (select id, count(*) as n from l group by id), m as (select distinct id, veredicto from messages where role = 'asistente' and veredicto is not null) select id, case when coalesce(n, 0) > 0 and veredicto = 'fiel' then 'parcial' else veredicto end as veredicto, coalesce(n, 0) as hallazgos from m left join n using (id)",
        "next_step": "with t as (select distinct thread_id, turn_id, hitl, abstenido, len(list_distinct(coalesce(guias_citadas, []))) as guias, nivel from turns where role = 'asistente' and thread_id is not null) select thread_id, turn_id, guias, case when hitl then 'hitl' when abstenido then 'abstenerse' when nivel >= 3 and guias < 2 then 'reintentar' else 'responder' end as paso from t",
        "chunk_page": f"with {CHUNKS}, w as (select chunk_id, guia, left(texto, 120) as vista, row_number() over (partition by guia order by chunk_id) as n, count(*) over (partition by guia) as total from c where contains(lower(texto), 'cociente')) select * from w where n > 20 and n <= 30",
        "recommendation_edges": f"with r as ({recs}), w as (select id, unnest(list_distinct({tokens_sql('texto')})) as entity from r), h as (select * from w where entity in (select unnest(farmacos) from chunks) qualify row_number() over (partition by id order by entity) <= 12) select 'chunk:' || regexp_replace(id, '::rec[0-9]+$', '') as src, 'rec:' || id as dst, 'CONTIENE_RECOMENDACION' as rel from r union select 'ent:' || entity, 'rec:' || id, 'MENCIONADA_EN_REC' from h",
        "concept_edges": f"with {_UPS}, t as (select distinct term_norm, sctid from terminos where sctid is not null and term_norm is not null) select 'ent:' || term_norm as src, 'sct:' || sctid as dst, 'ANCLADA_A' as rel from t union select 'sct:' || child, 'sct:' || parent, 'IS_A' from l where child in (select sctid from t) and parent in (select sctid from t)",
        "flat_graph": "with c as (select distinct chunk_id, farmacos as f from chunks where chunk_id is not null and len(farmacos) > 1), p as (select f[i] as src, f[i + 1] as dst from (select f, unnest(range(1, len(f))) as i from c)) select src, dst, count(*) as n from p where src <> dst group by src, dst",
        "hitl_trigger": f"select distinct id, regexp_matches(content, '{_q(tx.SERIOUS)}') or (regexp_matches(content, '{_q(tx.PATIENT)}') and not regexp_matches(content, '{_q(tx.NUMERIC)}')) as hitl, regexp_matches(content, '{_q(tx.CLASS_QUESTION)}') as clase from messages where role = 'medico' and content is not null",
        "anchor_states": "select case when lower(trim(accion)) = 'rechazar' then 'rechazado' when sctid is not null or cui is not null then 'curado' when trim(termino) <> '' then 'pendiente' else 'sin_anclar' end as estado, count(*) as n from (select distinct * from anchor_decisions) group by estado",
        "guide_sections": f"with {CHUNKS}, s as (select guia, nullif(regexp_extract(seccion, '^\\s*(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,3}})', 1), '') as numero from c) select guia, count(distinct numero) as secciones, count(*) as fragmentos from s where numero is not null group by guia",
        "cache_keys": f"with {CHUNKS} select chunk_id, sha1(texto) as clave, regexp_replace(chunk_id, '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g') as fichero from c where texto is not null",
        "type_frequency": "with c as (select distinct chunk_id, guia, tipo from chunks where chunk_id is not null) select guia, tipo, count(*) as n, array_to_string(list_sort(list(chunk_id))[1:50], ',') as ejemplos from c group by guia, tipo having n >= 2",
        "first_of_level": "with t as (select distinct cast(nivel as int) as nivel, thread_id || '#' || turn_id as clave from turns where nivel is not null and thread_id is not null) select nivel, clave, row_number() over (partition by nivel order by clave) as n from t qualify n <= 5",
    }


SQL = _sql()
