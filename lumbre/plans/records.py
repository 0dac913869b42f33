"""Queries over the terminology, the conversation log, evaluations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbre.functions import text as tx
from lumbre.operators import evaluation, graph, linking, memory
from lumbre.plans.search import Q, _UPS, _es, _levels, _links, _spanish, questions
from lumbre.plans.texts import CHUNKS, _chunks, _list, _q, _scrub_sql, risk_sql, trigrams_sql
from lumbre.sources.store import table


# ---- terminology
def _values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct typed values (value, norm): folded, without surrounding spaces."""
    both = table(spark, d, "anchor_decisions").select(F.col("entidad").alias("value")).unionByName(table(spark, d, "candidates").select(F.col("termino").alias("value")))
    return both.where("value is not null").distinct().select("value", tx.fold(F.trim("value")).alias("norm")).where("norm <> ''")


def _terms(spark, d):
    return table(spark, d, "terminos")


def link_exact(spark, d):
    return linking.exact(_values(spark, d), _terms(spark, d))


def link_fuzzy(spark, d):
    return linking.fuzzy(_values(spark, d), _terms(spark, d))


def anchor_decision(spark, d):
    v, t = _values(spark, d), _terms(spark, d)
    both = linking.exact(v, t).unionByName(linking.fuzzy(v, t)).groupBy("value", "cui").agg(F.max("score").alias("score"))
    return linking.anchor(both)


def best_code(spark, d):
    return linking.best_code(_terms(spark, d), _links(spark, d))


def class_members(spark, d):
    links = _links(spark, d)
    tops = links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    return linking.class_members(links, tops, links.select(F.col("parent").alias("member"), F.col("child").alias("item")))


def anchor_summary(spark, d):
    a = table(spark, d, "anchor_decisions").distinct()
    accion = F.lower(F.trim("accion"))
    return a.agg(F.count("*").alias("total"), F.count_if(accion == "aprobar").alias("aprobados"), F.count_if(accion == "rechazar").alias("rechazados"), F.count_if(F.col("sctid").isNull() & F.col("cui").isNull()).alias("sin_codigo"), F.count_distinct("curador").alias("curadores"))


def anchor_queue(spark, d):
    """Candidates waiting for a decision, worst first: by method, then score; 200 of them, as a screen shows."""
    c = table(spark, d, "candidates").distinct()
    rank = F.when(F.col("metodo") == "fuzzy", 0).when(F.col("metodo") == "manual", 1).otherwise(2)
    return c.where("sctid is null and termino is not null").orderBy(rank, "score", "cand_id").limit(200).select("cand_id", "termino", "metodo", "score")


def decision_replay(spark, d):
    a = table(spark, d, "anchor_decisions").distinct().withColumn("clave", tx.fold(F.trim("entidad"))).where("clave <> ''")
    return linking.latest(a, "clave", "decidido_en", "decision_id").select("clave", "decision_id", F.lower(F.trim("accion")).alias("accion"))


def dictionary(spark, d):
    c = table(spark, d, "candidates").where("cui is not null and termino is not null").distinct()
    return linking.consolidate(c.select(F.col("cand_id").alias("pos"), F.col("cui").alias("name"), F.col("sab").alias("kind"), F.col("termino").alias("alias"))).select("name", "kind", F.array_join("aliases", "|").alias("aliases"), "n")


def dictionary_merge(spark, d):
    t = _terms(spark, d).where("cui is not null").distinct()
    names = t.groupBy("term_norm").agg(F.collect_set("term").alias("aliases")).select(F.col("term_norm").alias("name"), "aliases")
    target = t.groupBy("cui").agg(F.min("term_norm").alias("target"))
    merges = t.join(target, "cui").groupBy(F.col("term_norm").alias("name")).agg(F.min("target").alias("target"))
    return linking.merge_synonyms(names, merges).select("name", F.array_join("aliases", "|").alias("aliases"))


# ---- conversation log
def _turns(spark, d):
    return table(spark, d, "turns").where("thread_id is not null and turn_id is not null")


def register_turns(spark, d):
    r = memory.register(_turns(spark, d).select("thread_id", "turn_id", "user_id", "role", "texto", "ts").where("texto is not null").distinct())
    return r.select("thread_id", "turn_id", "texto", F.col("pii_directos").cast("long").alias("pii_directos"), "riesgo_reident")


def turn_numbers(spark, d):
    return memory.numbered(table(spark, d, "messages"), "thread_id", "id").select("thread_id", "id", F.col("n").alias("turno"))


def retention_purge(spark, d):
    kept = memory.keep(_turns(spark, d).select("thread_id", "turn_id", "retener_hasta").distinct(), F.to_date(F.lit("2025-03-01")))
    return kept.select("thread_id", "turn_id")


def feedback_upsert(spark, d):
    """Edits of the log's own feedback, as if reported anew, laid over turns stripped of it."""
    t = _turns(spark, d).select("thread_id", "turn_id", "feedback_pulgar", "edicion_medico").distinct()
    bare = t.withColumn("feedback_pulgar", F.lit(None).cast("int")).withColumn("edicion_medico", F.lit(None).cast("string"))
    news = t.where("feedback_pulgar is not null or edicion_medico is not null").select("thread_id", "turn_id", F.col("feedback_pulgar").alias("pulgar"), F.col("edicion_medico").alias("edicion"))
    return memory.apply_feedback(bare, news).select("thread_id", "turn_id", F.coalesce("feedback_pulgar", F.lit(0)).alias("pulgar"), F.coalesce("edicion_medico", F.lit("")).alias("edicion"))


def preference_inference(spark, d):
    return memory.infer(_turns(spark, d), 2)


def _log(spark, d):
    return table(spark, d, "messages").where("thread_id is not null").select("thread_id", F.col("id").alias("turn_id"), "role", F.col("content").alias("texto"))


def _asked(spark, d):
    return _log(spark, d).where("role = 'medico' and texto is not null and turn_id % 100 = 0").distinct().withColumn("query_id", F.col("turn_id"))


def relevant_turns(spark, d):
    return memory.relevant(_asked(spark, d), _log(spark, d)).select("query_id", "turn_id", "overlap")


def context_window(spark, d):
    return memory.context(_asked(spark, d), _log(spark, d))


def retention_dates(spark, d):
    t = _turns(spark, d).select("thread_id", "turn_id", "ts").distinct()
    return t.select("thread_id", "turn_id", memory.moment(F.col("ts")).isNotNull().alias("legible"))


# ---- verification of answers
_ABSTAIN = ("no recogen", "no cubre")


def abstention_flag(spark, d):
    m = table(spark, d, "messages").where("role = 'asistente' and content is not null").select("id", "content").distinct()
    low = F.lower("content")
    return m.select("id", (F.contains(low, F.lit(_ABSTAIN[0])) | F.contains(low, F.lit(_ABSTAIN[1]))).alias("abstiene"))


def numeric_lens(spark, d):
    """Figures with a unit in answers that no chunk of the cited guide and page has."""
    m = table(spark, d, "messages").where("role = 'asistente' and content is not null").select("id", "content", "citations").distinct()
    figures = m.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(tx.FIGURE), F.lit(1)))).alias("f")).select("id", F.regexp_replace("f", ",", ".").alias("valor")).distinct()
    cited = m.where("citations is not null").select("id", F.explode(F.from_json("citations", "array<struct<guia:string,pagina:int>>")).alias("c")).select("id", "c.guia", "c.pagina").distinct()
    pages = _chunks(spark, d, "guia", "pagina", "texto").where("texto is not null").select("guia", "pagina", F.regexp_replace(F.lower("texto"), ",", ".").alias("texto"))
    # joined by page, so a figure meets the few chunks of the pages cited, not all
    support = figures.join(cited, "id").join(pages, ["guia", "pagina"]).where(F.contains("texto", F.col("valor"))).select("id", "valor").distinct()
    return figures.join(support, ["id", "valor"], "left_anti")


def deontic_lens(spark, d):
    """Answers that advise a drug which a normative sentence of a cited guide advises against."""
    from lumbre.operators import chunking

    m = table(spark, d, "messages").where("role = 'asistente' and content is not null and citations is not null").select("id", "content", "citations").distinct()
    sentences = m.select("id", "citations", F.explode(tx.loose_sentences(F.col("content"))).alias("frase")).where(F.col("frase").rlike(tx.ADVISES) & ~F.col("frase").rlike(tx.DENIES))
    named = table(spark, d, "chunks").select(F.explode(F.array_distinct("farmacos")).alias("farmaco")).distinct()
    words = sentences.select("id", F.from_json("citations", "array<struct<guia:string>>").alias("c"), F.explode(F.array_distinct(tx.tokens(F.col("frase")))).alias("farmaco"))
    advised = words.join(named, "farmaco", "left_semi").select("id", F.explode(F.array_distinct("c.guia")).alias("guia"), "farmaco").distinct()
    norms = chunking.recommendations(_chunks(spark, d, "guia", "fecha_vigencia", "seccion", "pagina", "texto")).where("accion in ('no_recomendado', 'generalmente_no_recomendado')")
    against = norms.select("guia", F.explode(F.array_distinct(tx.tokens(F.col("texto")))).alias("farmaco")).join(named, "farmaco", "left_semi").distinct()
    return advised.join(against, ["guia", "farmaco"]).select("id", "guia", "farmaco").distinct()


# ---- evaluation
def _gold(spark, d):
    """Guides and sections that the answer to a question cites: the next answer of the thread, by id."""
    m = table(spark, d, "messages").where("thread_id is not null and role in ('medico', 'asistente')").select("id", "thread_id", "role", "citations", "model").distinct()
    asked = questions(spark, d).select("query_id")
    threads = m.join(asked, m["id"] == asked["query_id"]).select("thread_id", "query_id")
    later = m.where("role = 'asistente'").join(threads, "thread_id").where("id > query_id").groupBy("query_id").agg(F.min_by(F.struct("citations", "model"), "id").alias("a"))
    cited = later.select("query_id", F.coalesce("a.model", F.lit("?")).alias("model"), F.explode_outer(F.from_json("a.citations", "array<struct<guia:string,seccion:string>>")).alias("c"))
    return cited.select("query_id", "model", F.col("c.guia").alias("guia"), F.col("c.seccion").alias("seccion"))


def _guide_hits(spark, d, k=20):
    return _spanish(spark, d, k).join(_chunks(spark, d, "guia", "seccion"), F.col("id") == F.col("chunk_id")).select("query_id", "rank", "guia", "seccion")


def _recalls(spark, d):
    gold = _gold(spark, d).where("guia is not null")
    scores = evaluation.recall(_guide_hits(spark, d).select("query_id", F.col("guia").alias("item"), "rank"), gold.select("query_id", F.col("guia").alias("item")), [1, 5, 10, 20])
    return scores.join(gold.select("query_id", "model").distinct(), "query_id")


def recall_at_k(spark, d):
    return evaluation.summary(_recalls(spark, d), "model")


def first_hit_rank(spark, d):
    gold = _gold(spark, d).where("guia is not null").select("query_id", F.col("guia").alias("item"))
    found = evaluation.first_rank(_guide_hits(spark, d).select("query_id", F.col("guia").alias("item"), "rank"), gold)
    return found.select("query_id", F.coalesce("rank", F.lit(0)).alias("puesto"))


def failure_taxonomy(spark, d):
    gold = _gold(spark, d)
    hits = _guide_hits(spark, d)
    known = gold.where("guia is not null")
    by_guide = hits.join(known.select("query_id", "guia").distinct(), ["query_id", "guia"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("g"))
    sections = hits.select("query_id", "guia", "rank", F.regexp_replace("seccion", r"^[\d.]+\s+", "").alias("seccion"))
    by_section = sections.join(known.select("query_id", "guia", "seccion").distinct(), ["query_id", "guia", "seccion"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("s"))
    every = gold.groupBy("query_id").agg(F.count("guia").alias("n"))
    return every.join(by_guide, "query_id", "left").join(by_section, "query_id", "left").groupBy(evaluation.failure(F.col("n") > 0, F.col("g"), F.col("s")).alias("causa")).agg(F.count("*").alias("n"))


def confusion_by_level(spark, d):
    t = _turns(spark, d).where("role = 'asistente'").select("thread_id", "turn_id", "nivel", "hitl", "riesgo_reident", "abstenido").distinct()
    return evaluation.confusion(t.withColumn("nivel", F.col("nivel").cast("int")), F.col("hitl"), F.col("abstenido") | (F.col("riesgo_reident") != "bajo"), "nivel")


def quality_rollup(spark, d):
    m = table(spark, d, "messages").where("role = 'asistente'").select("id", "model", "veredicto", "content", "citations").distinct()
    rolled = m.rollup("model").agg(F.grouping("model").alias("g"), F.count("*").alias("n"), F.count("veredicto").alias("juzgados"), F.count_if(F.col("veredicto") == "fiel").alias("fieles"), F.count("citations").alias("con_citas"))
    return rolled.select(F.when(F.col("g") == 1, "GLOBAL").otherwise(F.coalesce("model", F.lit("?"))).alias("model"), "n", "juzgados", "con_citas", F.round(F.try_divide("fieles", "juzgados"), 4).alias("fiel"))


def extraction_yield(spark, d):
    c = table(spark, d, "chunks").where("texto is not null").select("chunk_id", "guia", "texto", "umbrales").distinct()
    rolled = c.rollup("guia").agg(F.grouping("guia").alias("g"), F.sum(F.size(F.coalesce("umbrales", F.array().cast("array<string>")))).alias("extraidos"), F.sum(F.size(tx.thresholds(F.col("texto")))).alias("en_texto"))
    rate = F.try_divide("extraidos", "en_texto")
    return rolled.select(F.when(F.col("g") == 1, "GLOBAL").otherwise(F.coalesce("guia", F.lit("?"))).alias("guia"), F.col("extraidos").cast("long").alias("extraidos"), F.col("en_texto").cast("long").alias("en_texto"), F.coalesce(rate < 0.8, F.lit(False)).alias("perdida"))


def triple_coverage(spark, d):
    """Concepts of each source that a typed value names exactly (strict) or that a candidate carries the code of (lax)."""
    typed = _values(spark, d).select("norm").distinct()
    carried = table(spark, d, "candidates").where("cui is not null").select("cui").distinct().withColumn("lax", F.lit(1))
    t = _terms(spark, d).where("cui is not null").select("sab", "cui", "term_norm").distinct()
    strict = t.join(typed, t["term_norm"] == typed["norm"], "left_semi").select("sab", "cui").distinct().withColumn("strict", F.lit(1))
    every = t.select("sab", "cui").distinct().join(strict, ["sab", "cui"], "left").join(carried, "cui", "left")
    return every.groupBy("sab").agg(F.count("*").alias("conceptos"), F.count("strict").alias("exactos"), F.count(F.coalesce("strict", "lax")).alias("laxos"))


def stratified_sample(spark, d):
    t = _turns(spark, d).where("nivel is not null").select("nivel", F.concat("thread_id", F.lit("#"), "turn_id").alias("clave")).distinct()
    return evaluation.round_robin(t, "nivel", "clave", 100)


def bootstrap_ci(spark, d):
    ci = evaluation.bootstrap(_recalls(spark, d).select(F.concat_ws("@", F.lit("recall"), "k").alias("m"), "recall"), "recall", "m")
    return ci.select(F.col("grp").alias("medida"), "n", F.round("mean", 4).alias("media"), F.round("low", 4).alias("bajo"), F.round("high", 4).alias("alto"))


def split_leaks(spark, d):
    c = _chunks(spark, d, "guia", "texto").withColumn("clave", F.sha1(F.coalesce("texto", F.lit(""))))
    even = F.pmod(F.length("chunk_id"), F.lit(2)) == 0
    return evaluation.leaks(c.where(even), c.where(~even), "clave")


# ---- events
def events_tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("inicio"), "event_type", "n", "total")


def events_session(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("inicio"), "n")


def events_json(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("menor"), F.max("k").alias("mayor"), F.sum("k").alias("suma"))


QUERIES = {
    f.__name__: f
    for f in (
        link_exact, link_fuzzy, anchor_decision, best_code, class_members, anchor_summary, anchor_queue, decision_replay, dictionary, dictionary_merge, register_turns, turn_numbers, retention_purge, feedback_upsert, preference_inference, relevant_turns, context_window, retention_dates,
        abstention_flag, numeric_lens, deontic_lens, recall_at_k, first_hit_rank, failure_taxonomy, confusion_by_level, quality_rollup, extraction_yield, triple_coverage, stratified_sample, bootstrap_ci, split_leaks, events_tumbling, events_session, events_json,
    )
}

# ---- the same in SQL
_FOLD = "strip_accents(lower(trim({}, ' ')))"
_VALUES = f"v as (select value, {_FOLD.format('value')} as norm from (select distinct entidad as value from anchor_decisions where entidad is not null union select distinct termino from candidates where termino is not null) where {_FOLD.format('value')} <> '')"
_FUZZY = f"""vn as (select distinct norm, {trigrams_sql('norm')} as g from v), tn as (select distinct term_norm, {trigrams_sql('term_norm')} as g from terminos where term_norm is not null and cui is not null),
vg as (select norm, len(g) as n, unnest(g) as x from vn), tg as (select term_norm, len(g) as n, unnest(g) as x from tn),
dd as (select norm, term_norm, 2.0 * count(*) / (any_value(vg.n) + any_value(tg.n)) as s from vg join tg using (x) group by all having s >= 0.55),
fz as (select value, cui, round(max(s), 3) as score from dd join (select distinct term_norm, cui from terminos where cui is not null) using (term_norm) join v using (norm) group by all)"""
_EXACT = "ex as (select distinct value, cui, 1.0 as score from v join terminos on term_norm = norm where cui is not null)"
_GOLD = f"""th as (select id as query_id, thread_id from (select distinct id, thread_id from messages where thread_id is not null) join q on id = query_id),
an as (select query_id, min_by(struct_pack(c := citations, m := model), id) as a from messages join th using (thread_id) where role = 'asistente' and id > query_id group by query_id),
gd as (select query_id, coalesce(a.m, '?') as model, json_extract_string(x, '$.guia') as guia, json_extract_string(x, '$.seccion') as seccion from (select query_id, a, unnest(case when a.c is null or json_array_length(a.c) = 0 then [null] else json_extract(a.c, '$[*]') end) as x from an)),
hit as (select query_id, rank, guia, seccion from a join c on chunk_id = id)"""
_RECALL = f"{CHUNKS}, {Q}, {_es('a', 20)}, {_GOLD}, gg as (select distinct query_id, guia from gd where guia is not null), fr as (select query_id, guia, min(rank) as rank from hit group by all), pk as (select query_id, k, count(*) as n, count(case when rank <= k then 1 end) as f from gg left join fr using (query_id, guia) cross join (select unnest([1, 5, 10, 20]) as k) group by all), sc as (select query_id, k, f / n as recall, cast(f = n as double) as full_chain, model from pk join (select distinct query_id, model from gd where guia is not null) using (query_id))"


def _infer_sql(least: int) -> str:
    signs = " union all ".join(f"select user_id, '{k}' as clave, '{v}' as valor from t where regexp_matches(texto, '{_q(p)}')" for k, v, p in memory.DETECTORS)
    return f"with t as (select distinct thread_id, turn_id, user_id, texto from turns where role = 'medico' and user_id is not null and thread_id is not null and turn_id is not null), s as ({signs}), n as (select user_id, clave, valor, count(*) as n from s group by all having count(*) >= {least}) select * from n qualify row_number() over (partition by user_id, clave order by n desc, valor) = 1"


_MEM = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(texto, '')), '[a-záéíóúüñ0-9]+'), lambda w: length(w) > 2 and w not in ({_list(tx.MEMORY_STOP_WORDS)})))"
_LOG = "m as (select distinct thread_id, id as turn_id, role, content as texto from messages where thread_id is not null)"
_REL = f"wd as (select thread_id, turn_id, unnest({_MEM}) as w from m), ak as (select thread_id, turn_id as query_id from m where role = 'medico' and texto is not null and turn_id % 100 = 0), r0 as (select query_id, t.turn_id, count(*) as overlap from ak join wd qw on qw.turn_id = query_id and qw.thread_id = ak.thread_id join wd t on t.thread_id = ak.thread_id and t.w = qw.w and t.turn_id < query_id group by all), rl as (select * from r0 qualify row_number() over (partition by query_id order by overlap desc, turn_id desc) <= 3)"

SQL = {
    "link_exact": f"with {_VALUES}, {_EXACT} select * from ex",
    "link_fuzzy": f"with {_VALUES}, {_FUZZY} select * from fz",
    "anchor_decision": f"with {_VALUES}, {_EXACT}, {_FUZZY}, b as (select value, cui, max(score) as score from (select * from ex union all select * from fz) group by all), x as (select value from b where score >= 0.999 group by value having count(distinct cui) > 1) select * from b where score >= 0.85 and value not in (select value from x) qualify row_number() over (partition by value order by score desc, cui) = 1",
    "best_code": f"with {_UPS} select cui, sctid, term from terminos where sctid is not null and cui is not null qualify row_number() over (partition by cui order by case when sctid in (select child from l) then 0 else 1 end, case sab when 'SCTSPA' then 0 when 'MSHSPA' then 1 else 2 end, ispref desc, term, sctid) = 1",
    "class_members": f"with {_UPS}, u as (select parent as a, child as b from l), s as (select distinct parent as node from l where parent not in (select child from l)), {_levels(4, 'u')}, d as (" + " union all ".join(f"select node, spot as member from f{i}" for i in range(1, 5)) + ") select node, member, count(child) as items from d left join l on parent = member group by all",
    "anchor_summary": "with a as (select distinct * from anchor_decisions) select count(*) as total, count(*) filter (lower(trim(accion)) = 'aprobar') as aprobados, count(*) filter (lower(trim(accion)) = 'rechazar') as rechazados, count(*) filter (sctid is null and cui is null) as sin_codigo, count(distinct curador) as curadores from a",
    "anchor_queue": "with c as (select distinct * from candidates) select cand_id, termino, metodo, score from c where sctid is null and termino is not null order by case metodo when 'fuzzy' then 0 when 'manual' then 1 else 2 end, score nulls first, cand_id limit 200",
    "decision_replay": f"with a as (select distinct *, {_FOLD.format('entidad')} as clave from anchor_decisions) select clave, decision_id, lower(trim(accion)) as accion from a where clave <> '' qualify row_number() over (partition by clave order by decidido_en desc nulls last, decision_id desc) = 1",
    "dictionary": "with c as (select distinct * from candidates where cui is not null and termino is not null) select cui as name, min_by(sab, cand_id) as kind, array_to_string(list_sort(list_filter(list_distinct(list(termino)), lambda t: t <> cui)), '|') as aliases, count(*) as n from c group by cui",
    "dictionary_merge": "with t as (select distinct cui, term_norm, term from terminos where cui is not null), g as (select cui, min(term_norm) as target from t group by cui), m as (select term_norm as name, min(target) as target from t join g using (cui) group by term_norm), x as (select target as name, unnest([term, case when m.name <> target then m.name end]) as alias from t join m on m.name = term_norm) select name, array_to_string(list_sort(list_distinct(list(alias) filter (alias is not null and alias <> name))), '|') as aliases from x group by name",
    "register_turns": _scrub_sql(risk_sql("texto") + " as riesgo_reident"),
    "turn_numbers": "with m as (select distinct thread_id, id from messages where thread_id is not null) select thread_id, id, row_number() over (partition by thread_id order by id) as turno from m",
    "retention_purge": "select distinct thread_id, turn_id from turns where thread_id is not null and turn_id is not null and (try_cast(retener_hasta as date) is null or try_cast(retener_hasta as date) >= date '2025-03-01')",
    "feedback_upsert": "select distinct thread_id, turn_id, coalesce(feedback_pulgar, 0) as pulgar, coalesce(edicion_medico, '') as edicion from turns where thread_id is not null and turn_id is not null",
    "preference_inference": _infer_sql(2),
    "relevant_turns": f"with {_LOG}, {_REL} select * from rl",
    "context_window": f"with {_LOG}, {_REL}, rc as (select query_id, turn_id from ak join m using (thread_id) where turn_id < query_id qualify row_number() over (partition by query_id order by turn_id desc) <= 2), un as (select * from rc union select query_id, turn_id from rl) select query_id, string_agg('[' || role || '] ' || coalesce(texto, ''), chr(10) order by turn_id) as context from un join m using (turn_id) group by query_id",
    "abstention_flag": "select distinct id, contains(lower(content), 'no recogen') or contains(lower(content), 'no cubre') as abstiene from messages where role = 'asistente' and content is not null",
    "numeric_lens": f"""with {CHUNKS}, m as (select distinct id, content, citations from messages where role = 'asistente' and content is not null), f as (select distinct id, replace(regexp_extract(x, '^\\d{{1,4}}(?:[.,]\\d{{1,2}})?'), ',', '.') as valor from (select id, unnest(regexp_extract_all(content, '{_q(tx.FIGURE)}')) as x from m)),
k as (select distinct id, json_extract_string(x, '$.guia') as guia, cast(json_extract_string(x, '$.pagina') as int) as pagina from (select id, unnest(json_extract(citations, '$[*]')) as x from m where citations is not null)),
s as (select distinct id, valor from f join k using (id) join c using (guia, pagina) where contains(replace(lower(texto), ',', '.'), valor)) select * from f where (id, valor) not in (select id, valor from s)""",
    "recall_at_k": f"with {_RECALL} select k, case when grouping(model) = 1 then 'GLOBAL' else model end as model, count(*) as n, round(avg(recall), 4) as recall, round(avg(full_chain), 4) as full_chain from sc group by grouping sets ((k, model), (k))",
    "first_hit_rank": f"with {_RECALL} select query_id, coalesce(min(rank), 0) as puesto from gg left join fr using (query_id, guia) group by query_id",
    "failure_taxonomy": f"with {_RECALL}, g1 as (select query_id, min(rank) as g from gg join fr using (query_id, guia) group by query_id), s1 as (select query_id, min(rank) as s from (select query_id, guia, rank, regexp_replace(seccion, '^[\\d.]+\\s+', '') as seccion from hit) h semi join gd using (query_id, guia, seccion) group by query_id), ev as (select query_id, count(guia) as n from gd group by query_id) select case when n = 0 then 'sin_gold' when g is null then 'guia_no_recuperada' when s is null then 'seccion_no_recuperada' when s > 8 then 'orden_tardio' else 'ok' end as causa, count(*) as n from ev left join g1 using (query_id) left join s1 using (query_id) group by causa",
    "confusion_by_level": "with t as (select distinct thread_id, turn_id, cast(nivel as int) as nivel, coalesce(hitl, false) as t, coalesce(abstenido or riesgo_reident <> 'bajo', false) as p from turns where role = 'asistente' and thread_id is not null and turn_id is not null), a as (select case when grouping(nivel) = 1 then 'GLOBAL' else coalesce(cast(nivel as varchar), '?') end as nivel, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn from t group by rollup (nivel)) select *, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 4) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 4) as recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 4) as f1 from a",
    "quality_rollup": "with m as (select distinct id, model, veredicto, content, citations from messages where role = 'asistente') select case when grouping(model) = 1 then 'GLOBAL' else coalesce(model, '?') end as model, count(*) as n, count(veredicto) as juzgados, count(citations) as con_citas, round(count(*) filter (veredicto = 'fiel') / nullif(count(veredicto), 0), 4) as fiel from m group by rollup (model)",
    "extraction_yield": f"with c as (select distinct chunk_id, guia, texto, umbrales from chunks where texto is not null), a as (select case when grouping(guia) = 1 then 'GLOBAL' else coalesce(guia, '?') end as guia, sum(len(coalesce(umbrales, []))) as extraidos, sum(len(list_distinct(list_transform(regexp_extract_all(texto, '{_q(tx.THRESHOLD)}'), lambda v: trim(v))))) as en_texto from c group by rollup (guia)) select guia, cast(extraidos as bigint) as extraidos, cast(en_texto as bigint) as en_texto, coalesce(extraidos / nullif(en_texto, 0) < 0.8, false) as perdida from a",
    "triple_coverage": f"with {_VALUES}, t as (select distinct sab, cui, term_norm from terminos where cui is not null), s as (select distinct sab, cui from t where term_norm in (select norm from v)), k as (select distinct cui from candidates where cui is not null), e as (select distinct sab, cui from t) select sab, count(*) as conceptos, count(*) filter ((sab, cui) in (select sab, cui from s)) as exactos, count(*) filter ((sab, cui) in (select sab, cui from s) or cui in (select cui from k)) as laxos from e group by sab",
    "stratified_sample": "with t as (select distinct nivel, thread_id || '#' || turn_id as clave from turns where nivel is not null and thread_id is not null and turn_id is not null) select nivel, clave from (select *, row_number() over (partition by nivel order by clave) as rn from t) order by rn, nivel limit 100",
    "split_leaks": "with c as (select distinct chunk_id, sha1(coalesce(texto, '')) as clave from chunks where chunk_id is not null) select distinct clave from c where length(chunk_id) % 2 = 0 and clave in (select clave from c where length(chunk_id) % 2 <> 0)",
    "events_tumbling": "select date_trunc('hour', ts) as inicio, event_type, count(*) as n, round(sum(value), 2) as total from events group by all",
    "events_session": "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as s from events), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from e) select user_id, min(ts) as inicio, count(*) as n from g group by user_id, g",
    "events_json": "select event_type, count(k) as n, min(k) as menor, max(k) as mayor, sum(k) as suma from (select event_type, cast(json_extract_string(props, '$.k') as int) as k from events) group by event_type",
}
