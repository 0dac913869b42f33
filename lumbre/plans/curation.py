"""Queries of curation and of the lists around users, models and recommendations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbre.operators import curation
from lumbre.plans.texts import SQL as TEXTS, _chunks, recommendations
from lumbre.sources.store import table

#: Semantic groups that a substance's slot admits.
SLOT = ["CHEM", "PROC"]


def _decisions(spark, d, *columns):
    return table(spark, d, "anchor_decisions").where("decision_id is not null").select("decision_id", *columns).distinct()


def entity_forms(spark, d):
    """Typed entities as identity, bare name, and how many of the name's words stand in the term of the decision."""
    a = _decisions(spark, d, "entidad", "termino").where("entidad is not null")
    name = curation.bare(F.col("entidad"))
    overlap = curation.word_overlap(name, F.split(curation.bare(F.coalesce("termino", F.lit(""))), " "))
    return a.select("decision_id", curation.squeezed(F.col("entidad")).alias("identidad"), name.alias("nombre"), (overlap >= 0.6).alias("coincide"))


def pending_entities(spark, d):
    """Substances named in chunks that no decision has curated, with the number of chunks."""
    named = _chunks(spark, d, "farmacos").select("chunk_id", F.explode(F.array_distinct("farmacos")).alias("entidad")).where("entidad is not null")
    done = _decisions(spark, d, "entidad").select(curation.squeezed(F.col("entidad")).alias("entidad")).distinct()
    return named.groupBy(curation.squeezed(F.col("entidad")).alias("entidad")).agg(F.count("*").alias("fragmentos")).join(done, "entidad", "left_anti")


def entity_context(spark, d):
    """The first chunk that names each substance, with the beginning of its text."""
    first = curation.first_context(_chunks(spark, d, "farmacos", "texto"), "chunk_id", "farmacos", "texto")
    return first.select("entity", F.col("item").alias("chunk_id"), F.left("text", F.lit(80)).alias("contexto"))


def enriched_anchors(spark, d):
    """Decisions with the preferred name of their concept, if they have one, or the typed name."""
    a = _decisions(spark, d, "entidad", "cui").where("entidad is not null")
    names = table(spark, d, "terminos").where("ispref = 'Y' and lat = 'SPA' and cui is not null").groupBy("cui").agg(F.min("term").alias("preferido"))
    return a.join(names, "cui", "left").select("decision_id", F.coalesce("preferido", F.trim("entidad")).alias("nombre"), F.col("preferido").isNotNull().alias("anclado"))


def slot_candidates(spark, d):
    c = table(spark, d, "candidates").where("cand_id is not null").select("cand_id", "decision_id", "grupos").distinct()
    return curation.in_slot(c, "grupos", SLOT).select("cand_id", "decision_id")


def judge_merge(spark, d):
    """The best candidate of each decision where its score is at least 0.6, else none."""
    c = table(spark, d, "candidates").select("cand_id", "decision_id", "score").distinct()
    return curation.judged(c, "decision_id", "score", "cand_id", 0.6)


def mass_anchor(spark, d):
    return curation.anchor_by_variants(_decisions(spark, d, "entidad"), "decision_id", "entidad", table(spark, d, "terminos"), "term_norm", "cui")


def canonical_ids(spark, d):
    """Chunks by guide and place in it."""
    return curation.remapped(table(spark, d, "chunks"), "chunk_id", "guia", "chunk_id")


def chunk_recommendations(spark, d):
    """Normative sentences of every chunk: how many and which; chunks without any have none."""
    r = recommendations(spark, d).select(F.regexp_replace("id", "::rec[0-9]+$", "").alias("chunk_id"), "id").distinct()
    listed = r.groupBy("chunk_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("recs"))
    return _chunks(spark, d).select("chunk_id").distinct().join(listed, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "recs")


def risky_users(spark, d):
    """Users with texts of medium or high risk of being told, and how many."""
    r = table(spark, d, "pii_results").where("riesgo_reident in ('medio', 'alto')").select("result_id", "thread_id", "turn_id", "riesgo_reident").distinct()
    t = table(spark, d, "turns").where("thread_id is not null").select("thread_id", "turn_id", "user_id").distinct()
    return r.join(t, ["thread_id", "turn_id"]).where("user_id is not null").groupBy("user_id", "riesgo_reident").agg(F.count("*").alias("n"))


def user_messages(spark, d):
    """Threads and messages of every user of the turns, by the thread."""
    owners = table(spark, d, "turns").where("thread_id is not null and user_id is not null").select("user_id", "thread_id").distinct()
    counted = table(spark, d, "messages").where("id is not null and thread_id is not null").select("id", "thread_id").distinct().groupBy("thread_id").agg(F.count("*").alias("m"))
    return owners.join(counted, "thread_id", "left").groupBy("user_id").agg(F.count("*").alias("hilos"), F.sum(F.coalesce("m", F.lit(0))).alias("mensajes"))


def level_summary(spark, d):
    """Turns of each level: all, with several guides, sent to a human."""
    t = table(spark, d, "turns").where("thread_id is not null").select("thread_id", "turn_id", "nivel", "guias_citadas", "hitl").distinct()
    several = F.coalesce(F.size(F.array_distinct("guias_citadas")) > 1, F.lit(False))
    return t.groupBy(F.col("nivel").cast("int").alias("nivel")).agg(F.count("*").alias("n"), F.count_if(several).alias("multiguia"), F.count_if(F.coalesce("hitl", F.lit(False))).alias("hitl"))


def model_family(spark, d):
    """Messages by family of their model; those without a known one by the default."""
    m = table(spark, d, "messages").where("id is not null").select("id", "model").distinct()
    family = F.when(F.col("model").rlike("^sim-clinico"), "clinico").when(F.col("model").rlike("^sim-"), "general")
    return m.groupBy(F.coalesce(family, F.lit("por_defecto")).alias("familia")).agg(F.count("*").alias("n"))


def adaptive_pool(spark, d):
    """How many passages a turn asks for by its level: 8, from level three on 20, and six more where it went to a human."""
    t = table(spark, d, "turns").where("thread_id is not null and role = 'asistente'").select("thread_id", "turn_id", "nivel", "hitl").distinct()
    k = F.when(F.coalesce("nivel", F.lit(0)) >= 3, 20).otherwise(8) + F.when(F.coalesce("hitl", F.lit(False)), 6).otherwise(0)
    return t.select("thread_id", "turn_id", k.cast("int").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (entity_forms, pending_entities, entity_context, enriched_anchors, slot_candidates, judge_merge, mass_anchor, canonical_ids, chunk_recommendations, risky_users, user_messages, level_summary, model_family, adaptive_pool)
}


def _sql():
    bare = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '\\([^()]*\\)', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    squeezed = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'), ' ')"
    folded = "strip_accents(lower(trim(entidad, ' ')))"
    decisions = "a as (select distinct decision_id, entidad, termino, cui from anchor_decisions where decision_id is not null)"
    return {
        "entity_forms": f"with {decisions}, b as (select distinct decision_id, entidad, termino, {bare('entidad')} as nombre, string_split({bare('coalesce(termino, chr(32))')}, ' ') as w from a where entidad is not null), o as (select *, list_filter(string_split(nombre, ' '), lambda x: x <> '') as own from b) select decision_id, {squeezed('entidad')} as identidad, nombre, case when len(own) = 0 then false else len(list_filter(own, lambda x: list_contains(w, x))) / len(own) >= 0.6 end as coincide from o",
        "pending_entities": f"with n as (select distinct chunk_id, unnest(list_distinct(farmacos)) as e from (select distinct chunk_id, farmacos from chunks where chunk_id is not null)), {decisions} select {squeezed('e')} as entidad, count(*) as fragmentos from n where e is not null and {squeezed('e')} not in (select {squeezed('entidad')} from a where entidad is not null) group by 1",
        "entity_context": "with n as (select distinct chunk_id, texto, unnest(list_distinct(farmacos)) as entity from chunks where chunk_id is not null) select entity, min(chunk_id) as chunk_id, left(arg_min(texto, chunk_id), 80) as contexto from n where entity is not null group by entity",
        "enriched_anchors": "with a as (select distinct decision_id, entidad, cui from anchor_decisions where decision_id is not null and entidad is not null), t as (select cui, min(term) as p from terminos where ispref = 'Y' and lat = 'SPA' group by cui) select decision_id, coalesce(p, trim(entidad, ' ')) as nombre, p is not null as anclado from a left join t using (cui)",
        "slot_candidates": "select distinct cand_id, decision_id from candidates where cand_id is not null and list_has_any(grupos, ['CHEM', 'PROC'])",
        "judge_merge": "with c as (select distinct cand_id, decision_id, score from candidates where decision_id is not null), b as (select *, row_number() over (partition by decision_id order by coalesce(score, -1) desc, cand_id) as r from c) select decision_id, case when score >= 0.6 then cand_id end as cand_id, case when score >= 0.6 then score end as score from b where r = 1",
        "mass_anchor": f"with a as (select distinct decision_id, {folded} as f from anchor_decisions where decision_id is not null and entidad is not null), v as (select decision_id, 0 as variant, f as t from a union all select decision_id, 1, {bare('f')} from a union all select decision_id, 2, trim(regexp_extract(f, '\\(([^()]+)\\)', 1)) from a), k as (select term_norm as t, min(cui) as code from terminos where term_norm is not null and cui is not null group by 1) select decision_id, variant, code from (select *, row_number() over (partition by decision_id order by variant, code) as r from v join k using (t) where t <> '') where r = 1",
        "canonical_ids": "with c as (select distinct chunk_id, guia from chunks where chunk_id is not null) select chunk_id, case when guia is null then chunk_id else guia || '::' || row_number() over (partition by guia order by chunk_id) end as canonical from c",
        "chunk_recommendations": f"with r as (select distinct regexp_replace(id, '::rec[0-9]+$', '') as chunk_id, id from ({TEXTS['recommendations']})), l as (select chunk_id, count(*) as n, string_agg(id, ',' order by id) as recs from r group by chunk_id) select distinct chunk_id, coalesce(n, 0) as n, recs from chunks left join l using (chunk_id) where chunk_id is not null",
        "risky_users": "with r as (select distinct result_id, thread_id, turn_id, riesgo_reident from pii_results where riesgo_reident in ('medio', 'alto')), t as (select distinct thread_id, turn_id, user_id from turns where user_id is not null) select user_id, riesgo_reident, count(*) as n from r join t using (thread_id, turn_id) group by 1, 2",
        "user_messages": "with o as (select distinct user_id, thread_id from turns where thread_id is not null and user_id is not null), m as (select thread_id, count(distinct id) as m from messages where thread_id is not null group by 1) select user_id, count(*) as hilos, sum(coalesce(m, 0))::bigint as mensajes from o left join m using (thread_id) group by 1",
        "level_summary": "with t as (select distinct thread_id, turn_id, nivel, guias_citadas, hitl from turns where thread_id is not null) select nivel::int as nivel, count(*) as n, count(*) filter (len(list_distinct(guias_citadas)) > 1) as multiguia, count(*) filter (hitl) as hitl from t group by nivel",
        "model_family": "with m as (select distinct id, model from messages where id is not null) select case when starts_with(model, 'sim-clinico') then 'clinico' when starts_with(model, 'sim-') then 'general' else 'por_defecto' end as familia, count(*) as n from m group by 1",
        "adaptive_pool": "with t as (select distinct thread_id, turn_id, nivel, hitl from turns where thread_id is not null and role = 'asistente') select thread_id, turn_id, case when coalesce(nivel, 0) >= 3 then 20 else 8 end + case when hitl then 6 else 0 end as k from t",
    }


SQL = _sql()
