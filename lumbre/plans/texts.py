"""Queries over texts: analysis, metadata, normative statements, routing, privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbre.functions import similarity as sim, text as tx
from lumbre.operators import chunking
from lumbre.sources.store import table


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct chunks with the named columns only."""
    return table(spark, d, "chunks").select("chunk_id", *columns).where("chunk_id is not null").distinct()


def fold_tokens(spark, d):
    return _chunks(spark, d, "texto").select("chunk_id", F.size(tx.tokens(F.col("texto"))).alias("n"), F.array_join(tx.tokens(F.col("texto")), " ").alias("tokens"))


def stem_tokens(spark, d):
    return _chunks(spark, d, "texto").select("chunk_id", F.array_join(tx.analyze(F.col("texto")), " ").alias("stems"))


def memory_words(spark, d):
    turns = table(spark, d, "turns").select("thread_id", "turn_id", "texto").distinct()
    return turns.select("thread_id", "turn_id", F.array_join(F.array_sort(tx.memory_tokens(F.col("texto"))), " ").alias("palabras"))


def sentence_split(spark, d):
    return _chunks(spark, d, "texto").select("chunk_id", F.posexplode(tx.sentences(F.col("texto"))).alias("pos", "frase"))


def chunk_metadata(spark, d):
    x = F.col("texto")
    return _chunks(spark, d, "texto").select("chunk_id", F.array_join(tx.drugs(x), "|").alias("farmacos"), F.array_join(tx.conditions(x), "|").alias("condiciones"), F.array_join(tx.thresholds(x), "|").alias("umbrales"), tx.evidence_level(x).alias("nivel"))


def deontic_by_guide(spark, d):
    s = _chunks(spark, d, "guia", "texto").select("guia", F.explode(tx.sentences(F.col("texto"))).alias("frase"))
    return s.select("guia", tx.deontic(F.col("frase")).alias("accion")).groupBy("guia", "accion").agg(F.count("*").alias("n"))


def evidence_grades(spark, d):
    s = _chunks(spark, d, "guia", "texto").select("guia", F.explode(tx.sentences(F.col("texto"))).alias("frase"))
    return s.groupBy("guia").agg(F.count("*").alias("frases"), F.count(tx.grade(F.col("frase"))).alias("con_grado"))


def recommendations(spark, d):
    r = chunking.recommendations(_chunks(spark, d, "guia", "fecha_vigencia", "seccion", "pagina", "texto"))
    return r.select("id", "guia", "texto", "grado", "accion")


def block_marks(spark, d):
    return chunking.marked_blocks(table(spark, d, "blocks")).select("doc_id", "ord", "is_heading", "is_table")


def chunk_pack(spark, d):
    return chunking.pack(table(spark, d, "blocks"))


def question_routing(spark, d):
    q = table(spark, d, "messages").where("role = 'medico' and content is not null").select("id", "content").distinct()
    return q.select("id", tx.question_type(F.col("content")).alias("tipo"), *[c.alias(n) for n, c in tx.route(F.col("content")).items()])


def message_titles(spark, d):
    first = table(spark, d, "messages").where("role = 'medico' and content is not null").groupBy("thread_id").agg(F.min_by("content", "id").alias("content"))
    return first.select("thread_id", tx.shortened(F.col("content")).alias("titulo"))


def pii_scrub(spark, d):
    t = table(spark, d, "turns").where("texto is not null").select("thread_id", "turn_id", "texto").distinct()
    clean, n, kinds = tx.scrub(F.col("texto"))
    return t.select("thread_id", "turn_id", clean.alias("texto"), n.cast("long").alias("n_directos"), F.array_join(kinds, "|").alias("tipos"))


def reident_risk(spark, d):
    t = table(spark, d, "pii_results").where("texto is not null").select("result_id", "texto").distinct()
    level, reasons = tx.risk(F.col("texto"))
    return t.select("result_id", level.alias("riesgo"), F.array_join(reasons, "|").alias("motivos"))


def trigram_dice(spark, d):
    c = table(spark, d, "candidates").select("cand_id", "decision_id", "termino").distinct()
    a = table(spark, d, "anchor_decisions").select("decision_id", "entidad").distinct()
    g = lambda x: sim.trigrams(tx.fold(F.trim(x)))
    return c.join(a, "decision_id").where("termino is not null and entidad is not null").select("cand_id", F.round(sim.dice(g(F.col("termino")), g(F.col("entidad"))), 4).alias("dice"), F.round(sim.jaccard(g(F.col("termino")), g(F.col("entidad"))), 4).alias("jaccard"))


def prefix_dedup(spark, d):
    rows = _chunks(spark, d, "guia", "texto").where("texto is not null")
    return chunking.keep_first(rows.withColumn("clave", F.left(F.regexp_replace(F.lower("texto"), r"\s+", " "), F.lit(120))), ["guia", "clave"], "chunk_id").select("chunk_id", "guia")


def best_record(spark, d):
    """The best message of every thread and role: with content first, then the latest."""
    rows = table(spark, d, "messages").select("id", "thread_id", "role", "content").where("thread_id is not null").distinct()
    blank = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", 1).otherwise(0)
    best = rows.groupBy("thread_id", "role").agg(F.min(F.struct(blank, -F.col("id"))).alias("b"))
    return best.select("thread_id", "role", (-F.col("b.col2")).alias("id"), (F.col("b.col1") == 0).alias("con_texto"))


def previous_chunk(spark, d):
    """Each chunk with the chunk before it in its guide, by page and id."""
    from pyspark.sql import Window

    rows = _chunks(spark, d, "guia", "pagina")
    # one guide may hold a third of all chunks: its order is found page block by page block, the block before handing on its last
    rows = rows.withColumn("bloque", F.coalesce(F.floor(F.col("pagina") / 8), F.lit(-1)))
    order = (F.asc_nulls_first("pagina"), "chunk_id")
    inner = rows.withColumn("previo", F.lag("chunk_id").over(Window.partitionBy("guia", "bloque").orderBy(*order)))
    last = rows.groupBy("guia", "bloque").agg(F.max(F.struct(F.coalesce("pagina", F.lit(-1)).alias("p"), F.col("chunk_id").alias("c"))).alias("l"))
    handed = last.select("guia", "bloque", F.lag("l.c").over(Window.partitionBy("guia").orderBy("bloque")).alias("de_antes"))
    return inner.join(handed, ["guia", "bloque"]).select("chunk_id", F.coalesce("previo", "de_antes", F.lit("Inicio del documento.")).alias("previo"))


QUERIES = {f.__name__: f for f in (fold_tokens, stem_tokens, memory_words, sentence_split, chunk_metadata, deontic_by_guide, evidence_grades, recommendations, block_marks, chunk_pack, question_routing, message_titles, pii_scrub, reident_risk, trigram_dice, prefix_dedup, best_record, previous_chunk)}


# ---- the same in SQL
def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _q(pattern: str) -> str:
    """A pattern in the other engine's dialect: its word characters and boundaries are ASCII only."""
    flags = "(?i)" if pattern.startswith(("(?iu", "(?i)")) else ""
    body = pattern[pattern.index(")") + 1 :] if pattern.startswith("(?") and pattern[2] in "iuU" else pattern
    return (flags + body.replace(r"[\w.+-]", r"[\p{L}\p{N}_.+-]").replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"[\w.-]", r"[\p{L}\p{N}_.-]").replace(r"[\w.\-]", r"[\p{L}\p{N}_.\-]").replace(r"\w", r"[\p{L}\p{N}_]")).replace("'", "''")


CHUNKS = "c as (select distinct chunk_id, guia, fecha_vigencia, seccion, pagina, texto from chunks where chunk_id is not null)"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[a-z0-9]+')"


def analyze_sql(x: str) -> str:
    ends = "|".join(tx.ENDINGS)
    return f"list_transform(list_filter({tokens_sql(x)}, lambda t: length(t) > 1 and t not in ({_list(tx.STOP_WORDS)})), lambda t: case when length(t) > 4 and not regexp_matches(t, '[0-9]') then regexp_replace(t, '^(.{{4,}}?)(?:{ends})$', '\\1') else t end)"


def sentences_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.;])\\s+([A-ZÁÉÍÓÚÑ¿(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 40)"


def trigrams_sql(x: str) -> str:
    return f"(case when length({x}) >= 3 then list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3))) else [] end)"


def deontic_sql(x: str) -> str:
    # a letter with a mark is a word character to the one engine and none to the other; no pattern asks for one
    x = f"translate({x}, 'áéíóúüñÁÉÍÓÚÜÑ', '______________')"
    return "case " + " ".join(f"when regexp_matches({x}, '{_q(p)}') then '{n}'" for n, p in tx.DEONTIC) + " else 'sin_determinar' end"


def grade_sql(x: str) -> str:
    a, b = f"regexp_extract({x}, '{_q(tx.GRADE_PARENTHESIS)}')", f"regexp_extract({x}, '{_q(tx.GRADE_DASH)}')"
    first = f"(case when {a} <> '' and ({b} = '' or position({a} in {x}) <= position({b} in {x})) then {a} else {b} end)"
    return f"case when {first} <> '' then regexp_extract({first}, '[ABC]') || '-' || regexp_extract({first}, 'I{{1,3}}') end"


def risk_sql(x: str) -> str:
    m = "list_filter([" + ", ".join(f"case when regexp_matches({x}, '{_q(p)}') then '{n}' end" for n, p in tx.RISKS) + "], lambda r: r is not null)"
    return f"case when len({m}) >= 2 then 'alto' when len({m}) = 1 then 'medio' else 'bajo' end"


def _scrub_sql(select: str = "") -> str:
    inner, counts, kinds = "texto", [], []
    steps = []
    for i, (name, p) in enumerate(tx.SCRUB):
        steps.append(f"s{i} as (select *, regexp_replace({inner}, '{_q(p)}', '[{name}]', 'g') as t{i}, len(regexp_extract_all({inner}, '{_q(p)}')) as n{i} from {'t' if i == 0 else f's{i - 1}'})")
        inner = f"t{i}"
        counts.append(f"n{i}")
        kinds.append(f"case when n{i} > 0 then '{name}' end")
    last = len(tx.SCRUB) - 1
    head = f"with t as (select distinct thread_id, turn_id, texto from turns where texto is not null), {', '.join(steps)}"
    if select:
        return f"{head} select thread_id, turn_id, t{last} as texto, cast({' + '.join(counts)} as bigint) as pii_directos, {select} from s{last}"
    return f"{head} select thread_id, turn_id, t{last} as texto, cast({' + '.join(counts)} as bigint) as n_directos, array_to_string(list_sort(list_distinct(list_filter([{', '.join(kinds)}], lambda k: k is not null))), '|') as tipos from s{last}"


_HEADING = r"(length(texto) < 120 and (regexp_matches(texto, '^\s*\d{1,2}(\.\d{1,2}){0,3}[.)]?\s+\S') or size_max >= 1.15 * body))"
_TABLE = r"(len(regexp_extract_all(texto, '[0-9]')) >= 8 and (contains(texto, '|') or len(regexp_extract_all(texto, '  ')) >= 3 or len(regexp_extract_all(texto, '[0-9]')) / greatest(length(texto), 1) > 0.12))"

SQL = {
    "fold_tokens": f"with {CHUNKS} select chunk_id, len({tokens_sql('texto')}) as n, array_to_string({tokens_sql('texto')}, ' ') as tokens from c",
    "stem_tokens": f"with {CHUNKS} select chunk_id, array_to_string({analyze_sql('texto')}, ' ') as stems from c",
    "memory_words": f"with t as (select distinct thread_id, turn_id, texto from turns) select thread_id, turn_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(texto, '')), '[a-záéíóúüñ0-9]+'), lambda w: length(w) > 2 and w not in ({_list(tx.MEMORY_STOP_WORDS)})))), ' ') as palabras from t",
    "sentence_split": f"with {CHUNKS}, s as (select chunk_id, {sentences_sql('texto')} as f from c) select chunk_id, i - 1 as pos, f[i] as frase from (select chunk_id, f, unnest(range(1, len(f) + 1)) as i from s)",
    "chunk_metadata": f"with {CHUNKS} select chunk_id, array_to_string(list_sort(list_distinct(regexp_extract_all(texto, '\\b(?:{'|'.join(tx.DRUGS)})\\b'))), '|') as farmacos, array_to_string(list_filter([{_list(sorted(tx.CONDITIONS))}], lambda v: contains(lower(texto), lower(v))), '|') as condiciones, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(texto, '{_q(tx.THRESHOLD)}'), lambda v: trim(v)))), '|') as umbrales, nullif(regexp_extract(texto, '{_q(tx.EVIDENCE)}'), '') as nivel from c",
    "deontic_by_guide": f"with {CHUNKS}, s as (select guia, unnest({sentences_sql('texto')}) as frase from c) select guia, {deontic_sql('frase')} as accion, count(*) as n from s group by all",
    "evidence_grades": f"with {CHUNKS}, s as (select guia, unnest({sentences_sql('texto')}) as frase from c) select guia, count(*) as frases, count({grade_sql('frase')}) as con_grado from s group by guia",
    "recommendations": f"""with {CHUNKS}, s as (select *, {sentences_sql('texto')} as f from c), p as (select chunk_id, guia, f[i] as frase, i as pos from (select *, unnest(range(1, len(f) + 1)) as i from s)),
m as (select *, {grade_sql('frase')} as grado, {deontic_sql('frase')} as accion, left(regexp_replace(lower(frase), '\\s+', ' ', 'g'), 120) as clave from p),
k as (select * from m where grado is not null or accion <> 'sin_determinar' qualify row_number() over (partition by guia, clave order by chunk_id, pos) = 1)
select chunk_id || '::rec' || (row_number() over (partition by chunk_id order by pos) - 1) as id, guia, frase as texto, grado, accion from k""",
    "block_marks": f"""with b as (select distinct doc_id, ord, texto, size_max, tipo from blocks where texto is not null), m as (select doc_id, case when median(coalesce(size_max, 0)) = 0 then 10 else median(coalesce(size_max, 0)) end as body from b group by doc_id)
select doc_id, ord, coalesce(tipo <> 'tabla' and {_HEADING}, false) as is_heading, coalesce(tipo = 'tabla' or (not {_HEADING} and {_TABLE}), false) as is_table from b join m using (doc_id)""",
    "question_routing": f"""with q as (select distinct id, content as x from messages where role = 'medico' and content is not null)
select id, case when regexp_matches(lower(x), '\\b(or|both)\\b') and regexp_matches(lower(x), '{tx.ROLE}') and regexp_matches(lower(x), '\\b(film|movie|book|novel|song|album)s?\\b') then 'bridge_comparison'
  when regexp_matches(lower(x), '\\b(are both|do both|were both|which .{{0,60}}(first|earlier|later|more|older|younger|longer)|same (country|nationality|year|place))\\b') or contains(lower(x), ' or ') then 'comparison'
  when regexp_matches(lower(x), '{tx.KINSHIP}') then 'inference' else 'compositional' end as tipo,
  case when regexp_matches(x, '{_q(tx.PATIENT)}') then 'paciente' else 'general' end as tipo_consulta,
  case when m then 3 else 1 end as nivel, m as multi_aspecto, regexp_matches(x, '{_q(tx.NUMERIC)}') as logica_numerica, regexp_matches(x, '{_q(tx.SERIOUS)}') as decision_seria, case when m then 'paralela' else 'vectorial' end as estrategia
from (select *, contains(lower(x), ' y ') or regexp_matches(x, '{_q(tx.SEVERAL)}') as m from q)""",
    "message_titles": "select thread_id, case when length(content) > 60 then left(content, 60) || '…' else content end as titulo from (select thread_id, min_by(content, id) as content from messages where role = 'medico' and content is not null group by thread_id)",
    "pii_scrub": _scrub_sql(),
    "reident_risk": f"with t as (select distinct result_id, list_filter([{', '.join(f'case when regexp_matches(texto, {chr(39)}{_q(p)}{chr(39)}) then {chr(39)}{n}{chr(39)} end' for n, p in tx.RISKS)}], lambda r: r is not null) as m from pii_results where texto is not null) select result_id, case when len(m) >= 2 then 'alto' when len(m) = 1 then 'medio' else 'bajo' end as riesgo, array_to_string(m, '|') as motivos from t",
    "trigram_dice": f"""with g as (select distinct cand_id, strip_accents(lower(trim(c.termino, ' '))) as x, strip_accents(lower(trim(a.entidad, ' '))) as y from candidates c join anchor_decisions a using (decision_id) where c.termino is not null and entidad is not null),
t as (select cand_id, {trigrams_sql('x')} as a, {trigrams_sql('y')} as b from g)
select cand_id, round(case when len(a) = 0 or len(b) = 0 then 0 else 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) end, 4) as dice, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 4) as jaccard from t""",
    "prefix_dedup": f"with {CHUNKS} select chunk_id, guia from c where texto is not null qualify row_number() over (partition by guia, left(regexp_replace(lower(texto), '\\s+', ' ', 'g'), 120) order by chunk_id) = 1",
    "best_record": "with m as (select distinct id, thread_id, role, trim(coalesce(content, '')) <> '' as t from messages where thread_id is not null) select thread_id, role, id, t as con_texto from m qualify row_number() over (partition by thread_id, role order by t desc, id desc) = 1",
    "previous_chunk": f"with {CHUNKS} select chunk_id, coalesce(lag(chunk_id) over (partition by guia order by pagina nulls first, chunk_id), 'Inicio del documento.') as previo from c",
}
