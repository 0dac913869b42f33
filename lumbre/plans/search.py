"""Queries of retrieval, fusion, reranking and graph search.

The queries of the searches are the doctors' messages whose id is divisible by 100, as in their SQL, those of ``hybrid`` all doctors' messages, against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbre.functions import text as tx
from lumbre.operators import graph, modulated, retrieval
from lumbre.plans.texts import CHUNKS, _chunks, _list, _q, analyze_sql, tokens_sql
from lumbre.sources.store import table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("role = 'medico' and content is not null and id % 100 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("text")).distinct()


def all_questions(spark: SparkSession, d: str) -> DataFrame:
    """All doctors' messages."""
    return table(spark, d, "messages").where("role = 'medico' and content is not null and id is not null").select(F.col("id").alias("query_id"), F.col("content").alias("text")).distinct()


def passages(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "texto").select(F.col("chunk_id").alias("id"), F.col("texto").alias("text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The passages as they are read, repeated rows too."""
    return table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.col("texto").alias("text"))


def _distinct_words(x):
    return F.array_distinct(tx.words(x))


def _spanish(spark, d, k):
    return retrieval.bm25(questions(spark, d), _texts(spark, d), k)


def _plain(spark, d, k):
    return retrieval.bm25(questions(spark, d), _texts(spark, d), k, terms=tx.words, repeated=False)


def term_stats(spark, d):
    return retrieval.term_stats(retrieval.postings(passages(spark, d), tx.analyze))


def bm25_topk(spark, d):
    return _spanish(spark, d, 10)


def bm25_bench_topk(spark, d):
    return _plain(spark, d, 10)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _dense(spark, d, k):
    v = _vectors(spark, d)
    return retrieval.dense(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), v.select("id", "v"), k)


def dense_topk(spark, d):
    return _dense(spark, d, 10)


def synonym_edges(spark, d):
    return retrieval.similar_vectors(_vectors(spark, d).select("id", "v"), 0.4)


def label_purity_at_k(spark, d):
    return retrieval.label_purity(_dense(spark, d, 11), _vectors(spark, d).select("id", "label"))


def rrf_fusion(spark, d):
    return retrieval.fuse([(_spanish(spark, d, 50), 1.0), (_plain(spark, d, 50), 1.0)], 10)


def rrf_weighted(spark, d):
    return retrieval.fuse([(_spanish(spark, d, 50), 1.0), (_plain(spark, d, 50), 3.0)], 10)


def decomposed_rrf(spark, d):
    return retrieval.decomposed(questions(spark, d), _texts(spark, d), 10)


def heuristic_rerank(spark, d):
    about = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "farmacos", "condiciones", "umbrales", "seccion").distinct()
    return retrieval.heuristic_rerank(questions(spark, d), _spanish(spark, d, 50), about, 10)


def diverse_rerank(spark, d):
    return retrieval.diverse(_spanish(spark, d, 50), _chunks(spark, d, "guia").select(F.col("chunk_id").alias("id"), F.col("guia").alias("grp")), 10)


def directed_merge(spark, d):
    return retrieval.merge_unseen(_spanish(spark, d, 10), _plain(spark, d, 10))


def citations_top(spark, d):
    """The first eight passages of each question with their place, guide, page and beginning, as an answer cites them."""
    cited = _spanish(spark, d, 8).join(_chunks(spark, d, "guia", "pagina", "texto"), F.col("id") == F.col("chunk_id"))
    return cited.select("query_id", F.col("rank").alias("n"), "chunk_id", "guia", F.coalesce(F.col("pagina").cast("long"), F.lit(0)).alias("pagina"), F.left("texto", F.lit(1200)).alias("texto"))


def _mentions(spark, d):
    return graph.mention_edges(table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("id"), "guia", F.col("farmacos").alias("entities")))


def kg_edges(spark, d):
    return _mentions(spark, d)


def entity_frequency(spark, d):
    return _mentions(spark, d).where("rel = 'MENCIONADO_EN'").groupBy(F.col("src").alias("entidad")).agg(F.count("*").alias("n"))


def hub_top100(spark, d):
    return graph.hub_subgraph(_mentions(spark, d), 100)


def search_graph(spark, d):
    terms = table(spark, d, "terminos")
    same = graph.star_edges(terms.where("sctid is not null").select(F.col("sctid").alias("key"), F.concat(F.lit("ent:"), "term_norm").alias("node")))
    return graph.search_projection(_mentions(spark, d).unionByName(same))


def ego_khop(spark, d):
    edges = _mentions(spark, d)
    start = graph.degrees(edges.where("rel = 'MENCIONADO_EN'")).where("node like 'ent:%'").orderBy(F.desc("degree"), "node").limit(3).select("node")
    return graph.ego(edges.where("rel = 'MENCIONADO_EN'"), start, 2)


def _links(spark, d):
    from lumbre.operators.forest import strip

    return table(spark, d, "jerarquia").select(strip(F.col("hijo")).alias("child"), strip(F.col("padre")).alias("parent")).where("child is not null and parent is not null").distinct()


def ancestors_hub_pruned(spark, d):
    links = _links(spark, d)
    return graph.ancestors(links, links.select(F.col("child").alias("node")).distinct(), 2, 100)


def descendants_closure(spark, d):
    links = _links(spark, d)
    return graph.descendants(links, links.select(F.col("parent").alias("node")).distinct(), 4)


def _seeds(spark, d):
    named = table(spark, d, "chunks").select(F.explode(F.array_distinct("farmacos")).alias("e")).distinct()
    asked = questions(spark, d).select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("e"))
    return asked.join(named, "e").select("query_id", F.concat(F.lit("ent:"), "e").alias("node"), F.lit(1.0).alias("weight"))


def ppr_fixed(spark, d):
    named = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.explode("farmacos").alias("entity"))
    seeds = _seeds(spark, d).select("query_id", F.substr("node", F.lit(5)).alias("entity"), "weight")
    return retrieval.top(graph.mention_pagerank(named, seeds, 10, damping=0.5, iterations=6, places=7), 10, 7)


def ppr_modulated(spark, d):
    """Ranking where edges into a chunk count by the chunk's normalised lexical score for the question; runs to convergence.

    The factor is 0.25 + 0.75 score / best score over all chunks, 0.25 for those without a shared term.
    """
    named = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.explode("farmacos").alias("entity"))
    seeds = _seeds(spark, d).select("query_id", F.substr("node", F.lit(5)).alias("entity"), "weight")
    return modulated.mention_pagerank(named, seeds, questions(spark, d), _texts(spark, d), 10)


def path_explain(spark, d):
    targets = _spanish(spark, d, 5).select("query_id", F.concat(F.lit("chunk:"), "id").alias("node"))
    return graph.explain_paths(_mentions(spark, d).where("rel <> 'EXTRAIDO_DE'"), targets, _seeds(spark, d).select("query_id", "node"))


def hop_traversal(spark, d):
    chunks = table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.array_distinct("farmacos").alias("words")).distinct()
    edges = graph.succession_edges(chunks.select("id", F.explode("words").alias("entity")))
    return graph.hop_traversal(edges, chunks, questions(spark, d).select("query_id", F.array_distinct(tx.tokens(F.col("text"))).alias("words")))


QUERIES = {
    f.__name__: f
    for f in (term_stats, bm25_topk, bm25_bench_topk, dense_topk, synonym_edges, label_purity_at_k, rrf_fusion, rrf_weighted, decomposed_rrf, heuristic_rerank, diverse_rerank, directed_merge, citations_top, kg_edges, entity_frequency, hub_top100, search_graph, ego_khop, ancestors_hub_pruned, descendants_closure, ppr_fixed, ppr_modulated, path_explain, hop_traversal)
}

# ---- the same in SQL
Q = "q as (select distinct id as query_id, content as text from messages where role = 'medico' and content is not null and id % 100 = 0)"


def words_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def bm25_sql(name: str, k: int, terms, repeated: bool, source: str = "q", key: str = "query_id") -> str:
    """Statements that define ``name`` (query_id, id, score, rank); needs ``c`` and the queries."""
    n = name
    asked = f"select {key}, term, count(*) as qtf from (select {key}, unnest({terms('text')}) as term from {source}) group by all"
    return f"""{n}_d as (select chunk_id, {terms('texto')} as t from c where texto is not null), {n}_s as (select count(*) as nd, avg(len(t)) as mean from {n}_d),
{n}_p as (select chunk_id, len, term, count(*) as tf from (select chunk_id, len(t) as len, unnest(t) as term from {n}_d) group by all),
{n}_f as (select term, count(*) as df from {n}_p group by term), {n}_q as ({asked}),
{n}_r as (select {key}, chunk_id as id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)){' * qtf' if repeated else ''}), 4) as score from {n}_q join {n}_f using (term) join {n}_p using (term) cross join {n}_s group by all),
{n} as (select *, row_number() over (partition by {key} order by score desc, id) as rank from {n}_r qualify rank <= {k})"""


def _es(name: str, k: int) -> str:
    return bm25_sql(name, k, analyze_sql, True)


def _pl(name: str, k: int) -> str:
    return bm25_sql(name, k, words_sql, False)


def _rrf(weights: tuple[float, float]) -> str:
    return f"""with {CHUNKS}, {Q}, {_es('a', 50)}, {_pl('b', 50)}, f as (select query_id, id, round(sum(s), 5) as score from (select query_id, id, {weights[0]} / (60 + rank - 1) as s from a union all select query_id, id, {weights[1]} / (60 + rank - 1) from b) group by all)
select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from f qualify rank <= 10"""


_E = "e as (select distinct 'ent:' || x as src, 'chunk:' || chunk_id as dst, 'MENCIONADO_EN' as rel from (select chunk_id, unnest(farmacos) as x from chunks where chunk_id is not null) where x is not null)"
_KG = f"{_E}, kg as (select * from e union all select dst, src, 'CONTIENE_MENCION' from e union all select distinct 'chunk:' || chunk_id, 'guia:' || guia, 'EXTRAIDO_DE' from chunks where guia is not null and chunk_id is not null)"
_UPS = r"l as (select distinct regexp_replace(hijo, '^\s+|\s+$', '', 'g') as child, regexp_replace(padre, '^\s+|\s+$', '', 'g') as parent from jerarquia where trim(coalesce(hijo, '')) <> '' and trim(coalesce(padre, '')) <> '')"
_V = "v as (select vec_id as id, embedding::double[] as v, label from embeddings)"
_SEEDS = f"sd as (select distinct query_id, 'ent:' || e as node from (select query_id, unnest(list_distinct({tokens_sql('text')})) as e from q) join (select distinct unnest(farmacos) as e from chunks) using (e))"


def _levels(hops: int, up: str) -> str:
    """Unrolled climb over ``up`` (a, b) from all nodes of ``s`` (node)."""
    out = ["f0 as (select node, node as spot from s)"]
    for i in range(1, hops + 1):
        seen = " union all ".join(f"select node, spot from f{j}" for j in range(i))
        out.append(f"f{i} as (select distinct node, b as spot from f{i - 1} join {up} on a = spot where (node, b) not in ({seen}))")
    return ", ".join(out)


def _ppr(iterations: int) -> str:
    out = ["rs as (select query_id, node, 1.0 / count(*) over (partition by query_id) as v from sd)", "g as (select src, dst, 1.0 / count(*) over (partition by src) as share from (select src, dst from e union select dst, src from e))", "p0 as (select query_id, node, v as p from rs)"]
    for i in range(1, iterations + 1):
        out.append(f"m{i} as (select query_id, dst as node, sum(p * share) as m from p{i - 1} join g on node = src group by all)")
        out.append(f"k{i} as (select query_id, sum(m) as kept from m{i} group by query_id)")
        out.append(f"p{i} as (select query_id, node, sum(x) as p from (select query_id, node, 0.5 * m as x from m{i} union all select query_id, node, v * (0.5 + 0.5 * (1 - coalesce(kept, 0))) from rs left join k{i} using (query_id)) group by all)")
    return ", ".join(out)


SQL = {
    "term_stats": f"with {CHUNKS}, d as (select chunk_id, unnest({analyze_sql('texto')}) as term from c) select term, count(distinct chunk_id) as df, count(*) as cf from d group by term",
    "bm25_topk": f"with {CHUNKS}, {Q}, {_es('a', 10)} select * from a",
    "bm25_bench_topk": f"with {CHUNKS}, {Q}, {_pl('a', 10)} select * from a",
    "dense_topk": f"with {_V} select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from (select a.id as query_id, b.id, round(list_inner_product(a.v, b.v), 5) as score from v a cross join v b where a.id % 100 = 0) qualify rank <= 10",
    "synonym_edges": f"with {_V} select * from (select a.id as a, b.id as b, round(list_inner_product(a.v, b.v), 5) as score from v a join v b on a.id < b.id) where score >= 0.4",
    "label_purity_at_k": f"with {_V}, h as (select a.id as query_id, b.id, a.label as own, b.label, round(list_inner_product(a.v, b.v), 5) as score from v a cross join v b where a.id % 100 = 0 qualify row_number() over (partition by a.id order by score desc, b.id) <= 11) select query_id, round(avg(cast(own = label as double)), 4) as purity from h where id <> query_id group by query_id",
    "rrf_fusion": _rrf((1.0, 1.0)),
    "rrf_weighted": _rrf((1.0, 3.0)),
    "decomposed_rrf": f"""with {CHUNKS}, {Q}, cl as (select query_id, text, list_filter(list_transform(string_split_regex(text, '\\s+y\\s+|[.;:?]\\s+'), lambda s: trim(s, ' ')), lambda s: length(s) > 8) as l from q),
sub as (select query_id || '#' || i as sub_id, query_id, parts[i] as text from (select query_id, parts, unnest(range(1, len(parts) + 1)) as i from (select query_id, list_concat([text], case when len(l) > 1 then l[1:4] else [] end) as parts from cl))), {bm25_sql('a', 20, analyze_sql, True, 'sub', 'sub_id')},
f as (select query_id, id, round(sum(1.0 / (60 + rank - 1)), 5) as score from a join sub using (sub_id) group by all) select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from f qualify rank <= 10""",
    "heuristic_rerank": f"""with {CHUNKS}, {Q}, {_es('a', 50)}, m as (select distinct chunk_id as id, farmacos, condiciones, umbrales, seccion from chunks),
x as (select query_id, list_sort(list_distinct(regexp_extract_all(text, '\\b(?:{'|'.join(tx.DRUGS)})\\b'))) as qf, list_filter([{_list(sorted(tx.CONDITIONS))}], lambda v: contains(lower(text), lower(v))) as qc, len(regexp_extract_all(text, '{_q(tx.THRESHOLD)}')) > 0 or regexp_matches(lower(text), 'fg|cd4|carga viral|copias|filtrado|aclaramiento') as num, list_distinct({analyze_sql('text')}) as w from q),
b as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from a join x using (query_id) join m using (id)),
r as (select query_id, id, round(case when hi - lo < 1e-9 then 1 else (score - lo) / (hi - lo) end + 0.8 * least(len(list_intersect(qf, coalesce(farmacos, []))) + len(list_intersect(qc, coalesce(condiciones, []))), 3) / 3 + case when num and len(coalesce(umbrales, [])) > 0 then 0.6 else 0 end + 0.4 * least(len(list_intersect(w, list_distinct({analyze_sql("coalesce(seccion, '')")}))), 3) / 3, 5) as score from b)
select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from r qualify rank <= 10""",
    "diverse_rerank": f"with {CHUNKS}, {Q}, {_es('a', 50)}, g as (select a.*, row_number() over (partition by query_id, guia order by rank) as within from a join c on chunk_id = id) select query_id, id, score, row_number() over (partition by query_id order by case when within > 1 then 1 else 0 end, g.rank) as rank from g qualify row_number() over (partition by query_id order by case when within > 1 then 1 else 0 end, g.rank) <= 10",
    "directed_merge": f"with {CHUNKS}, {Q}, {_es('a', 10)}, {_pl('b', 10)}, u as (select query_id, id, score, 0 as later, rank as r from a union all select query_id, id, score, 1, rank from b where (query_id, id) not in (select query_id, id from a)) select query_id, id, score, row_number() over (partition by query_id order by later, r, id) as rank from u",
    "citations_top": f"with {CHUNKS}, {Q}, {_es('a', 8)} select query_id, rank as n, chunk_id, guia, coalesce(cast(pagina as bigint), 0) as pagina, left(texto, 1200) as texto from a join c on chunk_id = id",
    "kg_edges": f"with {_KG} select * from kg",
    "entity_frequency": f"with {_E} select src as entidad, count(*) as n from e group by src",
    "hub_top100": f"with {_KG}, h as (select node from (select src as node from kg union all select dst from kg) group by node order by count(*) desc, node limit 100) select * from kg where src in (select node from h) and dst in (select node from h)",
    "search_graph": f"with {_KG}, t as (select distinct sctid, 'ent:' || term_norm as node from terminos where sctid is not null and term_norm is not null), st as (select distinct min(node) over (partition by sctid) as a, node as b from t), u as (select src, dst, rel, 1.0 as w from kg union all select a, b, 'SINONIMO_DE', 1.0 from st where a <> b union all select b, a, 'SINONIMO_DE', 1.0 from st where a <> b) select src, dst, max_by(w, rel) as weight, false as population from u group by src, dst",
    "ego_khop": f"with {_E}, w as (select src as a, dst as b from e union select dst, src from e), s as (select src as node from e group by src order by count(*) desc, src limit 3), {_levels(2, 'w')} select node as start, spot as node, 0 as distance from f0 union all select node, spot, 1 from f1 union all select node, spot, 2 from f2",
    "ancestors_hub_pruned": f"with {_UPS}, u as (select child as a, parent as b from l where parent not in (select parent from l group by parent having count(*) > 100)), s as (select distinct child as node from l), {_levels(2, 'u')} select node, spot as ancestor, 1 as distance from f1 union all select node, spot, 2 from f2",
    "descendants_closure": f"with {_UPS}, u as (select parent as a, child as b from l), s as (select distinct parent as node from l), {_levels(4, 'u')} " + " union all ".join(f"select node, spot as descendant, {i} as distance from f{i}" for i in range(1, 5)),
    "ppr_fixed": f"with {_E}, {Q}, {_SEEDS}, {_ppr(6)} select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, substring(node, 7) as id, round(p, 7) as score from p6 where node like 'chunk:%') qualify rank <= 10",
    "path_explain": f"with {CHUNKS}, {_E}, {Q}, {_SEEDS}, {_es('a', 5)}, t as (select query_id, 'chunk:' || id as node from a), w as (select src as a, dst as b from e union select dst, src from e), n as (select query_id, node as seed, b as mid from sd join w on a = node) select distinct query_id, seed, cast(null as varchar) as mid, node as target from n join t using (query_id) where mid = node union all select distinct query_id, seed, n.mid, t.node from n join t using (query_id) join w on w.a = n.mid and w.b = t.node where seed <> t.node",
}
