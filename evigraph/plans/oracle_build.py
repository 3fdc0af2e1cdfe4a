"""SQL for the rows of the queries in catalogue_build.py."""

from __future__ import annotations

from ..functions import access
from ..operators import build

_LINE = "case l_returnflag when 'R' then 'contradicts' else 'supports' end as stance"


def _cells(**columns: str) -> str:
    """A row's text: its columns by name."""
    cell = lambda x: f"coalesce(strlen(({x})::varchar)::varchar || ':' || ({x})::varchar, '-')"
    return " || ".join(f"'{name}=' || {cell(x)}" for name, x in sorted(columns.items()))


def _digests(tables: dict[str, tuple[str, str]]) -> str:
    """Digests of tables by two prefixes, of four and two digits: for 16 million distinct rows at most."""
    rows = " union all ".join(f"select '{name}' as t, sha256({text}) as d from {source}" for name, (source, text) in sorted(tables.items()))
    names = ", ".join(f"('{name}')" for name in sorted(tables))
    return f""", leaf as (select t, d, count(*) as n from ({rows}) group by all), total as (select t, count(*) as k from leaf group by t),
        l0 as (select t, d, sha256(d || ':' || n) as h, n, k from leaf join total using (t)),
        l1 as (select t, case when k > 65536 then left(d, 4) else d end as p, case when k > 65536 then sha256(string_agg(h, '' order by h)) else min(h) end as h, sum(n) as n, k from l0 group by t, p, k),
        l2 as (select t, case when k > 256 then left(p, 2) else p end as q, case when k > 256 then sha256(string_agg(h, '' order by h)) else min(h) end as h, sum(n) as n from l1 group by t, q, k),
        l3 as (select t, sha256(string_agg(h, '' order by h)) as h, sum(n) as n from l2 group by t),
        every as (select col0 as t, coalesce(h, sha256('')) as h, coalesce(n, 0) as n from (values {names}) left join l3 on t = col0)
        select t as "table", n::bigint as n_rows, h as digest from every
        union all select 'graph', sum(n)::bigint, sha256(string_agg(t || '=' || h, chr(10) order by t)) from every"""


_EXPANSION = f"""with rows as (
  select 'd' || l_partkey as src, 'm' || l_suppkey as dst, {_LINE}, year(l_shipdate) >= 1996 as later, l_shipdate::date as day, l_orderkey || '-' || l_linenumber as suffix from lineitem where l_shipdate is not null
), there as (select distinct src, dst, stance from rows where not later),
again as (select src, dst, stance, suffix from rows group by all having count_if(later) > 1 or (bool_or(later) and bool_or(not later)))
"""


def _panels(matrix: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"('{r}', '{p}')" for r, ps in matrix.items() for p in ps) or "('', '')"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_QUESTIONS = """, q as (
  select p_partkey || '-' || k as id, 'd' || p_partkey as d, 'd' || (p_partkey + 1) as d2, p_name as label, p_partkey as p, intent from part,
    (values (1, 'people'), (2, 'funding'), (3, 'resources'), (4, 'contradictions'), (5, 'route'), (6, 'connections'), (7, 'overview'), (8, 'mechanism'), (9, 'not_in_atlas')) t(k, intent) where p_partkey % 100 = 0
), ends as (
  select case when type in ('disease_gene', 'disease_mechanism') then src else dst end as d, case when type in ('disease_gene', 'disease_mechanism') then dst else src end as other, id as edge_id, src, dst, type, stance
  from edges where type in ('disease_gene', 'disease_mechanism', 'group_disease', 'asset_disease', 'investigator_disease')
), said as (
  select q.id, intent, other, edge_id, type, stance, src, dst from q join ends using (d) left join orders on other = 'o' || o_orderkey where case intent
    when 'people' then type = 'investigator_disease' when 'funding' then type = 'asset_disease' and o_orderstatus = 'F' when 'resources' then type = 'asset_disease' and o_orderstatus != 'F'
    when 'contradictions' then stance = 'contradicts' when 'overview' then type in ('disease_gene', 'disease_mechanism', 'group_disease') when 'mechanism' then type = 'disease_mechanism' else false end
), linked as (
  select q.id, y.src as other, min(y.id) as edge_id from q join mech x on x.src = d and x.stance = 'supports' join mech y on y.dst = x.dst and y.stance = 'supports' and y.src != d where intent = 'connections' group by all
), way as (
  select q.id, min(x.dst) as via, arg_min(x.id, x.dst) as edge_a, arg_min(y.id, x.dst) as edge_b from q join mech x on x.src = d and x.stance = 'supports' join mech y on y.dst = x.dst and y.src = d2 and y.stance = 'supports' where intent = 'route' group by all
)"""

#: Those that read the tables as a graph; oracle.py puts that before them.
GRAPH_SQL = {
    "graph_digests": _digests(
        {
            "nodes": ("nodes", _cells(id="id", type="type", name="name")),
            "edges": ("edges", _cells(**{c: c for c in ("id", "src", "dst", "type", "tier", "stance", "status", "n_records")})),
            "evidence": ("evidence", _cells(edge_id="edge_id", source_type="source_type", order_key="order_key", retrieved_at="retrieved_at::date")),
            "node_cluster": ("mc", _cells(node_id="node_id", cluster_id="cluster_id")),
        }
    ),
    "answer_leads": _QUESTIONS + """, counts as (select id, count(distinct other) as n, count(distinct edge_id) as e from (select id, other, edge_id from said union all select id, other, edge_id from linked) group by id),
          total as (select count(*) as k from edges where stance = 'contradicts')
        select id, intent, case when intent != 'not_in_atlas' then d end as subject_id, case intent
          when 'people' then case coalesce(n, 0) when 0 then 'No investigator in this sample is linked to ' || label when 1 then '1 investigator in this sample is listed on NIH awards for ' || label else n || ' investigators in this sample are listed on NIH awards for ' || label end || '.'
          when 'funding' then case coalesce(n, 0) when 0 then 'No NIH award in this sample is linked to ' || label when 1 then '1 NIH award in this sample covers ' || label else n || ' NIH awards in this sample cover ' || label end || '.'
          when 'resources' then case coalesce(n, 0) when 0 then 'No registry, study or sample collection in this atlas is linked to ' || label when 1 then '1 registry, study or sample collection in this atlas cover ' || label
            else n || ' registries, studies and sample collections in this atlas cover ' || label end || '.'
          when 'contradictions' then case when k = 0 then 'No contradicting evidence is recorded in this atlas.' when coalesce(e, 0) = 0 then 'No contradicting evidence is recorded for ' || label || '. Across the atlas, ' || case k when 1 then '1 finding argues' else k || ' findings argue' end || ' against a link:'
            else case e when 1 then '1 cited finding argues' else e || ' cited findings argue' end || ' against a link for ' || label || '.' end
          when 'route' then case when r.name is null then 'Name two conditions to see whether a cited route connects them.' when via is null then 'No supported route connects ' || label || ' and ' || r.name || ' in this atlas.'
            else label || ' and ' || r.name || ' are linked through ' || lower(v.name) || '. The link is inferred from these cited steps:' end
          when 'connections' then case coalesce(n, 0) when 0 then 'No condition in this atlas shares a cited mechanism with ' || label || ', so no supported route is shown.'
            else case n when 1 then '1 condition shares' else n || ' conditions share' end || ' a cited mechanism with ' || label || '. Each link is inferred from cited findings; open the explanation to check every step.' end
          when 'not_in_atlas' then 'QX' || (p % 900 + 100) || ' is not in this atlas, so there is no supported answer.'
          else 'What the atlas holds on ' || label || ':' end as lead,
          case intent when 'route' then case when via is null then 0 else 2 end else coalesce(e, 0) end as n_items
        from q left join counts using (id) left join way using (id) left join nodes r on r.id = d2 left join nodes v on v.id = via cross join total""",
    "answer_items": _QUESTIONS + """, a as (select id as src, name as a from nodes), b as (select id as dst, name as b, lower(name[1]) || name[2:] as m from nodes)
        select said.id, edge_id, case when intent = 'overview' then case when type = 'disease_gene' then 'Gene: ' || b when type = 'group_disease' then 'Community: ' || a when stance = 'contradicts' then 'Evidence against: ' || b else 'Mechanism: ' || b end
          when intent in ('people', 'funding', 'resources') then a
          when type = 'disease_mechanism' and stance = 'contradicts' then 'Evidence contradicts assigning ' || m || ' to all of ' || a || '.' when type = 'disease_mechanism' then a || ' has cited evidence for ' || m || '.'
          when type = 'asset_disease' then a || ' is a resource for ' || b || '.' when type = 'investigator_disease' then a || ' is listed on an NIH award for ' || b || '.' end as title
        from said join a using (src) join b using (dst)
        union all select linked.id, edge_id, name from linked join nodes on nodes.id = other
        union all select way.id, edge_a, q.label || ' has cited evidence for ' || m || '.' from way join q using (id) join b on b.dst = via
        union all select way.id, edge_b, a || ' has cited evidence for ' || m || '.' from way join q using (id) join b on b.dst = via join a on a.src = d2""",
}

SQL = {
    "built_nodes": f"""select 'd' || p_partkey as id, 'disease' as type, p_name as name, 'ontology' as source_file,
          case when p_partkey % 10 = 3 then p_type || '. ' || p_name || '.' else '{build.PLAIN_DISEASE[0]}' || case when p_partkey % 7 = 0 then 'selected' else p_brand end || '{build.PLAIN_DISEASE[1]}' end as plain,
          null as kind, null as source_url from part
        union all select distinct 'g' || p_brand, 'gene', p_brand, 'ontology', p_brand || '{build.PLAIN_GENE}', null, null from part
        union all select distinct 't' || p_type, 'phenotype', p_type, 'ontology', '{build.PLAIN_PHENOTYPE[0]}' || p_type || '{build.PLAIN_PHENOTYPE[1]}', null, null from part
        union all select 'm' || s_suppkey, 'mechanism', s_name, 'research', case when s_suppkey % 2 = 0 then 'Scope of ' || s_name else s_name end, null, null from supplier
        union all select 'o' || o_orderkey, 'asset', o_orderpriority, 'research', o_orderpriority, case when o_orderkey % 3 = 0 then o_orderstatus else 'research_resource' end,
          case when o_orderkey % 2 = 0 then 'https://x.org/' || o_orderkey end from orders""",
    "merged_annotations": f"""with r as (
          select 'd' || l_partkey as src, case when l_orderkey % 2 = 0 then 'g' else 't' end || l_suppkey as dst, case when l_orderkey % 2 = 0 then 'disease_gene' else 'disease_phenotype' end as type, {_LINE},
            left(sha256(to_json(['order ' || l_orderkey, 'line ' || l_linenumber, case when l_linenumber > 2 then l_returnflag end])::varchar), 10) as h, l_shipdate::date::varchar as day, l_linestatus as snippet from lineitem
        ), one as (select src, dst, type, stance, h, arg_min(day, snippet || day) as day from r group by all)
        select 'e_' || concat_ws('_', type, src, dst, stance) as id, src, dst, stance,
          case type when 'disease_phenotype' then '{build.NOTE_PHENOTYPE}' else '{build.NOTE}' end || case stance when 'contradicts' then '{build.NOTE_NOT}' else '' end as note,
          count(*) as n_evidence, 'ev_' || concat_ws('_', type, src, dst, stance) || '_' || min(h) as first_evidence, max(day) as last_day from one group by type, src, dst, stance""",
    "expanded_edges": _EXPANSION
    + """select case when there.src is null then 'x' else 'e' end || '_' || concat_ws('_', src, dst, stance) as id, count(*) as n_evidence, max(day)::varchar as last_day, (there.src is null)::int as is_new
        from rows left join there using (src, dst, stance) anti join again using (src, dst, stance, suffix) where later group by src, dst, stance, there.src""",
    "expansion_refused": _EXPANSION
    + """select 'nodes' as "table", 'd' || p_partkey as key, case when p_partkey % 5 = 0 then 'added' else 'other identity' end as reason from part
        where p_partkey % 5 = 0 or (p_partkey % 20 = 1 and p_brand != 'other')
        union all select 'evidence', 'ev_' || concat_ws('_', src, dst, stance, suffix), 'repeated' from again""",
    "source_dates": "select o_orderkey as key, max(l_shipdate::date)::varchar as retrieved_at from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey",
    "panel_access": f"""with m as (select * from (values {_panels(access.OPEN)}) m(role, panel)), l as (select * from (values {_panels(access.REDUCED)}) l(role, panel)),
          place as (select unnest({_list(access.ROLES)}) as role, unnest(range({len(access.ROLES)})) as k),
          whole as (select panel, min_by(role, k) as full_role from m join place using (role) where (role, panel) not in (select role, panel from l) group by panel),
          asked as (select o_orderkey as request, ({_list((*access.ROLES, "guest"))})[c_custkey % 6 + 1] as role, ({_list(access.PANELS)})[o_orderkey % {len(access.PANELS)} + 1] as panel from orders join customer on c_custkey = o_custkey)
        select request, role, panel, ((role, panel) in (select role, panel from m))::int as opens, ((role, panel) in (select role, panel from l))::int as reduced, coalesce(full_role, 'admin') as full_role,
          case role when 'leader' then 'group_leader' when 'patient' then 'family' when 'guest' then null else role end as stored
        from asked left join whole using (panel)""",
}
