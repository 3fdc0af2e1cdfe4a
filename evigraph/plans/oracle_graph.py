"""SQL for the rows of the queries in catalogue_graph.py; it follows the tables seen as a graph."""

from __future__ import annotations

from ..operators.paths import PHRASES, STEP_SENTENCES

_CITED = """, cited_records as (
  select l_orderkey || '-' || l_linenumber as id, 'disease_mechanism|d' || l_partkey || '|m' || l_suppkey || '|' || case l_returnflag when 'A' then 'supports' when 'R' then 'contradicts' else 'neutral' end as edge_id,
    l_quantity::int % 7 != 0 as has_snippet, l_orderkey % 5 != 0 as has_url from lineitem
), cited as (select edge_id, list(id order by id) as ids from cited_records where has_snippet and has_url group by 1
), ways as (
  select distinct x, y from (
    select m.id as x, min(o.id) as y from mech m join mech o on o.dst = m.dst and o.src != m.src and o.stance = 'supports' where m.src in (select 'd' || p_partkey from part where p_partkey % 100 = 0) group by m.id
    union all
    select a.id, b.id from part
      join (select src, min(id) as id from mech where stance = 'supports' and status = 'verified' and tier = 'A' group by 1) a on a.src = 'd' || p_partkey
      join (select src, min(id) as id from mech where stance = 'supports' and status = 'verified' and tier = 'A' group by 1) b on b.src = 'd' || (p_partkey + 1)
    where p_partkey % 100 = 0)
), sound as (
  select m.id, m.src, m.dst, ids, case tier when 'C' then 'hypothesis' else 'supported' end as kind,
    case tier when 'C' then 'Hypothesis (inferred): ' || a.name || ' may have a disease mechanism relationship with ' || b.name || '; this requires expert review.'
      else a.name || ' {phrase} ' || b.name || '.' end as text
  from mech m join nodes a on a.id = m.src join nodes b on b.id = m.dst join cited on edge_id = m.id where stance = 'supports' and status = 'verified' and tier != 'D'
), judged as (
  select x || '~' || y as path_id, x, y, case when a.id is null or b.id is null then 'unsupported_path' when a.src not in (b.src, b.dst) and a.dst not in (b.src, b.dst) then 'disconnected_path' end as reason,
    a.text || ' ' || b.text as text, a.kind || ',' || b.kind as kinds, list_concat(a.ids, b.ids) as ids, [a.src, a.dst, b.src, b.dst] as ends
  from ways left join sound a on a.id = x left join sound b on b.id = y
)
""".replace("{phrase}", PHRASES["disease_mechanism"])

_CERTAIN, _MAYBE = (t.replace("{src}", "' || a.name || '").replace("{dst}", "' || b.name || '") for t in STEP_SENTENCES["disease_mechanism"])

GRAPH_SQL = {
    "explained_paths": _CITED
    + """select path_id, case when reason is null then 'explained' else 'no_supported_route' end as status, reason, case when reason is null then text end as text,
          case when reason is null then kinds end as kinds, case when reason is null then array_to_string(ids, ',') end as evidence_ids from judged
        union all select 'empty d' || p_partkey, 'no_supported_route', 'empty_path', null, null, null from part where p_partkey % 100 = 0""",
    "contradicted_paths": _CITED
    + """select distinct path_id, m.id as edge_id, coalesce(array_to_string(cited.ids, ','), '') as evidence_ids from (select path_id, unnest(ends) as node from judged where reason is null) p
        join mech m on m.stance = 'contradicts' and m.status != 'rejected' and (m.src = node or m.dst = node) left join cited on cited.edge_id = m.id""",
    "path_steps": _CITED
    + f""", shown as (select edge_id, count(*) as n from cited_records where has_snippet group by 1),
        s as (select x || '~' || y as path_id, unnest([0, 1])::int as step, unnest([x, y]) as edge_id from ways)
        select path_id, step, s.edge_id, case when n is null then 'no evidence' end as dropped,
          case when n is not null then case when stance = 'contradicts' then 'Evidence contradicts a disease mechanism connection between ' || a.name || ' and ' || b.name || '.'
            when tier = 'C' then '{_MAYBE} This is inferred by the graph, not yet directly confirmed.' else '{_CERTAIN}' end end as text,
          case when n is not null then tier = 'C' end as inferred, case when n is not null then stance end as stance, case when n is not null then tier end as tier, n as n_evidence
        from s join mech m on m.id = s.edge_id join nodes a on a.id = m.src join nodes b on b.id = m.dst left join shown on shown.edge_id = s.edge_id""",
    "contradiction_context": """, f as (select 'd' || p_partkey as disease from part where p_partkey % 100 = 0), mine as (select * from mech where src in (select disease from f)),
        made as (select 'shares_mechanism_with|' || x.src || '|' || y.src || '|' || x.dst as id, x.src as a, y.src as b, x.dst as via from mine x join mine y on x.dst = y.dst and x.src < y.src
          where x.stance = 'supports' and y.stance = 'supports' and x.status != 'rejected' and y.status != 'rejected' and (x.src, y.src) not in (select a, b from known)),
        touch as (select id, unnest([src, dst]) as node from mine where stance != 'contradicts' union select id, unnest([a, b, via]) from made)
        select distinct t.id as edge_id, m.id as other_id from touch t join mech m on m.stance = 'contradicts' and (m.src = node or m.dst = node) where m.id != t.id""",
    "shortest_routes": """, r as (select p_partkey as route_id, 'd' || p_partkey as start, 'd' || (p_partkey + 100) as goal from part where p_partkey % 100 = 0),
        s as (select route_id, row_number() over (partition by route_id order by id) as step, src as subject, dst as object
          from r join mech on src in (start, goal, 'd' || (route_id + 1), 'd' || (route_id + 2)) where stance = 'supports' and status = 'verified' and tier = 'A'),
        ways as (select route_id, subject as here, object as onto, step, false as back from s union all select route_id, object, subject, step, true from s),
        w as (select route_id, start as here, goal, [start] as nodes, []::bigint[] as steps, []::varchar[] as backs from r
          union all select w.route_id, onto, goal, list_append(nodes, onto), list_append(steps, x.step), list_append(backs, x.back::varchar) from w join ways x on x.route_id = w.route_id and x.here = w.here
          where w.here != goal and not list_contains(nodes, onto)),
        best as (select * from w where here = goal and len(steps) > 0 qualify row_number() over (partition by route_id order by len(steps), steps) = 1)
        select route_id, array_to_string(nodes, '>') as nodes, array_to_string(steps, '>') as steps, array_to_string(backs, '>') as reversed from r left join best using (route_id)""",
    "ontology_diseases": """, t as (select *, 'd' || p_partkey as node_id, case when p_partkey % 11 = 0 or p_partkey % 17 = 0 then 'expected one term M:' || p_partkey
            when p_partkey % 13 = 0 then 'obsolete term M:' || p_partkey || ', replaced by ' || case when p_partkey % 26 = 0 then 'M:1' else 'nothing' end end as error from part)
        select node_id, case when error is null then p_name end as name, case when error is null then p_name || ',x ' || p_name end as synonyms,
          case when error is null then p_brand || '/hasRelatedSynonym,' || p_type || '/untyped_in_ols_response' end as other_names,
          case when error is null then 'MONDO=M:' || p_partkey || case when p_partkey % 2 = 0 then ',OMIM=' || p_size else '' end || ',Orphanet=' || p_partkey end as ext_ids,
          case when error is null then p_type end as description, error from t""",
    "ontology_lookup": """, t as (select * from part where p_partkey % 11 != 0 and p_partkey % 17 != 0 and p_partkey % 13 != 0)
        select 'ORPHA:' || p_partkey as database_id, 'd' || p_partkey as node_id from t union all select 'OMIM:' || p_size, 'd' || p_partkey from t where p_partkey % 2 = 0""",
}
