"""SQL for the rows of the queries in catalogue_plan.py."""

from __future__ import annotations

from .oracle_model import _DECISIONS
from .oracle_model import ORACLE_SQL as _MODEL

#: The diseases that a plan reaches, and what it finds there.
_PLAN = """, viable as (select * from conn where kind = 'mechanism' and supported),
seeds as (select fid as focus, fid as disease, false as partner from focus union all select focus, candidate, true from viable),
scope as (
  select focus, disease, bool_or(partner) as partner from (select * from seeds union all select focus, p.dst, partner from seeds s join parents p on p.src = s.disease) group by all
), kinds as (
  select 'o' || o_orderkey as asset, case when o_orderkey % 3 = 0 then 'study' when o_orderstatus = 'F' then 'funded_research' when o_orderstatus = 'O' then 'biosamples' else 'patient_data' end as category
  from orders where o_orderkey in (select l_orderkey from lineitem)
), plan_assets as (
  select focus, asset, category, min(e.id) as edge_id, count(distinct disease) as n_diseases, bool_or(partner) as partner
  from edges e join scope on disease = e.dst join kinds on asset = e.src where e.type = 'asset_disease' group by focus, asset, category
), tier_a as (select distinct m.src as disease, cluster_id from mech m join mc on mc.node_id = m.dst where m.stance = 'supports' and m.status = 'verified' and m.tier = 'A'),
in_clusters as (select * from tier_a union select p.dst, cluster_id from parents p join tier_a on disease = p.src),
person_diseases as (select distinct src as person, dst as disease from inv),
meet as (
  select distinct x.person, x.disease as a, y.disease as b from person_diseases x join in_clusters cx on cx.disease = x.disease
    join in_clusters cy on cy.cluster_id = cx.cluster_id join person_diseases y on y.person = x.person and y.disease = cy.disease and y.disease != x.disease
), person_n as (select person, count(*) as n from person_diseases group by 1),
meet_n as (select person, count(*) as n from meet group by 1),
plan_people as (
  select w.focus, w.person, p.n as n_diseases, p.n >= 2 and coalesce(m.n, 0) < p.n * (p.n - 1) as shared
  from (select focus, via as person from conn where kind = 'investigator' union select focus, src from scope join inv on dst = disease) w join person_n p using (person) left join meet_n m using (person)
)
"""

_STEPS = (
    _PLAN
    + """, best as (select * from viable qualify row_number() over (partition by focus order by n_qualifiers, n_phenotypes desc, name, candidate) = 1),
alone as (select fid as focus from focus where fid not in (select focus from best)),
all_groups as (select disease, 0 as via, id, patient_group from own_groups union all select p.src, 1, o.id, o.patient_group from parents p join own_groups o on o.disease = p.dst),
g as (select disease, id as edge_id, patient_group as group_id from all_groups qualify row_number() over (partition by disease order by via, id) = 1),
partner as (select b.*, edge_id, group_id from best b join g on disease = candidate),
registry as (select focus, min(edge_id) as edge_id, min_by(asset, edge_id) as asset from plan_assets semi join best using (focus) where partner and category = 'patient_data' group by focus),
asked as (select focus, person, n_diseases from plan_people join nodes on id = person where shared qualify row_number() over (partition by focus order by n_diseases desc, name, person) = 1),
tested as (select focus, 0 as place, edge_a as edge_id, member as who from best union all select focus, 1, edge_b, candidate from best)
"""
)

FOCUS_SQL = {
    "plan_scope": _PLAN + "select * from scope",
    "plan_assets": _PLAN + "select * from plan_assets",
    "plan_people": _PLAN + "select * from plan_people",
    "plan_steps": _STEPS
    + """select focus, 'week' as grp, 0 as place, 'write-partner' as task_id, 'Write to ' || n.name as title,
          'Share the cited evidence that ' || f.name || ' and ' || p.name || ' both involve ' || lower(v.name) || ', and ask which questions need expert review before working together.' as detail, 'https://example.org/' || group_id as url
        from partner p join nodes n on n.id = group_id join nodes f on f.id = focus join nodes v on v.id = via
        union all select focus, 'week', 1, 'read-registry', 'Read how ' || name || ' is set up', case when substr(asset, 2)::bigint % 2 = 0 then 'Ask for ' || asset else 'Read the registry’s public researcher information.' end,
          'https://example.org/' || asset from registry join nodes on id = asset
        union all select focus, 'week', 2, 'contact-investigator', 'Ask ' || name || '''s team whether they see the overlap',
          'Listed on NIH awards for ' || n_diseases || ' conditions. Use the institution''s public contact route; the atlas does not hold personal contact details.', 'https://example.org/' || person from asked join nodes on id = person
        union all select focus, 'week', 3, 'own-community', 'Talk to ' || name, 'Contact the foundation through its public site.', 'https://example.org/' || group_id from alone join g on disease = focus join nodes on id = group_id
        union all select focus, 'experiment', place, 'confirm-' || edge_id, 'Confirm the mechanism for ' || n.name || ' variants',
          'Tier ' || tier || '. A functional test of the variants in your families would show whether the shared mechanism applies to them.', 'https://example.org/' || edge_id from tested join nodes n on n.id = who join mech m on m.id = edge_id
        union all select focus, 'experiment', 3, 'compare-measures', 'Compare what each community measures',
          'Map ' || name || '''s outcome measures against what your families already record, to see whether one shared natural history design could cover both conditions.', 'https://example.org/' || asset from registry join nodes on id = asset""",
    "plan_step_edges": _STEPS
    + """, there as (select focus, candidate, candidate as disease from partner union select focus, candidate, p.dst from partner join parents p on p.src = candidate)
        select focus, 'write-partner' as task_id, unnest([edge_a, edge_b]) as edge_id from partner
        union all select focus, 'write-partner', p.id from partner join parents p on p.src = member and p.dst = focus
        union all select focus, 'write-partner', p.id from partner join parents p on p.src = candidate
        union all select focus, 'write-partner', o.id from there join own_groups o using (disease)
        union all select focus, 'write-partner', e.id from there join edges e on e.dst = disease and e.type = 'asset_disease' and e.stance = 'supports' join kinds k on k.asset = e.src and category in ('patient_data', 'biosamples')
        union all select focus, unnest(['read-registry', 'compare-measures']), edge_id from registry
        union all select focus, 'confirm-' || edge_id, edge_id from tested
        union all select focus, 'contact-investigator', i.id from asked join inv i on i.src = person
        union all select focus, 'own-community', edge_id from alone join g on disease = focus""",
    "plan_summary": _PLAN
    + """, own as (select distinct q.focus, q.candidate from quals q join mech m on m.id = q.edge_id where side = 'target' and m.src = q.candidate),
        kept_assets as (select distinct e.src as asset, e.dst as disease, category, cluster_id from edges e join kinds k on k.asset = e.src and category != 'study' join in_clusters c on c.disease = e.dst where e.type = 'asset_disease'),
        signals as (select cluster_id, category from kept_assets left join edges g on g.src = disease and g.type = 'disease_gene' group by all having count(distinct asset) >= 2 and count(distinct g.dst) >= 2),
        touched as (select distinct focus, k.cluster_id, k.category from kept_assets k join scope using (disease) semi join signals using (cluster_id, category))
        select fid as focus, (select count(*) from viable v where v.focus = fid) as n_viable, (select count(*) from conn c where c.focus = fid and kind = 'investigator') as n_network,
          (select count(*) from conn c left join own o on o.focus = c.focus and o.candidate = c.candidate where c.focus = fid and (kind = 'phenotype' or (kind = 'mechanism' and not supported) or (kind != 'mechanism' and o.focus is not null))) as n_unsupported,
          (select count(*) from plan_assets a where a.focus = fid and category != 'study') as n_assets, (select count(*) from plan_assets a where a.focus = fid and category = 'study') as n_studies,
          (select count(*) from plan_people p where p.focus = fid) as n_people, (select count(*) from plan_people p where p.focus = fid and shared) as n_shared_people, (select count(*) from touched t where t.focus = fid) as n_signals,
          (select count(distinct patient_group) from (select disease, patient_group from own_groups union all select p.src, o.patient_group from parents p join own_groups o on o.disease = p.dst) where disease = fid) as n_communities
        from focus""",
}

_CLUSTERS = """, tier_a as (select distinct m.src as disease, cluster_id from mech m join mc on mc.node_id = m.dst where m.stance = 'supports' and m.status = 'verified' and m.tier = 'A'),
in_clusters as (select * from tier_a union select p.dst, cluster_id from parents p join tier_a on disease = p.src)
"""

#: Those that read the tables as a graph.
GRAPH_SQL = {
    "suggested_questions": _CLUSTERS
    + """, deg as (select node_id, count(*) as n from (select src as node_id from edges union all select dst from edges) group by 1),
        of_gene as (select e.dst as gene, e.src as disease from edges e join deg on node_id = e.src join nodes on nodes.id = e.src where e.type = 'disease_gene'
          qualify row_number() over (partition by e.dst order by n desc, name, e.src) = 1),
        facts as (select p.id as disease, case when substr(p.id, 2)::bigint % 2 = 0 then upper(p.id) else p.name end as short, (select min(cluster_id) from in_clusters c where c.disease = p.id) as cluster_id,
          (select g.name from edges e join nodes g on g.id = e.dst where e.type = 'disease_gene' and e.src = p.id) as gene from nodes p where type = 'disease'),
        a as (select role, n.id, n.type, n.name, case type when 'disease' then n.id when 'gene' then of_gene.disease else 'd4' end as disease
          from nodes n cross join (values ('researcher'), ('family')) r(role) left join of_gene on gene = n.id where type in ('disease', 'mechanism', 'gene', 'person')),
        t as (select a.*, short, coalesce('region ' || r_name, 'region ' || (select r_name from region order by r_regionkey limit 1)) as label, coalesce(gene, 'none') as gene
          from a join facts using (disease) left join region on 'r' || r_regionkey = cluster_id)
        select role || ' ' || id as asker, unnest([0, 1, 2])::int as place,
          unnest(case role when 'researcher' then ['Who else works on ' || case type when 'mechanism' then lower(name[1]) || name[2:] else label end || '?', 'Which findings contradict a shared mechanism?',
            'Which NIH awards fund ' || case type when 'gene' then name else gene end || ' research?']
          else ['Which communities share a mechanism with ' || short || '?', 'What should we do this week about ' || short || '?', 'Who is researching ' || short || '?'] end) as question from t""",
    "read_edge_records": _DECISIONS
    + """select v.*, least(n_records / 4, 1.0) as confidence, case when n_records > 1 then n_records || ' records' end as scope, case when v.tier = 'C' then v.src || ';' || v.dst else '' end as derived_from, false as sample
        from view v join edges e using (id)""",
}

_MORE = """pmid, sample, retrieved_at as date, snippet, case when pmid is not null and key % 4 = 0 then 'c' || o_custkey end as authors,
          case when edge_id in (select 'd' || l_partkey || '|m' || l_suppkey from lineitem where l_returnflag = 'R') then 'contradicts' else 'supports' end as stance"""

ORACLE_SQL = {"read_evidence_records": _MODEL["read_model_evidence"].replace("pmid, sample", _MORE)}  # the view's columns, and more
