"""SQL for the rows of the queries in catalogue_model.py."""

from __future__ import annotations

_DECISIONS = """, decisions as (
  select id as edge_id, case stance when 'neutral' then 'rejected' else 'approved' end as decision from mech where tier = 'D' and stance in ('neutral', 'contradicts')
), view as (
  select e.id, e.src, e.dst, e.type as relation, case tier when 'C' then 'inferred' else 'observed' end as basis, tier, stance,
    case when decision = 'rejected' then 'rejected' when decision = 'approved' then 'verified' when tier = 'D' then 'pending' else status end as status,
    exists (select 1 from mc where node_id = src) and exists (select 1 from mc where node_id = dst)
      and not exists (select 1 from mc x join mc y on x.cluster_id = y.cluster_id where x.node_id = src and y.node_id = dst) as bridge
  from (select * from mech union all select * from parents) e left join decisions on edge_id = e.id
  where src in (select id from nodes) and dst in (select id from nodes)
)
"""

_SOURCES = """with src0 as (
  select *, (['pubmed', 'hpo', 'clinicaltrials', 'nih_reporter', 'orphadata', 'mondo', 'patient_organization', 'placeholder', 'blog'])[(l_orderkey + l_linenumber) % 9 + 1] as k from lineitem
), sources as (
  select l_orderkey || '-' || l_linenumber as id, 'd' || l_partkey || '|m' || l_suppkey as edge_id, k as source_type,
    case k when 'clinicaltrials' then 'https://clinicaltrials.gov/study/NCT' || lpad(l_orderkey::varchar, 8, '0') when 'mondo' then 'https://example.org/MONDO:' || l_orderkey
      when 'orphadata' then 'https://api.example.org/orphacodes/' || l_orderkey when 'nih_reporter' then 'https://reporter.nih.gov/project-details/' || l_orderkey
      when 'patient_organization' then 'https://www.Group-' || l_orderkey || '.org/page' when 'blog' then 'http://user@blog' || l_orderkey || '.net/x?y' when 'pubmed' then 'https://pubmed.ncbi.nlm.nih.gov/' || l_orderkey end as source_url,
    case k when 'pubmed' then l_orderkey::varchar end as pmid, case when l_linenumber < 7 then l_returnflag end as snippet,
    '2021-' || lpad((l_orderkey % 14)::varchar, 2, '0') || '-' || lpad((l_partkey % 32)::varchar, 2, '0') as retrieved_at, l_orderkey as key
  from src0
)
"""

#: Those that read the tables as a graph; oracle.py puts that before them.
GRAPH_SQL = {
    "read_model_edges": _DECISIONS + "select * from view",
    "read_model_nodes": """, deg as (select node_id, count(*) as degree, max(count(*)) over () as top from (select src as node_id from edges where tier != 'C' union all select dst from edges where tier != 'C') group by 1),
        n0 as (
          select 'd' || p_partkey as id, 'disease' as type, p_name as name, case when p_partkey % 3 = 0 then p_brand || ';Added' else p_brand end as synonyms, case when p_type != p_brand then p_type else '' end as related,
            'OMIM=' || p_partkey || '=https://omim.org/entry/' || p_partkey || ';LOCAL=' || p_brand as ids from part
          union all select 'o' || o_orderkey, case when o_orderstatus = 'F' then 'funding' else 'asset' end, o_orderpriority, '', '', '' from orders)
        select n0.*, (select count(distinct cluster_id) from mc where node_id = n0.id)::int as n_clusters, coalesce(degree / top, 0) as centrality from n0 left join deg on node_id = n0.id""",
    "nested_evidence": """, own as (select edge_id, order_key || '-' || source_type as id from evidence)
        select m.id, count(o.id)::int as n, coalesce(string_agg(o.id, ',' order by o.id), '') as evidence_ids from mech m left join own o on o.edge_id = m.id group by m.id""",
    "node_page": _DECISIONS
    + """, ends as (select src as node_id, * exclude (src, dst) from view union all select dst, * exclude (src, dst) from view where dst != src)
        select node_id, relation, count(*) as n, count(*) filter (basis = 'observed') as n_observed, count(*) filter (basis = 'inferred') as n_inferred, count(*) filter (stance = 'contradicts') as n_contradicting
        from ends where status != 'rejected' and node_id in (select 'd' || p_partkey from part where p_partkey % 100 = 0) group by all""",
    "first_gene": "select src as disease, min_by(dst, id) as gene from edges where type = 'disease_gene' group by src",
    "diseases_of_genes": """, deg as (select node_id, count(*) as degree from (select src as node_id from edges where tier != 'C' union all select dst from edges where tier != 'C') group by 1)
        select dst as gene, src as disease, coalesce(degree, 0) as degree, name from edges left join deg on node_id = src join nodes on nodes.id = src where edges.type = 'disease_gene'""",
    "path_citations": _DECISIONS
    + """, cited as (select edge_id, min(source_type) as url from evidence group by 1),
        step as (select src as path_id, view.id, case when basis = 'inferred' then view.id else coalesce(url, view.id) end as key from view left join cited on edge_id = view.id),
        one as (select path_id, key, min(id) as id from step group by all),
        listed as (select path_id, list_sort(list(id)) as l from one group by 1)
        select path_id, array_to_string(l[1:4], ',') as edge_ids, greatest(len(l) - 4, 0)::int as n_more from listed""",
    "cluster_mechanisms": """, c as (select p_brand || '/' || p_size as cluster_id, 'd' || p_partkey as disease from part), size as (select cluster_id, count(*) as n from c group by 1),
        held as (select c.cluster_id, target as mechanism, count(*) as k from c join m_use using (disease) group by all)
        select cluster_id, mechanism from held join size using (cluster_id) where k = n""",
    "builder_status": _DECISIONS
    + """select (select count(*) from mech where tier = 'C') as n_inferred, (select count(*) from mech left join decisions on edge_id = id where tier in ('C', 'D') and decision is null) as n_open,
          count(*) filter (n_records > 1) as n_scored, count(*) as n_edges from mech""",
    "investigators_in_order": """, d as (select i.target as person, count(*) as n_diseases, count(distinct p_type) as n_clusters from i_use i join part on 'd' || p_partkey = i.disease group by 1),
        r as (select person, name, n_clusters > 1 as shared, n_diseases from d join nodes on id = person)
        select *, row_number() over (order by shared desc, n_diseases desc, name, person)::int as rank from r qualify rank <= 100""",
    "mechanisms_in_order": """, i as (select dst as mechanism, count(distinct case stance when 'supports' then src end) as n_supports from mech group by 1)
        select mechanism, name, n_supports, row_number() over (order by n_supports desc, name, mechanism)::int as rank from i join nodes on id = mechanism qualify rank <= 100""",
    "diseases_in_order": "select id, name, row_number() over (order by name, id)::int as rank from nodes where type = 'disease' qualify rank <= 100",
    "bridge_proposals": """, l as (select distinct src as disease, dst as target from mech where stance = 'supports' and status = 'verified'),
        pt as (select x.disease as a, y.disease as b, x.target from l x join l y on x.target = y.target and x.disease < y.disease where (x.disease, y.disease) not in (select a, b from known)),
        size as (select disease, count(*) as n from l group by 1),
        j as (select a, b, string_agg(target, ', ' order by target) as targets, count(*) as k from pt group by all),
        e as (select j.*, k::double / (x.n + y.n - k) as r from j join size x on x.disease = a join size y on y.disease = b),
        i as (select *, (least(greatest(r, 0.05), 0.95) * 144115188075855872)::bigint * 25 as n from e),
        ev as (select split_part(edge_id, '|', 2) as disease, split_part(edge_id, '|', 3) as target, source_type as url from evidence),
        u as (select a, b, least(4, count(distinct url)) as m from pt join ev on ev.target = pt.target and ev.disease in (a, b) group by all)
        select 'bridge__' || a || '__' || b as id, a as src, b as dst, 'C' as tier, 'unverified' as status,
          ((n >> 55) + case when n & 36028797018963967 > 18014398509481984 or (n & 36028797018963967 = 18014398509481984 and (n >> 55) % 2 = 1) then 1 else 0 end) / 100.0 as confidence, 'Shared: ' || targets as note,
          coalesce(array_to_string(list_transform(range(1, m + 1), lambda k: 'ev_bridge__' || a || '__' || b || '_' || k), ','), '') as evidence_ids from i left join u using (a, b)""",
    "chain_counts": """, c as (select distinct edge_id from evidence where quantity >= 25)
        select src as path_id, count(*) as n_steps, count(edge_id) as n_cited, count(*) filter (edge_id is null) as n_other, count(*) filter (stance = 'contradicts') as n_limits from mech left join c on edge_id = id group by 1""",
    "neighbourhood_edges": """, e as (select id, src, dst from edges where type in ('subgroup_of', 'disease_gene') and src in (select id from nodes) and dst in (select id from nodes)),
        w as (select src as x, dst as y from e union select dst, src from e), f as (select 'd' || p_partkey as start from part where p_partkey % 100 = 0),
        r as (select start, start as node_id from f union select start, y from f join w on x = start union select start, b.y from f join w a on a.x = start join w b on b.x = a.y)
        select a.start, e.id from e join r a on a.node_id = e.src join r b on b.node_id = e.dst and b.start = a.start""",
    "proposed_new_edges": """, p as (select distinct 'd' || l_partkey as src, 'm' || l_suppkey as dst, 'https://x.org/' || l_linenumber as url from lineitem),
        n as (select *, 'disease_mechanism__' || src || '__' || dst as edge_id from p where not exists (select 1 from mech m where m.src = p.src and m.dst = p.dst and m.stance = 'supports'))
        select edge_id, src, dst, 'disease_mechanism' as type, url, 'ev_' || edge_id || '_' || row_number() over (partition by edge_id order by url) as evidence_id from n""",
    "unsupported_claims": "select distinct src, dst from mech where stance = 'contradicts' and (src, dst) not in (select src, dst from mech where stance = 'supports' and status = 'verified')",
    "assets_of_diseases": """select src as asset, case o_orderstatus when 'F' then 'funded_research' when 'O' then 'biosamples' else 'patient_data' end as category, min(id) as first_edge,
          string_agg(distinct dst, ',' order by dst) as diseases, case when o_orderkey % 2 = 0 then 'https://x.org/b' else 'https://x.org/a' end as url, case when o_custkey % 2 = 0 then 'RECRUITING' end as status
        from edges join orders on src = 'o' || o_orderkey where type = 'asset_disease' group by src, o_orderstatus, o_orderkey, o_custkey""",
    "clusters_in_order": """, u as (select m.*, cluster_id from mech m join mc on mc.node_id = m.dst), ds as (select distinct cluster_id, src as disease from u where stance = 'supports'),
        og as (select dst as disease, src as g from edges where type = 'group_disease'), gs as (select * from og union select p.src, g from parents p join og on og.disease = p.dst),
        pd as (select distinct dst as disease from edges join orders on src = 'o' || o_orderkey where type = 'asset_disease' and o_orderstatus not in ('F', 'O')),
        f as (select 'r' || r_regionkey as cluster_id, r_name as label, (select count(*) from ds where ds.cluster_id = 'r' || r_regionkey) as n_diseases,
          exists (select 1 from ds join pd using (disease) where ds.cluster_id = 'r' || r_regionkey) as has_data, (select count(distinct g) from ds join gs using (disease) where ds.cluster_id = 'r' || r_regionkey) as n_groups,
          (select count(distinct i.target) from ds join i_use i on i.disease = ds.disease where ds.cluster_id = 'r' || r_regionkey) as n_people, (select count(*) from u where stance = 'contradicts' and u.cluster_id = 'r' || r_regionkey) as n_qualifiers from region)
        select *, row_number() over (order by n_diseases desc, has_data desc, n_groups desc, n_people desc, label, cluster_id)::int as rank from f""",
    "needs_of_diseases": """, g as (select dst as disease from edges where type = 'group_disease' and src != 'n3' and src < 'n2'),
        pd as (select dst as disease from edges join orders on src = 'o' || o_orderkey where type = 'asset_disease' and o_orderstatus not in ('F', 'O'))
        select id as disease, 'No patient organization linked to ' || name || ' in this atlas.' as need from nodes where type = 'disease' and id not in (select disease from g)
        union all select id, 'No registry or natural history study linked.' from nodes where type = 'disease' and id not in (select disease from pd)
        union all select id, 'No recruiting interventional or observational study linked.' from nodes where type = 'disease'""",
    "visible_contacts": """, c as (select case when o_orderkey % 5 = 0 then 'm' else 'c' end || o_custkey as person_node_id from orders), seen as (select person_node_id, count(*) as n from c where person_node_id in (select id from nodes where type = 'person') group by 1)
        select *, 'scout' as role from seen union all select *, 'admin' from seen""",
    "cache_keys": """, p as (select src, count(*)::int as n_edges, sum(n_records)::bigint::varchar as payload from mech group by 1),
        r as (select n_edges, case when src like '%3' then 'new ' || payload else payload end as payload, src not like '%3' as valid from p)
        select n_edges, payload, valid, 64 as key_length, count(*) as n from r group by all""",
}

#: Those that also read connections; oracle.py puts its own tables of these before them.
FOCUS_SQL = {
    "plan_sections": """, own as (select distinct q.focus, q.candidate from quals q join mech m on m.id = q.edge_id where side = 'target' and m.src = q.candidate)
        select focus, candidate, 'viable' as section from conn where kind = 'mechanism' and supported union all select focus, candidate, 'network' from conn where kind = 'investigator'
        union all select focus, candidate, 'unsupported' from conn left join own using (focus, candidate) where kind = 'phenotype' or (kind = 'mechanism' and not supported) or (kind != 'mechanism' and own.focus is not null)""",
    "plan_tasks": """, best as (select * from conn where kind = 'mechanism' and supported qualify row_number() over (partition by focus order by n_qualifiers, n_phenotypes desc, name, candidate) = 1),
        g as (select disease, min_by(patient_group, id) as group_id from own_groups group by 1), gn as (select disease, n.name as group_name from g join nodes n on n.id = group_id)
        select focus, 'write-partner' as task_id, 'week' as grp, 'Write to ' || group_name as title,
          2 + (select count(*) from parents p where p.src = member and p.dst = focus) + (select count(*) from parents p where p.src = candidate)
          + (select count(*) from own_groups o where o.disease = candidate or o.disease in (select dst from parents p where p.src = candidate)) as n_edges from best join gn on disease = candidate
        union all select focus, 'confirm-' || edge_a, 'experiment', 'Confirm the mechanism for ' || n.name || ' variants', 1 from best join nodes n on n.id = member
        union all select focus, 'confirm-' || edge_b, 'experiment', 'Confirm the mechanism for ' || name || ' variants', 1 from best
        union all select fid, 'own-community', 'week', 'Talk to ' || group_name, 1 from focus join gn on disease = fid where fid not in (select focus from best)""",
    "outreach_drafts": """, best as (select * from conn where kind = 'mechanism' and supported qualify row_number() over (partition by focus order by n_qualifiers, n_phenotypes desc, name, candidate) = 1)
        select focus, 'Shared biology: ' || f.name || ' and ' || b.name as subject, 'We found cited evidence that ' || f.name || ' and ' || b.name || ' both involve ' || lower(v.name) || ' (' || edge_a || '; ' || edge_b || ').' || chr(10)
          || 'Which questions need expert review before we work together?' as body from best b join nodes f on f.id = focus join nodes v on v.id = via""",
}

ORACLE_SQL = {
    "read_model_evidence": _SOURCES
    + """, t as (select *, coalesce(source_url, '') = '' or source_type = 'placeholder' as sample from sources)
        select edge_id, id, case source_type when 'pubmed' then 'PubMed' when 'hpo' then 'HPO' when 'clinicaltrials' then 'ClinicalTrials' when 'nih_reporter' then 'RePORTER' when 'orphadata' then 'Orphanet' when 'mondo' then 'MONDO'
            when 'patient_organization' then 'PatientOrg' else 'other' end as source,
          case when sample then 'Placeholder: no real source yet' else case source_type when 'pubmed' then case when key % 2 = 0 then 'Order of ' || o_orderpriority else 'PubMed record ' || pmid end
            when 'clinicaltrials' then 'ClinicalTrials.gov NCT' || lpad(key::varchar, 8, '0') when 'mondo' then 'MONDO term MONDO:' || key when 'orphadata' then 'Orphadata gene associations, ORPHA:' || key
            when 'nih_reporter' then 'NIH RePORTER project ' || key when 'patient_organization' then 'Patient organization page, group-' || key || '.org' else 'blog' || key || '.net' end end as title,
          case when sample then '' else source_url end as url, pmid, sample
        from t join orders on o_orderkey = key""",
    "keep_last_event": "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type, min(event_id) as place from events group by 1",
    "money_by_funder": "select o_orderpriority as institute, sum(round(o_totalprice * 100)::bigint)::bigint as money, count(*) as n_awards from orders where round(o_totalprice * 100) > 0 group by 1",
    "money_by_project": "select o_custkey as project, sum(round(o_totalprice * 100)::bigint)::bigint as money, count(*) as n_awards from orders where round(o_totalprice * 100) > 0 group by 1",
    "cluster_members": "select p_brand || '/' || p_size as cluster_id, 'd' || p_partkey as disease, p_name as name from part",
    "source_chart": """with q as (select p_type as source, upper(p_name || ' ' || p_type) as query, p_size as retrieved, p_size * 3 as total from part)
        select source as key, sum(retrieved)::bigint as n, 'kept' as view from q group by 1 having n > 0 union all select source, sum(total)::bigint as n, 'all' from q group by 1 having n > 0
        union all select case when contains(query, 'TIN') then 'tin' when contains(query, 'STEEL') then 'Steel' when contains(query, 'COPPER') then 'copper' else 'other' end, sum(retrieved)::bigint as n, 'gene' from q group by 1 having n > 0""",
    "inventory_rollup": """select case when o_orderkey % 9 = 0 then 'root' else substr(o_orderpriority, 3, 20) end as folder, count(*) as n_files, count(*) filter (o_orderstatus != 'O') as n_data,
          count(*) filter (o_orderstatus = 'O') as n_housekeeping, sum(o_custkey)::bigint as bytes from orders group by 1""",
    "value_checks": _SOURCES
    + """select id, source_url is not null and source_type != 'blog' as url_ok,
          case source_type when 'clinicaltrials' then 'clinicaltrials.gov' when 'mondo' then 'example.org' when 'orphadata' then 'api.example.org' when 'nih_reporter' then 'reporter.nih.gov' when 'patient_organization' then 'group-' || key || '.org'
            when 'blog' then 'blog' || key || '.net' when 'pubmed' then 'pubmed.ncbi.nlm.nih.gov' end as host,
          case source_type when 'clinicaltrials' then 'NCT' || lpad(key::varchar, 8, '0') end as nct, case source_type when 'mondo' then 'MONDO:' || key end as mondo, pmid is not null as pmid_ok, false as slug_ok,
          coalesce(try_cast(retrieved_at as date) <= date '2021-06-30', false) as date_ok from sources""",
    "value_formats": """with o as (select *, case o_orderstatus when 'F' then 'RECRUITING' when 'O' then 'ACTIVE_NOT_RECRUITING' end as st from orders)
        select o_orderkey, day(o_orderdate) || strftime(o_orderdate, ' %b %Y') as day, '$' || format('{:,}', round(o_totalprice)::bigint) as money,
          (o_custkey % 3) || case when o_custkey % 3 = 1 then ' study' else ' studies' end as studies, case st when 'RECRUITING' then 'Recruiting' when 'ACTIVE_NOT_RECRUITING' then 'Active not recruiting' else 'Status not recorded' end as status,
          coalesce(st = 'RECRUITING', false) as open, case when o_orderkey % 2 = 0 then 'gain_of_function' else 'unknown' end as effect,
          case when o_orderkey % 2 != 0 then 'not_applicable' when o_orderkey % 3 = 0 then 'unknown' else 'gain_of_function' end as claim_effect, o_orderkey % 4 >= 2 as safe,
          'http://x.org/?a=1&api_key=[REDACTED]&b=2 Authorization: Bearer [REDACTED]' as redacted, case when regexp_full_match(o_orderpriority, '[A-Z0-9-]{1,12}') then o_orderpriority when length('O-' || o_orderkey) <= 12 then 'O-' || o_orderkey else o_orderpriority end as short from o""",
    "json_records": """select p_partkey, sha256('{"inner":{"files":["' || p_brand || '","raw/' || p_type || '"],"name":"' || p_name || '"},"size":' || p_size || '}') as digest, 3 as n_leaves, '"' || p_name || '"' as inner_name,
          true as has_brand, false as has_other, 'inner.files[1]' as raw_at, p_partkey % 2 = 0 as subset from part""",
    "record_violations": _SOURCES
    + """, n as (select *, case when p_partkey % 50 = 0 then 'Bad Id' else 'd' || p_partkey end as id from part),
        m as (select * from (select case when p_partkey % 90 = 0 then 'gone' else 'd' || p_partkey end as node_id, p_type as cluster_id from part) where node_id not like '%00' and node_id not like '%50')
        select 'node_slug' as rule, id as key from n where id = 'Bad Id' union all select 'node_synonyms', id from n where p_partkey % 60 = 0 union all select 'node_ext_ids', id from n where p_partkey % 70 = 0
        union all select 'node_placeholder', id from n where p_partkey % 80 = 0 union all select 'evidence_url', id from sources where source_url is null or source_type = 'blog'
        union all select 'evidence_source', id from sources where source_type = 'placeholder' union all select 'evidence_snippet', id from sources where snippet is null
        union all select 'evidence_day', id from sources where not coalesce(try_cast(retrieved_at as date) <= date '2021-06-30', false)
        union all select 'membership', k from (select distinct node_id || '|' || cluster_id as k from m where node_id = 'gone' or cluster_id like 'E%')
        union all select distinct 'cluster_label', p_type from part where p_type like 'S%'""",
    "reference_errors": """select o_orderkey::varchar as at, case when o_orderkey % 10 = 0 then 'raw/../' else 'raw/' end || o_orderkey as path,
          case when o_orderkey % 10 = 0 then 'unsafe' when o_orderkey % 11 = 0 then 'missing' when o_orderkey % 7 = 0 then 'changed' end as error from orders where error is not null""",
    "provenance_errors": """with p as (select *, p_partkey::varchar as id, p_partkey % 13 != 0 as known from part)
        select id, 'missing provenance' as error from p where not known union all select id, 'changed after review' from p where known and p_partkey % 9 = 0
        union all select id, 'source or curation inconsistent' from p where known and (p_partkey % 17 = 0 or p_partkey % 8 = 0)
        union all select id, 'source record changed' from p where known and p_partkey % 6 = 0 and p_size != 0""",
    "roles_of_users": """select c_custkey as user_id, case when c_custkey % 7 != 0 then (['family', 'group_leader', 'scout', 'researcher', 'admin'])[c_custkey % 5 + 1] end as role from customer
        union select o_custkey, null from orders where o_custkey not in (select c_custkey from customer)""",
    "visible_contributions": """with v(user_id, role) as (values (1, 'admin'), (2, 'group_leader'), (4, 'researcher'), (5, 'family'), (7, 'group_leader'))
        select v.user_id::bigint as user_id, o_orderkey as id from v, orders where role = 'admin' or (role in ('group_leader', 'researcher') and o_custkey = user_id)
          or (role = 'group_leader' and o_orderkey % 40 = (select c_custkey % 40 from customer where c_custkey = user_id))""",
    "curated_links": """select 'cur_subgroup_d' || p_partkey as id, 'd' || p_partkey as src, 'd' || (p_partkey - 3) as dst, 'subgroup_of' as type from part where p_partkey % 7 = 0 and p_partkey - 3 in (select p_partkey from part)
        union all select 'cur_variant_of_v' || p_partkey, 'v' || p_partkey, 'g' || p_brand, 'variant_of' from part where p_partkey % 2 = 0
        union all select 'cur_award_c' || o_custkey || '_o' || o_orderkey, 'c' || o_custkey, 'o' || o_orderkey, 'investigator_award' from orders where o_custkey in (select c_custkey from customer)""",
    "funding_projection": """select case when o_orderkey % 3 = 0 then 'NSF' else 'NIH' end as agency, o_orderpriority as code, year(o_orderdate)::int as fiscal_year, md5(string_agg(distinct 'o' || o_orderkey, ',' order by 'o' || o_orderkey)) as members,
          count(distinct o_orderkey) as n_applications, count(distinct o_custkey) as n_projects from orders group by 1, 2, 3""",
    "funding_errors": """with o as (select *, 'o' || o_orderkey as asset, o_orderkey % 31 != 0 and o_orderkey % 23 != 0 as known from orders)
        select asset, 'no application identity' as error from o where o_orderkey % 31 = 0 union all select asset, 'no source record' from o where not known union all select asset, 'another agency' from o where known and o_orderkey % 13 = 0
        union all select asset, 'title differs' from o where known and o_orderkey % 19 = 0 union all select asset, 'year differs' from o where known and o_orderkey % 17 = 0
        union all select asset, 'url differs' from o where known and o_orderkey % 29 = 0 union all select asset, 'funders differ' from o where known and o_orderkey % 11 = 0""",
    "reconciled_claims": """with c as (select p_partkey as claim_id, p_partkey % 5 != 0 as s_known, p_partkey % 3 != 0 as o_known, p_name, p_brand from part),
        l as (select p_name, count(distinct p_brand) as n from part where p_partkey % 2 = 0 group by 1),
        r as (select claim_id, s_known, o_known, c.p_name, p_brand, case when s_known and not o_known then least(5, coalesce(n, 0)) else 0 end as k from c left join l using (p_name))
        select claim_id, case when s_known and o_known then 'exact' when k > 0 then 'review' else 'new' end as outcome, case when s_known then p_name end as subject_id, case when o_known then p_brand end as object_id, k as n_candidates from r""",
    "contract_fields": """select 'part' as "table", * from (values ('p_brand', 'unexpected'), ('p_retailprice', 'unexpected'), ('p_size', 'unexpected'), ('p_type', 'unexpected'), ('p_comment', 'missing')) v(field, side)""",
    "fresh_snapshots": "select event_id from events where floor(epoch(timestamp '2024-01-20 00:00:00')) - floor(epoch(ts)) <= 48 * 3600",
    "request_errors": """with r as (select *, o_orderkey % 15 + 1 as n, o_custkey % 9 as rep from orders)
        select o_orderkey as id, case when (o_custkey % 4) * 101 > 300 then 'query_too_long' when n > 12 then 'too_many_edges' when rep > 1 and rep <= n then 'repeated_edge' when o_orderkey % 6 = 0 then 'invalid_edge_id' end as error
        from r where error is not null""",
}
