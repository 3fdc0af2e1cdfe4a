"""SQL for the rows of the registered queries, over the driver's tables. GRAPH holds the tables seen as a graph."""

from __future__ import annotations

from . import oracle_build, oracle_graph, oracle_model, oracle_plan

GRAPH = """
with recursive rec as (
  select 'd' || l_partkey as disease, 'm' || l_suppkey as mechanism, l_orderkey as order_key,
    case l_returnflag when 'A' then 'supports' when 'R' then 'contradicts' else 'neutral' end as stance,
    case l_linestatus when 'F' then 'verified' else 'unverified' end as status,
    case when l_linenumber <= 3 then 'A' when l_linenumber <= 5 then 'B' when l_linenumber = 6 then 'C' else 'D' end as tier,
    l_linenumber as line, l_quantity as quantity, l_shipdate::date as retrieved_at
  from lineitem
), m_rows as (
  select disease as src, mechanism as dst, stance, max(status) as status, min(tier) as tier, count(*) as n_records from rec group by all
), i_rows as (
  select 'c' || o_custkey as src, disease as dst, stance, max(status) as status, min(tier) as tier, count(*) as n_records
  from rec join orders on order_key = o_orderkey group by all
), a_rows as (
  select 'o' || order_key as src, disease as dst, stance, max(status) as status, min(tier) as tier, count(*) as n_records from rec group by all
), p_rows as (
  select 'd' || p_partkey as src, 't' || p_type as dst from part union all select 'd' || p_partkey, 'tBROAD' from part where p_size >= 10
), n_rows as (
  select distinct 'n' || s_nationkey as src, disease as dst from rec join supplier on mechanism = 'm' || s_suppkey where stance = 'supports'
), edges as (
  select 'disease_mechanism|' || src || '|' || dst || '|' || stance as id, src, dst, 'disease_mechanism' as type, tier, stance, status, n_records from m_rows
  union all select 'investigator_disease|' || src || '|' || dst || '|' || stance, src, dst, 'investigator_disease', tier, stance, status, n_records from i_rows
  union all select 'asset_disease|' || src || '|' || dst || '|' || stance, src, dst, 'asset_disease', tier, stance, status, n_records from a_rows
  union all select 'disease_gene|d' || p_partkey || '|g' || p_brand || '|supports', 'd' || p_partkey, 'g' || p_brand, 'disease_gene', 'A', 'supports', 'verified', 1 from part
  union all select 'disease_phenotype|' || src || '|' || dst || '|supports', src, dst, 'disease_phenotype', 'B', 'supports', 'verified', 1 from p_rows
  union all select 'group_disease|' || src || '|' || dst || '|supports', src, dst, 'group_disease', 'A', 'supports', 'verified', 1 from n_rows
  union all select 'subgroup_of|d' || p_partkey || '|d' || (p_partkey - 3) || '|supports', 'd' || p_partkey, 'd' || (p_partkey - 3), 'subgroup_of', 'A', 'supports', 'verified', 1
    from part where p_partkey % 10 = 3
), nodes as (
  select 'd' || p_partkey as id, 'disease' as type, p_name as name from part
  union all select 'm' || s_suppkey, 'mechanism', s_name from supplier
  union all select 'c' || c_custkey, 'person', c_name from customer
  union all select 'o' || o_orderkey, 'asset', o_orderpriority from orders
  union all select distinct 'g' || p_brand, 'gene', p_brand from part
  union all select distinct 't' || p_type, 'phenotype', p_type from part
  union all select 'tBROAD', 'phenotype', 'BROAD'
  union all select 'n' || n_nationkey, 'patient_group', n_name from nation
), evidence as (
  select 'disease_mechanism|' || disease || '|' || mechanism || '|' || stance as edge_id, 'line' || line as source_type, order_key, quantity, retrieved_at from rec
), mech as (select * from edges where type = 'disease_mechanism'),
inv as (select * from edges where type = 'investigator_disease'),
parents as (select * from edges where type = 'subgroup_of'),
known as (select distinct least(src, dst) as a, greatest(src, dst) as b from parents),
m_links as (select distinct src as disease, dst as target from mech where stance = 'supports' and status = 'verified'),
m_use as (select distinct src as disease, dst as target from mech where stance = 'supports'),
i_links as (select distinct dst as disease, src as target from inv where stance = 'supports' and status = 'verified'),
i_use as (select distinct dst as disease, src as target from inv where stance = 'supports'),
p_links as (select distinct src as disease, dst as target from edges where type = 'disease_phenotype'),
awards as (
  select 'o' || o_orderkey as asset, 'c' || o_custkey as person, o_orderkey as application, o_custkey as project, year(o_orderdate) as fiscal_year, o_orderpriority as institute, o_totalprice as total_cost from orders
), assets as (select distinct src as asset, dst as disease from edges where type = 'asset_disease' and stance = 'supports'),
mc as (select 'm' || s_suppkey as node_id, 'r' || n_regionkey as cluster_id from supplier join nation on s_nationkey = n_nationkey),
own_cluster as (select distinct disease as node_id, cluster_id from m_links join mc on target = node_id),
d_cluster as (
  select * from own_cluster union select dst, cluster_id from parents join own_cluster on src = node_id
), members as (
  select * from mc union select * from d_cluster
  union select dst, cluster_id from edges join d_cluster on src = node_id where type in ('disease_gene', 'disease_phenotype') and stance = 'supports'
  union select src, cluster_id from edges join d_cluster on dst = node_id where type in ('group_disease', 'asset_disease', 'investigator_disease') and stance = 'supports'
)
"""

_FOCUS = """, focus as (select 'd' || p_partkey as fid from part where p_partkey % 100 = 0),
mem as (select fid as focus, fid as member from focus union select dst, src from parents join focus on dst = fid),
fam as (select focus, member as candidate from mem union select src, dst from parents join focus on src = fid),
contra as (select src as disease, dst as mechanism, id as edge_id from mech where stance = 'contradicts'),
held as (select distinct focus, target as mechanism from mem join m_use on disease = member),
qual as (
  select distinct h.focus, t.candidate, c.edge_id, 'target' as side from held h join contra c using (mechanism)
    join (select id as candidate, id as disease from nodes where type = 'disease' union all select src, dst from parents) t on t.disease = c.disease
  union
  select distinct m.focus, u.disease, c.edge_id, 'own' from mem m join contra c on c.disease = m.member join m_use u on u.target = c.mechanism
), quals as (select * from qual q where not exists (select 1 from fam f where f.focus = q.focus and f.candidate = q.candidate)),
ph_n as (select target as phenotype, count(*) as n_diseases, count(*) <= greatest(1, floor((select count(distinct disease) from p_links) / 3)) as informative from p_links group by 1),
ph as (select x.disease as focus, y.disease as candidate, x.target as phenotype, n_diseases, informative
  from focus join p_links x on x.disease = fid join p_links y on y.target = x.target and y.disease != x.disease join ph_n on ph_n.phenotype = x.target),
ph_count as (select focus, candidate, count(*) as n from ph group by all),
way as (
  select 0 as o, 'mechanism' as kind, m.focus, m.member, y.src as candidate, x.dst as via, x.tier != 'C' and y.tier != 'C' as supported, x.id as edge_a, y.id as edge_b
    from mem m join mech x on x.src = m.member and x.stance = 'supports' join mech y on y.dst = x.dst and y.stance = 'supports' and y.src != x.src
  union all
  select 1, 'investigator', m.focus, m.member, y.dst, x.src, false, x.id, y.id
    from mem m join inv x on x.dst = m.member and x.stance = 'supports' join inv y on y.src = x.src and y.stance = 'supports' and y.dst != x.dst
), linked as (
  select * from way w where not exists (select 1 from known k where k.a = least(w.member, w.candidate) and k.b = greatest(w.member, w.candidate))
  union all select 2, 'phenotype', focus, null, candidate, null, false, null, null from ph_count
), first_way as (
  select * from linked l where not exists (select 1 from fam f where f.focus = l.focus and f.candidate = l.candidate)
  qualify row_number() over (partition by focus, candidate order by o, via, member, supported, edge_a, edge_b) = 1
), own_groups as (select dst as disease, src as patient_group, id from edges where type = 'group_disease'),
groups_n as (select disease, count(*) as n from (
    select disease, patient_group from own_groups union select p.src, o.patient_group from parents p join own_groups o on o.disease = p.dst) group by 1),
conn as (
  select f.focus, f.candidate, c.name, f.kind, f.via, f.member, f.supported, coalesce(p.n, 0) as n_phenotypes,
    (select count(*) from quals q where q.focus = f.focus and q.candidate = f.candidate) as n_qualifiers, coalesce(g.n, 0) as n_communities,
    case f.kind when 'mechanism' then 'Both have cited evidence for ' || lower(v.name) || '.'
      when 'investigator' then v.name || ' is listed on NIH awards for both. Shared expertise, not shared biology.'
      else 'Shares ' || coalesce(p.n, 0) || ' symptom annotation' || case when p.n = 1 then '' else 's' end || ', none specific enough to suggest shared biology.' end as reason,
    f.edge_a, f.edge_b, f.o
  from first_way f join nodes c on c.id = f.candidate left join nodes v on v.id = f.via left join ph_count p on p.focus = f.focus and p.candidate = f.candidate left join groups_n g on g.disease = f.candidate
)
"""

_HITS = """, n0 as (
  select n.id, n.type, n.name, lower(n.name) as folded, coalesce(c.degree / c.top, 0) as centrality, p.p_partkey, lower(p.p_brand) as synonym, lower(p.p_type) as related
  from nodes n left join (select node_id, count(*) as degree, max(count(*)) over () as top from (select src as node_id from edges where tier != 'C' union all select dst from edges where tier != 'C') group by 1) c on c.node_id = n.id
    left join part p on n.id = 'd' || p.p_partkey
), n1 as (select *, trim(regexp_replace(folded, '[\\s_-]+', ' ', 'g')) as f, regexp_replace(synonym, '[\\s_-]+', ' ', 'g') as syn, regexp_replace(related, '[\\s_-]+', ' ', 'g') as rel from n0),
asked as (select unnest(['Brand#13', 'blue', 'ECONOMY', '17', 'part:23', 'Part 24', '  ', 'no such thing', 'br']) as q),
q1 as (select q, lower(trim(q)) as z from asked where trim(q) != ''),
hits as (
  select q, id, type, name, centrality, case
    when f = z then ['name', '100'] when p_partkey is not null and z in (p_partkey::varchar, 'part:' || p_partkey, 'part ' || p_partkey) then ['id', '95']
    when syn = z then ['synonym', '90'] when starts_with(f, z) then ['name', '70'] when starts_with(syn, z) then ['synonym', '60']
    when length(z) >= 3 and contains(f, z) then ['name', '50'] when length(z) >= 3 and contains(syn, z) then ['synonym', '40'] when length(z) >= 3 and contains(rel, z) then ['related', '30'] end as r
  from n1, q1
), hit as (select q, id, type, name, r[1] as via, r[2]::int + centrality as score from hits where r is not null)
"""

_GRAPH_SQL = {
    "shared_mechanism_pairs": "select x.disease as a, y.disease as b, count(*) as n_shared from m_links x join m_links y on x.target = y.target and x.disease < y.disease group by all",
    "live_edges": "select * from edges where status != 'rejected'",
    "supported_edges": "select id, src, dst, type, tier from edges where stance = 'supports' and status = 'verified'",
    "graph_view_types": """select id, src, dst from edges where src in (select id from nodes where type in ('disease', 'mechanism', 'gene', 'patient_group'))
        and dst in (select id from nodes where type in ('disease', 'mechanism', 'gene', 'patient_group'))""",
    "semantic_edge_merge": "select * from mech",
    "edge_evidence_nested_counts": "select id, count(edge_id) as n_evidence, max(retrieved_at)::varchar as newest from edges left join evidence on edge_id = id group by id",
    "edges_without_evidence": "select id, type from edges where id not in (select edge_id from evidence)",
    "node_degree_centrality": """select node_id, count(*) as degree, count(*) / max(count(*)) over () as centrality
        from (select src as node_id from edges where tier != 'C' union all select dst from edges where tier != 'C') group by node_id""",
    "link_sets": """select disease, kind, string_agg(target, ',' order by target) as targets, count(*) as n
        from (select *, 'mechanism' as kind from m_links union all select *, 'person' from i_links) group by disease, kind""",
    "shared_investigator_pairs": "select x.disease as a, y.disease as b, count(*) as n_shared from i_links x join i_links y on x.target = y.target and x.disease < y.disease group by all",
    "bridge_jaccard": """, pairs as (select x.disease as a, y.disease as b, count(*) as n_shared from m_links x join m_links y on x.target = y.target and x.disease < y.disease group by all),
        sizes as (select disease, count(*) as n from m_links group by disease),
        j as (select p.a, p.b, n_shared, n_shared::double / (x.n + y.n - n_shared) as jaccard
          from pairs p join sizes x on x.disease = p.a join sizes y on y.disease = p.b where (p.a, p.b) not in (select a, b from known)),
        n as (select *, (least(greatest(jaccard, 0.05), 0.95) * 144115188075855872)::bigint * 25 as n from j)
        select a, b, n_shared, jaccard, ((n >> 55) + case when n & 36028797018963967 > 18014398509481984 or (n & 36028797018963967 = 18014398509481984 and (n >> 55) % 2 = 1) then 1 else 0 end) / 100.0 as strength from n""",
    "inferred_links_per_mechanism": """select x.src as a, y.src as b, x.dst as via_id, x.id as edge_a, y.id as edge_b, x.n_records + y.n_records as n_evidence
        from mech x join mech y on x.dst = y.dst and x.src < y.src where x.stance = 'supports' and y.stance = 'supports' and (x.src, y.src) not in (select a, b from known)""",
    "inferred_links_per_person": """select x.dst as a, y.dst as b, x.src as via_id, x.id as edge_a, y.id as edge_b, x.n_records + y.n_records as n_evidence
        from inv x join inv y on x.src = y.src and x.dst < y.dst where x.stance = 'supports' and y.stance = 'supports' and (x.dst, y.dst) not in (select a, b from known)""",
    "cluster_weights": """, pairs as (select x.disease as a, y.disease as b, count(*) as n_mechanisms from m_links x join m_links y on x.target = y.target and x.disease < y.disease group by all),
        counted as (select p.a, p.b, n_mechanisms, (select count(*) from p_links x join p_links y on x.target = y.target where x.disease = p.a and y.disease = p.b) as n_phenotypes from pairs p)
        select *, 3 * n_mechanisms + n_phenotypes as weight from counted""",
    "membership_propagation": "select * from members",
    "bridge_flag_edges": """select id, exists (select 1 from members where node_id = src) and exists (select 1 from members where node_id = dst)
        and not exists (select 1 from members x join members y on x.cluster_id = y.cluster_id where x.node_id = src and y.node_id = dst) as bridge from mech""",
    "shared_phenotypes_informative": """, total as (select count(distinct src) as total from edges where type = 'disease_phenotype')
        select target as phenotype, count(*) as n_diseases, total, count(*) <= greatest(1, floor(total / 3)) as informative from p_links, total group by target, total""",
    "qualifiers_per_focus": _FOCUS + "select focus, candidate, edge_id, side from quals",
    "shared_phenotypes_of_focus": _FOCUS + "select focus, candidate, phenotype, n_diseases, informative from ph",
    "communities_with_parent": """, own as (select dst as disease, src as patient_group from edges where type = 'group_disease')
        select *, false as via_parent from own union all
        select *, true from (select p.src, o.patient_group from parents p join own o on o.disease = p.dst except select * from own)""",
    "connections_all": _FOCUS + "select focus, candidate, name, kind, via, supported, n_phenotypes, n_qualifiers, n_communities, reason from conn",
    "connections_ranked": _FOCUS
    + """select focus, candidate, kind, supported, n_qualifiers, n_phenotypes, row_number() over (partition by focus order by o, supported desc, n_qualifiers, n_phenotypes desc, name, candidate) as rank
        from conn qualify rank <= 40""",
    "route_edges": _FOCUS
    + """, main as (select focus, candidate, list_filter([(select id from parents p where p.src = member and p.dst = focus), edge_a, edge_b], lambda x: x is not null) as es from conn where kind != 'phenotype'),
        ends as (select focus, candidate, 0 as v, candidate as disease from main union all select m.focus, m.candidate, 1, p.dst from main m join parents p on p.src = m.candidate),
        tail as (
          select m.focus, m.candidate, 0 as o, 0 as v, p.id as edge_id from main m join parents p on p.src = m.candidate
          union all select e.focus, e.candidate, 1, v, g.id from ends e join own_groups g on g.disease = e.disease
          union all select e.focus, e.candidate, 2, v, a.id from ends e join edges a on a.type = 'asset_disease' and a.stance = 'supports' and a.dst = e.disease
            where a.src in (select asset from awards where institute like '1-%'))
        select focus, candidate, 'route' as part, unnest(range(len(es))) as step, unnest(es) as edge_id from main
        union all select focus, candidate, 'community', row_number() over (partition by focus, candidate order by o, v, edge_id) - 1, edge_id from tail""",
    "no_route_reasons": """, focus as (select 'd' || p_partkey as fid from part where p_partkey % 100 = 0),
        mem as (select fid as focus, fid as member from focus union select dst, src from parents join focus on dst = fid),
        fam as (select focus, member as candidate from mem union select src, dst from parents join focus on src = fid),
        few as (select * from mech where tier = 'A' and n_records > 1 and src like '%5' and stance = 'supports'),
        way as (select m.focus, m.member, y.src as candidate from mem m join few x on x.src = m.member join few y on y.dst = x.dst and y.src != x.src),
        linked_f as (select distinct focus from way w where not exists (select 1 from known k where k.a = least(member, candidate) and k.b = greatest(member, candidate)) and not exists (select 1 from fam f where f.focus = w.focus and f.candidate = w.candidate)),
        held as (select src as id, list_sort(list(distinct lower(n.name))) as held from few join nodes n on n.id = dst group by 1)
        select f.fid as focus,
          case when exists (select 1 from p_links x join p_links y on x.target = y.target and x.disease = f.fid and y.disease != f.fid where not exists (select 1 from fam where fam.focus = f.fid and fam.candidate = y.disease)) then 'only_broad_phenotypes' else 'no_shared_mechanism' end as reason,
          case when len(held) > 0 then 'No other condition in this atlas has cited evidence for ' || array_to_string(held, ' or ') || '.' else 'No cited mechanism is recorded for ' || n.name || ' yet.' end as missing,
          coalesce(len(held), 0) as n_mechanisms
        from focus f join nodes n on n.id = f.fid left join held h on h.id = f.fid where f.fid not in (select focus from linked_f)""",
    "search_scored": _HITS + "select q, id as node_id, via, score, row_number() over (partition by q order by score desc, name, id) as rank from hit qualify rank <= 20",
    "search_genes_resolved": _HITS
    + """, every as (
          select q, id as node_id, type, via, null::varchar as resolved_from, 0 as late, -score as a, name as b, id as c from hit
          union all select q, e.src, 'disease', 'gene', h.id, 1, -score, h.name || '|' || h.id, e.id from hit h join edges e on e.type = 'disease_gene' and e.dst = h.id where h.type = 'gene'
        ), one as (select * from every where type = 'disease' qualify row_number() over (partition by q, node_id order by late, a, b, c) = 1)
        select q, node_id, via, resolved_from, row_number() over (partition by q order by late, a, b, c) as rank from one qualify rank <= 20""",
    "search_no_match": _HITS + "select q from asked where q not in (select q from hit)",
    "two_hop_neighbourhood": """, seen as (select src, dst from mech union all select src, dst from parents),
        way as (select src as x, dst as y from seen union select dst, src from seen),
        reach as (select 'd' || p_partkey as start, 'd' || p_partkey as node_id, 0 as hops from part where p_partkey % 100 = 0
          union select start, y, hops + 1 from reach join way on node_id = x where hops < 2)
        select start, node_id, min(hops) as hops from reach group by start, node_id""",
    "explain_path": """, ok as (select * from mech where stance = 'supports' and status = 'verified' and tier != 'D' and id in (select edge_id from evidence where quantity >= 5)),
        paths as (select x.id as e1, y.id as e2 from mech x join mech y on x.dst = y.dst and x.src != y.src where x.stance = 'supports' and y.stance = 'supports' and x.src in (select 'd' || p_partkey from part where p_partkey % 100 = 0)),
        flags as (select e1 || '~' || e2 as path_id, 2 as n_edges, e1 in (select id from ok) and e2 in (select id from ok) as eligible from paths)
        select path_id, n_edges, eligible, eligible as connected, case when eligible then 'explained' else 'ineligible_edge' end as verdict from flags""",
    "assets_for_disease": """select src as asset, min(id) as first_edge, string_agg(distinct dst, ',' order by dst) as diseases from edges where type = 'asset_disease' and stance = 'supports' group by src""",
    "funding_groups": "select institute, fiscal_year, count(distinct application) as n_applications, count(distinct project) as n_projects from awards group by all",
    "funding_money_by_condition": """, n as (select asset, count(*) as n from assets group by asset)
        select disease, sum(round(total_cost * 1e6 / n)::bigint)::bigint / 1e6 as money, count(*) as n_awards from assets join n using (asset) join awards using (asset) where total_cost > 0 group by disease""",
    "funding_top_other": """, t as (select institute || ' ' || fiscal_year as funder, count(*) as n from awards group by all),
        r as (select *, row_number() over (order by n desc, funder) as place, count(*) over () as many from t)
        select funder, n, place from r where many <= 8 or place < 8
        union all select 'Other (' || count(*) || ')', sum(n)::bigint, 8 from r where many > 8 and place >= 8 having count(*) > 0""",
    "funding_gaps": "select id from nodes where type = 'disease' and id not in (select disease from assets)",
    "duplicate_signals": """select cluster_id, institute as category, count(distinct asset) as n_assets, count(distinct g.dst) as n_genes
        from assets join awards using (asset) join members on node_id = disease left join edges g on g.src = disease and g.type = 'disease_gene'
        group by all having count(distinct asset) >= 2 and count(distinct g.dst) >= 2""",
    "ranked_clusters": """, f as (select cluster_id, count(*) filter (type = 'disease') as n_diseases, count(*) filter (type = 'patient_group') as n_groups,
          count(*) filter (type = 'person') as n_people, count(*) filter (type = 'asset') as n_assets from members join nodes on id = node_id group by cluster_id)
        select *, row_number() over (order by n_diseases desc, n_groups desc, n_people desc, cluster_id) as rank from f""",
    "mechanism_index": """select dst as mechanism, count(distinct src) filter (stance = 'supports') as n_supports, count(distinct src) filter (stance = 'contradicts') as n_against,
        count(distinct src) filter (stance = 'neutral') as n_neutral, count(*) filter (status = 'verified') as n_verified from mech group by dst""",
    "investigators_ranked": """, c as (select target as person, count(distinct cluster_id) as n_clusters from i_use join members on node_id = disease group by target)
        select target as person, count(*) as n_diseases, coalesce(any_value(n_clusters), 0) as n_clusters, (select count(*) from awards w where w.person = target) as n_awards,
          coalesce(any_value(n_clusters), 0) > 1 as shared from i_use left join c on c.person = target group by target""",
    "evidence_by_source": "select source_type, count(*) as n, count(distinct edge_id) as n_edges from evidence group by source_type",
    "coverage_counts": """select (select count(*) from nodes) as n_nodes, (select count(*) from nodes where type = 'disease') as n_diseases, (select count(*) from edges) as n_edges,
        (select count(*) from edges where status = 'verified') as n_verified, (select count(*) from edges where stance = 'contradicts') as n_contradicting,
        (select count(*) from evidence) as n_evidence, (select max(retrieved_at)::varchar from evidence) as newest""",
    "coverage_report": """, q(query) as (values ('GERMANY'), ('Supplier#000000001'), ('  economy '), ('no such thing'), ('BRAND#1')),
        h as (select query, id, lower(name) = lower(trim(query)) as exact from q join nodes on contains(lower(name), lower(trim(query)))),
        k as (select * from h where exact or query not in (select query from h where exact)),
        good as (select * from edges where stance = 'supports' and status = 'verified' and tier in ('A', 'B') and id in (select edge_id from evidence)),
        f as (select query, count(distinct g.id) as n from k join good g on g.src = k.id or g.dst = k.id group by query)
        select query, (select count(*) from k where k.query = q.query) as n_nodes, coalesce((select n from f where f.query = q.query), 0) as n_edges from q""",
    "contract_violations": """, e as (select * from mech union all select * from parents)
        select 'inferred_verified' as rule, id as key from e where tier = 'C' and status = 'verified'
        union all select 'dangling_end', id from e where src not in (select id from nodes) union all select 'dangling_end', id from e where dst not in (select id from nodes)
        union all select 'edge_without_evidence', id from e where id not in (select edge_id from evidence)
        union all select 'evidence_edge', edge_id from evidence where edge_id not in (select id from e)
        union all select 'evidence_date', edge_id from evidence where retrieved_at is null or retrieved_at > current_date""",
    "dangling_endpoints": """, few as (select id from nodes where type != 'mechanism' or id < 'm5'), ends as (select id, 'src' as end, src as node from edges union all select id, 'dst', dst from edges)
        select * from ends where node not in (select id from few)""",
    "visible_edges_by_role": """select type, count(*) as n, 'admin' as role from edges group by type union all select type, count(*), 'family' from edges where status = 'verified' group by type""",
    "visible_evidence_counts": "select source_type, count(*) as n from evidence where edge_id in (select id from mech where status = 'verified') group by source_type",
    "cache_rows_visible": "select src as cache_key, count(*) as n_edges from mech group by src having bool_and(status = 'verified')",
    "review_queue": """select id, tier, case when tier = 'D' then case when stance = 'supports' then 'approved' else 'rejected' end end as decision from mech where tier in ('C', 'D')""",
}

_GAP = "interval 1 hour"

ORACLE_SQL: dict[str, str] = {name: GRAPH + sql for name, sql in _GRAPH_SQL.items()} | {
    "quote_containment": r"""with n as (select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as body from documents), q0 as (select item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as quote from benchmark),
        q as (select * from q0 union all select -item_id, trim(substr(quote, 3, 14)) from q0 where item_id % 10 = 0)
        select doc_id, item_id from n, q where contains(body, quote) and quote != ''""",
    "prf_levels": """with d as (select d.doc_id, source, (n_chars > 400)::int as found, l.quality from documents d join labels l using (doc_id)),
        k as (select 'exact' as level, doc_id::varchar as key, quality, found from d union all select 'source', source, quality, found from d union all select 'label', '', quality, found from d),
        g as (select level, key, quality as v, count(*) as g from k group by all), f as (select level, key, found as v, count(*) as p from k group by all),
        t as (select level, sum(coalesce(g, 0))::bigint as n_gold, sum(coalesce(p, 0))::bigint as n_found, sum(least(coalesce(g, 0), coalesce(p, 0)))::bigint as n_match
          from g full join f using (level, key, v) group by level),
        r as (select *, case when n_found > 0 then n_match / n_found else 0 end as precision, case when n_gold > 0 then n_match / n_gold else 0 end as recall from t)
        select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from r""",
    "duplicate_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "contribution_review_view": """select o_orderkey as id, 'c' || o_custkey as src, 'd1' as dst, case when o_orderkey % 3 = 0 then 'unverified' when o_orderstatus = 'F' then 'verified'
        when o_orderstatus = 'O' then 'unverified' else 'rejected' end as status from orders""",
    "snapshot_diff": """with b as (select o_orderkey, o_orderpriority as x from orders where o_orderkey % 5 != 0),
        a as (select o_orderkey, case when o_orderkey % 11 = 0 then 'changed' else o_orderpriority end as y from orders where o_orderkey % 7 != 0)
        select o_orderkey, case when x is null then 'added' when y is null then 'removed' else 'modified' end as change from b full join a using (o_orderkey) where x is null or y is null or x != y""",
    "additive_only": """select l_orderkey, l_linenumber from lineitem except all
        (select l_orderkey, l_linenumber from lineitem where l_linenumber != 7 union all select l_orderkey, l_linenumber from lineitem where l_linenumber = 1)""",
    "upsert_antijoin": """with n as (select c_custkey + 100 as c_custkey, 'NEW' as c_mktsegment from customer where c_custkey % 4 = 0)
        select * from n union all select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey from n)""",
    "sha256_records": "select page_id, sha256(coalesce(html, '')) as sha256, length(html) as n_chars from pages",
    "intent_classification": r"""select conv_id, turn, case when regexp_matches(q, '\b(why|how)\b.*\b(connected|linked|related|connect|link)\b') then 'route'
        when regexp_matches(q, '\b(contradict\w*|against|refut\w*|conflict\w*|disagree\w*)\b') then 'contradictions' when regexp_matches(q, '\b(fund\w*|grants?|awards?|nih|money|financ\w*)\b') then 'funding'
        when regexp_matches(q, '\b(stud(y|ies)|trials?|registr(y|ies)|natural history|biorepositor(y|ies)|biobank|resources?|assets?|data)\b') then 'resources'
        when regexp_matches(q, '\b(this week|next steps?|what (should|can) (we|i)|do next|action|plan)\b') then 'action'
        when regexp_matches(q, '\b(share\w*|similar|closest|related|connections?|partners?|communit(y|ies)|groups?|other (conditions|diseases))\b') then 'connections'
        when regexp_matches(q, '\b(who|researchers?|investigators?|experts?|labs?|scientists?|works? on|working on)\b') then 'people'
        when regexp_matches(q, '\b(mechanisms?|cause\w*|biology|variants?|gain of function|loss of function)\b') then 'mechanism' else 'overview' end as intent
        from (select conv_id, turn, lower(text) as q from conversations)""",
    "gene_like_tokens": r"""select distinct doc_id, token from (select doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{2,}[0-9]{1,3}[A-Z]?)\b', 1)) as token from documents)
        where token not in ('NIH', 'FDA', 'HPO', 'NCT', 'PMID', 'DNA', 'RNA')""",
    "session_valid": "with l as (select user_id, max(ts) as t from events group by user_id) select user_id from l where t + interval 1 day > (select max(t) from l)",
    "rate_limit_accept": f"""with recursive acc as (select user_id, min(ts) as t from events group by user_id
          union all select a.user_id, (select min(e.ts) from events e where e.user_id = a.user_id and e.ts >= a.t + {_GAP}) from acc a where a.t is not null)
        select e.user_id, count(*) as n, (select count(a.t) from acc a where a.user_id = e.user_id) as n_accepted from events e group by e.user_id""",
    "attempt_window": """with recursive w as (select user_id, min(ts) as t from events group by user_id
          union all select a.user_id, (select min(e.ts) from events e where e.user_id = a.user_id and e.ts >= a.t + interval 1 day) from w a where a.t is not null),
        n as (select e.event_id, e.user_id, row_number() over (partition by e.user_id, w.t order by e.ts, e.event_id) as k
          from events e join w on w.user_id = e.user_id and e.ts >= w.t and e.ts < w.t + interval 1 day)
        select event_id, user_id from n where k > 3""",
    "routes": GRAPH + """, l as (select distinct src as disease, dst as target from edges where type = 'disease_mechanism' and stance = 'supports' and status = 'verified')
        select x.disease as a, y.disease as b, min(x.target) as mechanism from l x join l y on x.target = y.target and x.disease < y.disease group by all""",
    "name_matches": """with n as (select p_partkey as id, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) as key from part, unnest([p_name, p_brand, p_type]) t(x)),
        i as (select key, min(id) as id from n where key != '' group by key)
        select 'disease' as type, text, id from (select distinct p_type as text from part) left join i on key = trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))""",
    "candidates_in_context": GRAPH + """, c as (select src, count(distinct dst) as n from edges
          where type = 'disease_mechanism' and stance = 'supports' and status = 'verified' group by src)
        select distinct id as subject, 'disease_mechanism' as relation, coalesce(n, 0) as n_candidates, n is null as fallback from nodes left join c on id = src where nodes.type = 'disease'""",
    "quote_locators": r"""with q as (select doc_id, text, array_to_string(string_split(text, ' ')[6:15], ' ') as quote from documents),
        v as (select *, coalesce(quote != '' and trim(quote) = quote and len(regexp_extract_all(quote, '\S+')) <= 25, false) as valid from q),
        l as (select *, case when valid then nullif(strpos(text, quote), 0) - 1 end as start from v)
        select doc_id, valid, start, start + length(quote) as "end", sha256(quote) as sha256 from l""",
    "quote_word_budget": r"""with w as (select conv_id, coalesce(sum(len(regexp_extract_all(text, '\S+'))), 0)::bigint as n_words from (select distinct conv_id, text from conversations) group by conv_id)
        select conv_id, n_words, n_words > 25 as "over" from w""",
    "nfkd_search": r"select p_partkey, trim(regexp_replace(lower(p_name), '[\s_-]+', ' ', 'g')) as folded from part",
    "funding_shares": """with c as (select o_orderpriority as institute, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by 1),
        s as (select institute, cents, cents / (sum(cents) over ())::double as share,
          coalesce(sum(cents) over (order by cents desc, institute rows between unbounded preceding and 1 preceding), 0)::bigint / (sum(cents) over ())::double as "offset" from c)
        select *, case when share < 0.01 then '<1%' else floor(share * 100 + 0.5)::bigint || '%' end as label from s""",
}

ORACLE_SQL |= oracle_model.ORACLE_SQL | {name: GRAPH + sql for name, sql in oracle_model.GRAPH_SQL.items()}
ORACLE_SQL |= {name: GRAPH + sql for name, sql in (oracle_graph.GRAPH_SQL | oracle_build.GRAPH_SQL | oracle_plan.GRAPH_SQL).items()} | oracle_build.SQL | oracle_plan.ORACLE_SQL
ORACLE_SQL |= {name: GRAPH + _FOCUS + sql for name, sql in (oracle_model.FOCUS_SQL | oracle_plan.FOCUS_SQL).items()}
