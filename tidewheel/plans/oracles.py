"""DuckDB SQL of the registered queries, assembled from common table expressions."""

from __future__ import annotations

from tidewheel.functions.mapping import BOT_LOGINS
from tidewheel.sources.items import STAND_IN_DUCKDB

_BOTS = ", ".join(f"'{b}'" for b in BOT_LOGINS)
BOT = f"coalesce(author_is_bot, regexp_replace(lower(trim(author)), '^app/', '') IN ({_BOTS}) OR ends_with(lower(trim(author)), '[bot]'))"
COSINE = "CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0 ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"
TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def description(n: str) -> str:
    n = f"({n})::DOUBLE"
    return f"(CASE WHEN {n} = 0 THEN 0.0 WHEN {n} < 50 THEN 0.1 WHEN {n} < 200 THEN 0.3 + ({n} - 50) / 150 * 0.3 WHEN {n} < 1000 THEN 0.6 + ({n} - 200) / 800 * 0.3 ELSE 0.9 + least(0.1, ({n} - 1000) / 5000 * 0.1) END)"


DIFF = "(CASE WHEN additions + deletions <= 50 THEN 1.0 WHEN additions + deletions <= 200 THEN 0.8 WHEN additions + deletions <= 500 THEN 0.6 WHEN additions + deletions <= 1000 THEN 0.4 WHEN additions + deletions <= 5000 THEN 0.2 ELSE 0.1 END)::DOUBLE"
CI = "(CASE ci_status WHEN 'success' THEN 1.0 WHEN 'failure' THEN 0.0 ELSE 0.5 END)::DOUBLE"
REVIEWS = "least(1.0::DOUBLE, coalesce(review_count, 0) / 3.0::DOUBLE)"
CLUSTER_SCORE = (
    f"((CASE WHEN has_tests THEN 1.0 WHEN NOT has_tests THEN 0.0 ELSE 0.5 END)::DOUBLE * 0.25::DOUBLE + {CI} * 0.2::DOUBLE"
    f" + (CASE WHEN additions IS NOT NULL AND deletions IS NOT NULL THEN {DIFF} ELSE 0.5::DOUBLE END) * 0.15::DOUBLE"
    f" + {description('length(body)')}::DOUBLE * 0.15::DOUBLE + {REVIEWS} * 0.1::DOUBLE + 0.075::DOUBLE)"
)
ITEMS = f"items AS ({STAND_IN_DUCKDB}), vec AS (SELECT i.item_id, i.number, i.repo, CAST(e.embedding AS DOUBLE[]) AS v FROM items i JOIN embeddings e ON e.vec_id = i.number)"


def graph(t: float, prefix: str = "", dims: int | None = None) -> str:
    """Eligible vectors, edges and components at a threshold."""
    v = "v" if dims is None else f"list_slice(v, 1, {dims})"
    p = prefix
    return f"""
{p}taking AS (SELECT item_id, {v} AS v FROM vec WHERE item_id NOT IN (SELECT item_id FROM items WHERE {BOT}) AND len(list_filter({v}, lambda x: x <> 0)) > 0),
{p}edges AS (SELECT * FROM (SELECT a.item_id AS src, b.item_id AS dst, {COSINE.format(a='a.v', b='b.v')} AS sim FROM {p}taking a JOIN {p}taking b ON a.item_id < b.item_id) WHERE sim >= {t}),
{p}links AS (SELECT src, dst FROM {p}edges UNION ALL SELECT dst, src FROM {p}edges),
{p}reach AS (SELECT src AS a, src AS b FROM {p}links UNION SELECT r.a, e.dst FROM {p}reach r JOIN {p}links e ON e.src = r.b),
{p}parts AS (SELECT a AS item_id, min(b) AS part FROM {p}reach GROUP BY a)"""


REFINED = f"""
sized AS (SELECT item_id, part, count(*) OVER (PARTITION BY part) AS m FROM parts),
dims AS (SELECT s.part, unnest(t.v) AS x, generate_subscripts(t.v, 1) AS d FROM sized s JOIN taking t USING (item_id) WHERE m > 3),
means AS (SELECT part, d, avg(x) AS x FROM dims GROUP BY part, d),
centroid AS (SELECT part, list(x ORDER BY d) AS c FROM means GROUP BY part),
judged AS (SELECT s.item_id, s.part, {COSINE.format(a='t.v', b='c.c')} >= 0.35 AS near FROM sized s JOIN taking t USING (item_id) JOIN centroid c USING (part) WHERE m > 3),
back AS (SELECT DISTINCT f.item_id, f.part FROM judged f JOIN links b ON b.src = f.item_id JOIN judged n ON n.item_id = b.dst AND n.near WHERE NOT f.near),
kept AS (SELECT item_id, part FROM judged WHERE near UNION ALL SELECT item_id, part FROM back),
main AS (SELECT item_id, part FROM (SELECT *, count(*) OVER (PARTITION BY part) AS m FROM kept) WHERE m >= 2),
loose AS (SELECT item_id, part FROM judged WHERE NOT near AND item_id NOT IN (SELECT item_id FROM back)),
again AS (SELECT b.src, b.dst FROM links b JOIN loose x ON x.item_id = b.src JOIN loose y ON y.item_id = b.dst AND x.part = y.part),
reach2 AS (SELECT src AS a, src AS b FROM again UNION SELECT r.a, e.dst FROM reach2 r JOIN again e ON e.src = r.b),
final AS (SELECT item_id, part FROM sized WHERE m <= 3 UNION ALL SELECT item_id, part FROM main UNION ALL SELECT a, 'again ' || min(b) FROM reach2 GROUP BY a)"""


def clusters(t: float, refined: bool) -> str:
    """Clusters and members in their order; at 0.40 refinement is still part of the definition."""
    source = REFINED.replace("0.35", str(t)) if refined else "final AS (SELECT item_id, part FROM parts)"
    return f"""WITH RECURSIVE {ITEMS}, {graph(t)}, {source},
stats AS (SELECT x.part, avg(sim) AS a, least(1.0, min(sim)) AS m FROM (
  SELECT f.part, {COSINE.format(a='p.v', b='q.v')} AS sim FROM final f JOIN final g ON f.part = g.part AND f.item_id < g.item_id
  JOIN taking p ON p.item_id = f.item_id JOIN taking q ON q.item_id = g.item_id) x GROUP BY x.part),
scored AS (SELECT *, {CLUSTER_SCORE} AS score FROM items),
present AS (SELECT s.*, f.part, count(*) OVER (PARTITION BY f.part) AS size FROM final f JOIN scored s USING (item_id)),
heads AS (SELECT part, any_value(size) AS size, arg_min(title, (-score, item_id)) AS theme, min((repo, number)) AS low FROM present WHERE size >= 2 GROUP BY part),
clusters AS (SELECT (row_number() OVER (ORDER BY size DESC, low))::INTEGER AS cluster_id, part, size, theme, a AS avg_similarity, m AS min_similarity FROM heads JOIN stats USING (part)),
members AS (SELECT c.cluster_id, p.* FROM present p JOIN clusters c USING (part))
"""


TIER = "(CASE state WHEN 'merged' THEN 4 WHEN 'open' THEN 3 WHEN 'closed' THEN 1 ELSE 0 END)"
CI_RANK = "(CASE WHEN ci_status = 'failure' THEN 0 ELSE 1 END)"


def decisions(mode: str | None = None) -> str:
    """CTEs on top of ``members``: ranks and one decision for each cluster."""
    chosen = f"'{mode}'" if mode else "CASE WHEN sum((type = 'issue')::INT) OVER w * 2 > count(*) OVER w THEN 'issue' ELSE 'pr' END"
    return f"""
moded AS (SELECT *, {chosen} AS mode, {TIER} AS tier, {CI_RANK} AS ci FROM members WINDOW w AS (PARTITION BY cluster_id)),
ranked AS (SELECT *, CASE WHEN mode = 'issue'
    THEN row_number() OVER (PARTITION BY cluster_id ORDER BY created_at ASC NULLS LAST, score DESC, number, item_id)
    ELSE row_number() OVER (PARTITION BY cluster_id ORDER BY tier DESC, ci DESC, score DESC, created_at ASC NULLS LAST, coalesce(review_count, 0) DESC, number, item_id) END AS rank,
  row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, item_id) AS by_score FROM moded),
decided AS (SELECT a.cluster_id, a.mode, a.item_id AS canonical, b.item_id AS runner_up,
    CASE WHEN b.item_id IS NULL THEN false
      WHEN a.mode = 'issue' THEN CASE WHEN a.created_at IS NULL AND b.created_at IS NULL THEN true ELSE coalesce(abs(epoch_ms(a.created_at) - epoch_ms(b.created_at)) <= 86400000, false) END
      ELSE a.tier = b.tier AND a.ci = b.ci AND a.score - b.score < 0.05 END AS contested,
    s1.score - s2.score AS margin
  FROM ranked a LEFT JOIN ranked b ON b.cluster_id = a.cluster_id AND b.rank = 2
  LEFT JOIN ranked s1 ON s1.cluster_id = a.cluster_id AND s1.by_score = 1 LEFT JOIN ranked s2 ON s2.cluster_id = a.cluster_id AND s2.by_score = 2 WHERE a.rank = 1)"""


SECTIONS = """
pairs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id < 40 THEN vec_id // 2 WHEN vec_id < 80 THEN 20 + (vec_id - 40) // 4 END AS idx FROM embeddings WHERE vec_id < 80),
cells AS (SELECT idx, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM pairs),
cell_means AS (SELECT idx, d, avg(x) AS x FROM cells GROUP BY idx, d),
sections AS (SELECT idx, 'section ' || idx AS heading, list(x ORDER BY d) AS c FROM cell_means GROUP BY idx)"""
VISION = f"""WITH {ITEMS}, {SECTIONS},
sims AS (SELECT v.item_id, s.idx, s.heading, {COSINE.format(a='v.v', b='s.c')} AS sim FROM vec v CROSS JOIN sections s),
best AS (SELECT item_id, arg_max(heading, (sim, -idx)) AS heading, max(sim) AS sim FROM sims GROUP BY item_id),
scores AS (SELECT item_id, greatest(sim, 0.0) AS score, CASE WHEN sim >= 0.65 THEN 'aligned' WHEN sim >= 0.4 THEN 'drifting' ELSE 'off-vision' END AS classification,
  CASE WHEN sim > 0 THEN heading ELSE '' END AS section FROM best)
"""
