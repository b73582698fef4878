"""Graph operators on the derived commit graphs (G1 - G13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.operators import dag
from forklore.plans import classify

DISTANCE = """walk AS (
      SELECT pair_id, side, sha, 0 AS d FROM dag_head
      UNION
      SELECT w.pair_id, w.side, e.parent, w.d+e.parent_pos FROM walk w
      JOIN dag_edge e ON e.pair_id=w.pair_id AND e.sha=w.sha WHERE e.parent IS NOT NULL),
    near AS (SELECT pair_id, side, sha, min(d) AS d FROM walk GROUP BY 1, 2, 3),
    dist AS (SELECT g.pair_id, g.sha, g.commit_at, g.parent2 IS NOT NULL AS is_merge,
      f.d::INT AS distance_fork, u.d::INT AS distance_upstream
      FROM dag g LEFT JOIN near f ON f.pair_id=g.pair_id AND f.sha=g.sha AND f.side='fork'
      LEFT JOIN near u ON u.pair_id=g.pair_id AND u.sha=g.sha AND u.side='upstream'),
    class AS (SELECT pair_id, sha, commit_at, CASE WHEN distance_upstream IS NULL THEN 'only_F'
        WHEN distance_fork IS NULL THEN 'only_U' WHEN distance_fork<distance_upstream THEN 'F2U'
        WHEN distance_fork>distance_upstream THEN 'U2F' ELSE 'before' END AS category
      FROM dist WHERE NOT is_merge AND (distance_fork IS NOT NULL OR distance_upstream IS NOT NULL))"""

ANCESTORS = """anc AS (
      SELECT pair_id, sha, sha AS up FROM dag
      UNION
      SELECT a.pair_id, a.sha, e.parent FROM anc a
      JOIN dag_edge e ON e.pair_id=a.pair_id AND e.sha=a.up WHERE e.parent IS NOT NULL),
    line AS (
      SELECT pair_id, side, sha FROM dag_head
      UNION
      SELECT l.pair_id, l.side, d.parent1 FROM line l
      JOIN dag d ON d.pair_id=l.pair_id AND d.sha=l.sha WHERE d.parent1 IS NOT NULL),
    hist AS (SELECT h.pair_id, h.side, a.up AS sha, d.parent2 IS NOT NULL AS is_merge,
      l.sha IS NOT NULL AS on_line
      FROM dag_head h JOIN anc a ON a.pair_id=h.pair_id AND a.sha=h.sha
      JOIN dag d ON d.pair_id=a.pair_id AND d.sha=a.up
      LEFT JOIN line l ON l.pair_id=h.pair_id AND l.side=h.side AND l.sha=a.up),
    brought AS (SELECT h.pair_id, h.side, h.sha AS merge_sha, a.up AS sha
      FROM hist h JOIN dag d ON d.pair_id=h.pair_id AND d.sha=h.sha
      JOIN anc a ON a.pair_id=h.pair_id AND a.sha=h.sha
      JOIN dag c ON c.pair_id=a.pair_id AND c.sha=a.up AND c.parent2 IS NULL
      WHERE h.on_line AND h.is_merge AND NOT EXISTS (
        SELECT 1 FROM anc p WHERE p.pair_id=h.pair_id AND p.sha=d.parent1 AND p.up=a.up))"""


def _on_side_branches(sql: str) -> str:
    """The same SQL on the graphs whose merges bring in side branches."""
    return sql.replace("dag_edge", "side_edge").replace(" dag ", " side_dag ")


SOURCES = """source AS (
      SELECT pair_id, sha, parent2 AS at FROM dag WHERE parent2 IS NOT NULL
      UNION
      SELECT s.pair_id, s.sha, d.parent1 FROM source s
      JOIN dag d ON d.pair_id=s.pair_id AND d.sha=s.at AND d.parent2 IS NOT NULL),
    origin AS (SELECT s.pair_id, s.sha, s.at FROM source s
      JOIN dag d ON d.pair_id=s.pair_id AND d.sha=s.at AND d.parent2 IS NULL)"""


@query(
    "g01_edges_and_weights",
    """SELECT pair_id, sha, parent, parent_pos, parent_pos AS weight FROM dag_edge
    WHERE parent IS NOT NULL""",
)
def g01(t: Tables):
    history = t.dag.select(
        "pair_id", "sha", F.array_compact(F.array("parent1", "parent2")).alias("parents")
    )
    return dag.edge_weights(dag.edges_from_history(history))


@query(
    "g02_head_distances",
    f"""WITH RECURSIVE {DISTANCE}
    SELECT pair_id, sha, is_merge, coalesce(distance_fork, 999) AS distance_fork,
      coalesce(distance_upstream, 999) AS distance_upstream FROM dist""",
)
def g02(t: Tables):
    sides = ("distance_fork", "distance_upstream")
    return dag.head_distances(t.stored("dag_edge"), t.stored("dag_head")).select(
        "pair_id", "sha", "is_merge", *[dag.distance_label(s).alias(s) for s in sides]
    )


@query(
    "g03_all_categories",
    f"WITH RECURSIVE {DISTANCE} SELECT pair_id, sha, category FROM class",
)
def g03_all(t: Tables):
    return classify.classify_commits(t.stored("dag_edge"), t.stored("dag_head"))


@query(
    "g03_commit_categories",
    f"WITH RECURSIVE {DISTANCE} SELECT pair_id, sha, category FROM class WHERE category<>'before'",
)
def g03(t: Tables):
    return classify.four_way(classify.classify_commits(t.stored("dag_edge"), t.stored("dag_head")))


@query(
    "g04_categories_by_date",
    f"""WITH RECURSIVE {DISTANCE}
    SELECT c.pair_id, c.sha, c.commit_at AS committed_at,
      CASE WHEN CAST(c.commit_at AS DATE)<=f.forked_on THEN 'before' ELSE c.category END AS category
    FROM class c LEFT JOIN dag_fork_point f ON f.pair_id=c.pair_id""",
)
def g04(t: Tables):
    return dated_categories(t)


def dated_categories(t: Tables, graph: str = "dag", names: str = "dag"):
    """Categories by date on a graph, for the heads and fork points of ``names``."""
    dates = getattr(t, f"{graph}_dag" if graph != "dag" else graph).select(
        "pair_id", "sha", F.col("commit_at").alias("committed_at")
    )
    return classify.override_by_date(
        classify.classify_commits(t.stored(f"{graph}_edge"), t.stored(f"{names}_head")),
        dates,
        getattr(t, f"{names}_fork_point").select("pair_id", "forked_on"),
    )


@query(
    "g05_pairs_with_too_many_heads",
    """SELECT pair_id, max(n) AS n_heads FROM (
      SELECT pair_id, sha%2 AS side, count(DISTINCT sha) AS n FROM dag GROUP BY 1, 2)
    WHERE n>7 GROUP BY 1""",
)
def g05(t: Tables):
    heads = t.dag.select("pair_id", (F.col("sha") % 2).alias("side"), "sha")
    return dag.split_by_head_count(heads, 7)[1]


@query(
    "g06_merge_contributions",
    _on_side_branches(
        f"WITH RECURSIVE {ANCESTORS} SELECT pair_id, side, merge_sha, sha FROM brought"
    ),
)
def g06(t: Tables):
    return dag.merge_contributions(t.stored("side_edge"), dag.decompose_branches(t.stored("side_edge"), t.stored("dag_head")))


@query(
    "g07_set_algebra_classification",
    _on_side_branches(f"""WITH RECURSIVE {ANCESTORS}, {SOURCES},
    moved AS (SELECT b.pair_id, b.side, b.sha,
      bool_or(h.on_line AND NOT h.is_merge) AS from_line
      FROM brought b JOIN origin o ON o.pair_id=b.pair_id AND o.sha=b.merge_sha
      JOIN hist h ON h.pair_id=b.pair_id AND h.side<>b.side AND h.sha=o.at GROUP BY 1, 2, 3),
    node AS (SELECT pair_id, sha, bool_or(side='fork') AS in_f, bool_or(side='upstream') AS in_u,
      bool_or(side='fork' AND on_line AND NOT is_merge) AS line_f,
      bool_or(side='upstream' AND on_line AND NOT is_merge) AS line_u,
      bool_or(is_merge) AS is_merge FROM hist GROUP BY 1, 2),
    x AS (SELECT n.*, coalesce(mf.from_line, false) AS to_f, coalesce(mu.from_line, false) AS to_u,
      mf.sha IS NOT NULL AS any_f, s.sha IS NOT NULL AS second
      FROM node n
      LEFT JOIN moved mf ON mf.pair_id=n.pair_id AND mf.sha=n.sha AND mf.side='fork'
      LEFT JOIN moved mu ON mu.pair_id=n.pair_id AND mu.sha=n.sha AND mu.side='upstream'
      LEFT JOIN (SELECT DISTINCT d.pair_id, d.parent2 AS sha FROM dag d
        JOIN hist h ON h.pair_id=d.pair_id AND h.sha=d.sha AND h.side='fork' AND h.on_line
        JOIN dag p ON p.pair_id=d.pair_id AND p.sha=d.parent2 AND p.parent2 IS NOT NULL) s
        ON s.pair_id=n.pair_id AND s.sha=n.sha),
    y AS (SELECT *, to_f AND NOT to_u AS u2f, to_u AND NOT to_f AS f2u,
      in_u AND NOT in_f AND NOT is_merge AND NOT (to_f AND NOT to_u) AND NOT any_f AS rest FROM x)
    SELECT pair_id, count(*) FILTER (line_f AND NOT line_u AND NOT f2u) AS "only_F",
      count(*) FILTER (line_u AND NOT line_f AND NOT u2f) AS "only_U",
      count(*) FILTER (rest) AS only_U_with_prs, count(*) FILTER (f2u) AS "F2U",
      count(*) FILTER (u2f) AS "U2F", count(*) FILTER (any_f) AS "U2F_with_prs",
      count(*) FILTER (second AND NOT any_f AND NOT rest) AS syncs
    FROM y GROUP BY 1"""),
)
def g07(t: Tables):
    return classify.compare_histories(t.stored("side_edge"), t.stored("dag_head"))


@query(
    "g08_ancestor_closure",
    f"WITH RECURSIVE {ANCESTORS} SELECT pair_id, side, sha FROM hist",
)
def g08(t: Tables):
    return dag.reached(t.stored("dag_edge"), t.stored("dag_head")).select("pair_id", "side", "sha")


PATHS = """WITH RECURSIVE request AS (
      SELECT h.pair_id, h.sha AS descendant, min_by(d.sha, row(d.commit_at, d.sha)) AS ancestor
      FROM dag_head h JOIN dag d ON d.pair_id=h.pair_id GROUP BY 1, 2),
    walk AS (
      SELECT *, descendant AS sha, 0 AS step FROM request
      UNION
      SELECT w.pair_id, w.descendant, w.ancestor, e.parent, w.step+1 FROM walk w
      JOIN dag_edge e ON e.pair_id=w.pair_id AND e.sha=w.sha WHERE e.parent IS NOT NULL),
    near AS (SELECT pair_id, descendant, ancestor, sha, min(step) AS step FROM walk GROUP BY ALL),
    prev AS (SELECT n.pair_id, n.descendant, n.ancestor, n.sha, n.step, min(c.sha) AS via
      FROM near n JOIN dag_edge e ON e.pair_id=n.pair_id AND e.parent=n.sha
      JOIN near c ON c.pair_id=n.pair_id AND c.descendant=n.descendant AND c.sha=e.sha
        AND c.step=n.step-1 GROUP BY ALL),
    path AS (
      SELECT pair_id, descendant, ancestor, sha, step FROM near WHERE sha=ancestor
      UNION
      SELECT p.pair_id, p.descendant, p.ancestor, v.via, p.step-1 FROM path p
      JOIN prev v ON v.pair_id=p.pair_id AND v.descendant=p.descendant AND v.sha=p.sha)
    SELECT pair_id, descendant, ancestor, sha, step FROM path"""


def _on_deep_lines(sql: str) -> str:
    """The same SQL on few graphs with lines of thousands of commits."""
    return sql.replace("dag_edge", "deep_edge").replace("dag_head", "deep_head").replace(" dag ", " deep_dag ")


@query("g08_shortest_paths", PATHS)
def g08b(t: Tables):
    return dag.shortest_paths(t.stored("dag_edge"), _oldest(t, "dag", "dag_head"))


def _oldest(t: Tables, graph: str, head: str):
    """Each head and the oldest commit of its pair."""
    return t.sql(
        f"""SELECT h.pair_id, h.sha AS descendant,
        min_by(d.sha, struct(d.commit_at, d.sha)) AS ancestor
        FROM {head} h JOIN {graph} d ON d.pair_id=h.pair_id GROUP BY 1, 2"""
    )


@query("g08_deep_history", _on_deep_lines(PATHS))
def g08_deep(t: Tables):
    return dag.shortest_paths(t.stored("deep_edge"), _oldest(t, "deep_dag", "deep_head"))


@query(
    "g06_deep_history",
    """WITH RECURSIVE line AS (
      SELECT pair_id, side, sha, 0 AS below FROM deep_head
      UNION ALL
      SELECT l.pair_id, l.side, d.parent1, l.below+1 FROM line l
      JOIN deep_dag d ON d.pair_id=l.pair_id AND d.sha=l.sha WHERE d.parent1 IS NOT NULL),
    walk AS (
      SELECT l.pair_id, l.side, l.below, e.parent AS sha FROM line l
      JOIN deep_edge e ON e.pair_id=l.pair_id AND e.sha=l.sha
      LEFT JOIN line n ON n.pair_id=l.pair_id AND n.side=l.side AND n.sha=e.parent
      WHERE e.parent IS NOT NULL AND n.sha IS NULL
      UNION
      SELECT w.pair_id, w.side, w.below, e.parent FROM walk w
      JOIN deep_edge e ON e.pair_id=w.pair_id AND e.sha=w.sha
      LEFT JOIN line n ON n.pair_id=w.pair_id AND n.side=w.side AND n.sha=e.parent
      WHERE e.parent IS NOT NULL AND n.sha IS NULL),
    first AS (SELECT pair_id, side, sha, max(below) AS below FROM walk GROUP BY 1, 2, 3)
    SELECT f.pair_id, f.side, l.sha AS merge_sha, f.sha FROM first f
    JOIN line l ON l.pair_id=f.pair_id AND l.side=f.side AND l.below=f.below
    JOIN deep_dag m ON m.pair_id=l.pair_id AND m.sha=l.sha AND m.parent2 IS NOT NULL
    JOIN deep_dag c ON c.pair_id=f.pair_id AND c.sha=f.sha AND c.parent2 IS NULL""",
)
def g06_deep(t: Tables):
    edges = t.stored("deep_edge")
    return dag.merge_contributions(edges, dag.decompose_branches(edges, t.stored("deep_head")))


@query(
    "g09_merges_by_parent_membership",
    """WITH f AS (SELECT pair_id, sha FROM dag WHERE sha%3<>0),
    u AS (SELECT pair_id, sha FROM dag WHERE sha%4<>1),
    x AS (SELECT d.pair_id, d.sha, d.parent2 IS NOT NULL AS is_merge,
      s.sha IS NOT NULL AS in_f, v.sha IS NOT NULL AS in_u,
      (f1.sha IS NOT NULL)<>(f2.sha IS NOT NULL) AS one_f,
      (u1.sha IS NOT NULL)<>(u2.sha IS NOT NULL) AS one_u
      FROM dag d LEFT JOIN f s ON s.pair_id=d.pair_id AND s.sha=d.sha
      LEFT JOIN u v ON v.pair_id=d.pair_id AND v.sha=d.sha
      LEFT JOIN f f1 ON f1.pair_id=d.pair_id AND f1.sha=d.parent1
      LEFT JOIN f f2 ON f2.pair_id=d.pair_id AND f2.sha=d.parent2
      LEFT JOIN u u1 ON u1.pair_id=d.pair_id AND u1.sha=d.parent1
      LEFT JOIN u u2 ON u2.pair_id=d.pair_id AND u2.sha=d.parent2),
    k AS (SELECT pair_id, sha, CASE
      WHEN is_merge AND in_u AND one_f AND NOT (in_f AND one_u) THEN 'merge_to_upstream'
      WHEN is_merge AND in_f AND one_u AND NOT (in_u AND one_f) THEN 'sync_from_upstream'
      WHEN NOT is_merge AND in_f AND NOT in_u THEN 'only_in_fork'
      WHEN NOT is_merge AND in_u AND NOT in_f THEN 'only_in_upstream' END AS kind FROM x)
    SELECT * FROM k WHERE kind IS NOT NULL""",
)
def g09(t: Tables):
    fork = t.dag.filter(F.col("sha") % 3 != 0).select("pair_id", F.lit("fork").alias("side"), "sha")
    upstream = t.dag.filter(F.col("sha") % 4 != 1).select(
        "pair_id", F.lit("upstream").alias("side"), "sha"
    )
    return classify.classify_merges_by_parents(
        t.dag.select("pair_id", "sha", "parent1", "parent2"), fork.unionByName(upstream)
    )


@query(
    "g10_commit_types_by_author",
    """WITH c AS (SELECT pair_id, sha, sha%11 AS who, parent1, parent2, pair_id%11 AS owner,
      (pair_id+3)%11 AS up FROM dag)
    SELECT c.pair_id AS repo_id, c.sha, CASE
      WHEN c.who=c.up OR c.owner=c.up THEN 'sync_upstream'
      WHEN c.parent1 IS NOT NULL AND c.parent2 IS NULL AND c.who=c.owner THEN 'origin'
      WHEN c.parent2 IS NOT NULL AND (c.parent1%11=c.up OR c.parent2%11=c.up) THEN 'sync_upstream'
      ELSE 'other' END AS commit_type FROM c""",
)
def g10(t: Tables):
    def login(value):
        return F.concat(F.lit("user"), value.cast("string"))

    def mail(value):
        return F.concat(value.cast("string"), F.lit("@example.org"))

    who = F.col("sha") % 11
    commits = t.dag.select(
        F.col("pair_id").alias("repo_id"),
        "sha",
        login(who).alias("login"),
        F.lit(None).cast("string").alias("name"),
        mail(who).alias("email"),
        "parent1",
        "parent2",
    )
    repos = t.dag.select(F.col("pair_id").alias("repo_id")).distinct()
    own, up = F.col("repo_id") % 11, (F.col("repo_id") + 3) % 11
    owners = repos.select(
        "repo_id", login(own).alias("owner_login"), F.array(login(own), mail(own)).alias("contacts")
    )
    upstream = repos.select(
        "repo_id",
        login(up).alias("up_login"),
        F.lit(None).cast("string").alias("up_name"),
        F.array(mail(up)).alias("up_emails"),
    )
    return classify.classify_by_author(commits, owners, upstream)


FORK_TREE = """WITH RECURSIVE tree AS (
      SELECT repo_id AS root_id, repo_id, 0 AS level FROM repository_tree
        WHERE parent_id IS NULL OR parent_id NOT IN (SELECT repo_id FROM repository_tree)
      UNION ALL
      SELECT tr.root_id, r.repo_id, tr.level+1 FROM tree tr
      JOIN repository_tree r ON r.parent_id=tr.repo_id)
    SELECT root_id, repo_id, level FROM tree WHERE level>0"""


@query("g11_fork_tree", FORK_TREE)
def g11(t: Tables):
    return dag.fork_tree(t.repository_tree)


@query("g11_fork_tree_recursive", FORK_TREE)
def g11_recursive(t: Tables):
    return dag.fork_tree_recursive(t.repository_tree)


@query(
    "g12_upstream_resolution",
    """SELECT r.repo_id, r.url, coalesce(u.url, r.url) AS upstream_url FROM repository r
    LEFT JOIN repository u ON u.repo_id=r.parent_id""",
)
def g12(t: Tables):
    return dag.resolve_upstream(t.repository)


@query(
    "g12_fork_and_upstream_test",
    """WITH p AS (SELECT a.url AS fork_url, b.url AS upstream_url FROM repository a
      JOIN repository b ON b.repo_id=a.repo_id - a.repo_id%4)
    SELECT p.fork_url, p.upstream_url, EXISTS (SELECT 1 FROM fork_pair f
      WHERE f.fork_url=p.fork_url AND f.upstream_url=p.upstream_url) AS is_pair FROM p""",
)
def g12b(t: Tables):
    pairs = t.sql(
        """SELECT a.url AS fork_url, b.url AS upstream_url FROM repository a
        JOIN repository b ON b.repo_id=a.repo_id - a.repo_id%4"""
    )
    return dag.are_fork_and_upstream(pairs, t.repository)


@query(
    "g13_branch_decomposition",
    _on_side_branches(f"""WITH RECURSIVE {ANCESTORS}
    SELECT pair_id, side, sha, on_line, is_merge, CASE WHEN on_line AND NOT is_merge THEN 'origin'
      WHEN on_line THEN 'merge_point' WHEN NOT is_merge THEN 'contribution'
      ELSE 'inner_merge' END AS role FROM hist"""),
)
def g13(t: Tables):
    return dag.decompose_branches(t.stored("side_edge"), t.stored("dag_head")).drop("depth")


@query(
    "g04_printed_results",
    f"""WITH RECURSIVE {DISTANCE}, counts AS (
      SELECT pair_id, count(*) FILTER (category='only_F') AS f, count(*) FILTER (category='only_U') AS u,
        count(*) FILTER (category='F2U') AS fu, count(*) FILTER (category='U2F') AS uf FROM class GROUP BY 1)
    SELECT concat('f', pair_id, ',u', pair_id, ',', f, ',', u, ',', fu, ',', uf, ',') AS line FROM counts""",
)
def g04_lines(t: Tables):
    counts = classify.fork_commit_counts(t.stored("dag_edge"), t.stored("dag_head"))
    named = counts.select(
        "*",
        F.concat(F.lit("f"), "pair_id").alias("fork_url"),
        F.concat(F.lit("u"), "pair_id").alias("upstream_url"),
    )
    return classify.graph_result_lines(named)
