"""Building blocks of the check SQL: the derived tables as common table expressions."""

from __future__ import annotations

from effortlens.schema import FEATURES

SCALED = tuple(f.replace("feature_", "scaled_", 1) for f in FEATURES)

MODS = """
mods AS (
SELECT concat('c', cast(l_orderkey AS VARCHAR)) AS hash,
       c_name AS Author,
       concat(replace(lower(c_name), '#', '.'), '@example.org') AS Email,
       CASE WHEN o_orderpriority LIKE '1%' THEN concat('Fix ', p_name)
            WHEN o_orderpriority LIKE '2%' THEN concat('closes bug in ', p_name)
            WHEN o_orderpriority LIKE '3%' THEN concat('debug prefix for ', p_name)
            ELSE concat('add ', p_name) END AS message,
       concat(cast(o_orderdate - INTERVAL '1' DAY AS VARCHAR), '+00:00') AS authored_date,
       s_name AS Committer,
       concat(cast(o_orderdate AS VARCHAR), '+00:00') AS committed_date,
       cast(1 + o_custkey % 3 AS INT) AS number_of_branches,
       o_orderstatus <> 'P' AS in_main_branch,
       o_orderstatus = 'P' AS merge_commit,
       cast(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS number_of_mod_files,
       concat(replace(p_name, ' ', '_'), '_', cast(p_partkey AS VARCHAR), sfx) AS file_name,
       CASE WHEN l_returnflag = 'A' THEN 'ADD' WHEN l_returnflag = 'R' THEN 'DELETE' WHEN l_linenumber = 3 THEN 'RENAME' ELSE 'MODIFY' END AS file_change_type_name,
       CASE WHEN l_returnflag <> 'A' THEN concat('src/', p_brand, '/', replace(p_name, ' ', '_'), '_', cast(p_partkey AS VARCHAR), sfx) END AS file_old_path,
       CASE WHEN l_returnflag <> 'R' THEN concat('src/', CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'moved' ELSE p_brand END, '/', replace(p_name, ' ', '_'), '_', cast(p_partkey AS VARCHAR), sfx) END AS file_new_path,
       cast(l_linenumber % 5 AS INT) AS number_functions_before,
       cast(p_size % 6 AS INT) AS number_functions_after,
       cast(cast(l_quantity AS INT) % 4 AS INT) AS number_functions_edited,
       cast(l_quantity AS INT) AS number_lines_added,
       cast(round(l_discount * 100) AS INT) AS number_lines_removed,
       cast(p_size * 10 AS INT) AS file_number_loc,
       p_size % 7 NOT IN (4, 5) AS language_supported,
       cast(p_size * 12 AS INT) AS file_size,
       CASE WHEN l_linenumber <> 7 THEN l_tax * 10 END AS dmm_unit_size,
       CASE WHEN l_linenumber <> 7 THEN l_discount * 10 END AS dmm_unit_complexity,
       CASE WHEN l_linenumber <> 7 THEN l_tax * 5 + l_discount * 5 END AS dmm_unit_interfacing,
       cast(p_size AS INT) AS file_complexity,
       cast(p_size * 50 AS INT) AS tokens
FROM (SELECT *, CASE p_size % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.c++'
                     WHEN 4 THEN '.md' WHEN 5 THEN '' ELSE '.c#' END AS sfx FROM part) part_x
JOIN lineitem ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey)"""


def ext_sql(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '^.+\\.[^.]+$') THEN regexp_extract({column}, '^.+\\.([^.]+)$', 1) ELSE 'NoExt' END"


def path_ext_sql(column: str) -> str:
    tail = (
        f"regexp_extract(regexp_extract(string_split({column}, '/')[-1], '^.+(\\.[^.]+)$', 1), "
        f"'([a-zA-Z0-9\\s+_\\-]*)$', 1)"
    )
    return f"CASE WHEN regexp_matches(coalesce({tail}, ''), '\\S') THEN {tail} ELSE 'NoExt' END"


EXT = f"{MODS},\nfx AS (SELECT *, {ext_sql('file_name')} AS file_ext FROM mods)"

_TC = "(number_lines_added + number_lines_removed)"
_AD = "abs(number_functions_before - number_functions_after)"
_SPREAD = f"(pow({_AD}, 1.3) * pow({_TC}, 0.3) + pow(number_functions_edited, 1.1) * pow({_TC}, 0.3))"

FEATURED = f"""{EXT},
ft AS (SELECT *, {_TC} AS total_changed, {_AD} AS n_functions_add_del,
       pow({_TC}, 0.7) AS feature_total_changed,
       pow({_AD}, 1.3) * pow({_TC}, 0.5) AS feature_add_del_functions,
       pow(number_functions_edited, 1.1) * pow({_TC}, 0.5) AS feature_changed_functions,
       dmm_unit_complexity * {_SPREAD} AS feature_dmm_unit_complexity,
       dmm_unit_size * {_SPREAD} AS feature_dmm_size,
       dmm_unit_interfacing * {_SPREAD} AS feature_dmm_unit_interfacing
FROM fx),
fz AS (SELECT * REPLACE ({", ".join(f"coalesce({f}, 0.0) AS {f}" for f in FEATURES)}),
       row_number() OVER () AS rid,
       cast(floor((number_lines_added - 1) / 10.0) AS INT) AS cluster_id FROM ft)"""

FLAGGED = f"""{FEATURED},
ms AS (SELECT file_ext AS e, {", ".join(f"avg({f}) AS a{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(FEATURES))}
       FROM fz GROUP BY file_ext),
fl AS (SELECT fz.*, {" AND ".join(f"coalesce(s{i} >= 1e-12 AND abs({f} - a{i}) / nullif(s{i}, 0) < 3, false)" for i, f in enumerate(FEATURES))} AS is_inlier
       FROM fz JOIN ms ON file_ext = e)"""

RANGED = f"""{FEATURED},
rg AS (SELECT file_ext AS e, {", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(FEATURES))}
       FROM fz GROUP BY file_ext)"""

SCALED_ROWS = f"""{RANGED},
sc AS (SELECT fz.*, {", ".join(f"coalesce(({f} - lo{i}) / nullif(hi{i} - lo{i}, 0), 0.0) AS {s}" for i, (f, s) in enumerate(zip(FEATURES, SCALED)))}
       FROM fz JOIN rg ON file_ext = e)"""

MODEL = f"""{SCALED_ROWS},
mx AS (SELECT file_ext AS e, cluster_id AS cluster, count(*) AS n,
       {", ".join(f"avg({s}) AS m{i}, var_pop({s}) + 1e-6 AS v{i}" for i, s in enumerate(SCALED))}
       FROM sc GROUP BY file_ext, cluster_id),
mt AS (SELECT mx.*, n / sum(n) OVER (PARTITION BY mx.e) AS weight,
       {" + ".join(f"(m{i} * (CASE WHEN hi{i} = lo{i} THEN 1 ELSE hi{i} - lo{i} END) + lo{i})" for i in range(len(FEATURES)))} AS value
       FROM mx JOIN rg ON mx.e = rg.e)"""

POSTERIORS = f"""{MODEL},
dn AS (SELECT rid, cluster, value,
       ln(weight) - 0.5 * (6 * ln(2 * pi()) + {" + ".join(f"ln(v{i}) + ({s} - m{i}) * ({s} - m{i}) / v{i}" for i, s in enumerate(SCALED))}) AS lp
       FROM sc JOIN mt ON file_ext = e),
tp AS (SELECT rid, max(lp) AS top FROM dn GROUP BY rid),
pp AS (SELECT dn.rid, cluster, value, lp, exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY dn.rid) AS p
       FROM dn JOIN tp ON dn.rid = tp.rid)"""

# Extension md has no model, so the branch for that is taken too.
SCORED = f"""{POSTERIORS},
sd AS (SELECT fz.*, CASE WHEN pp.rid IS NULL THEN 'No Model found' ELSE cast(cluster_id AS VARCHAR) END AS predicted_cluster,
       coalesce(p, 0.0) AS probablities, coalesce(value, 0.0) AS sum_centroid,
       coalesce(p * value, 0.0) AS mod_score
       FROM fz LEFT JOIN pp ON fz.rid = pp.rid AND fz.cluster_id = pp.cluster AND fz.file_ext <> 'md')"""

CHART = f"""{FEATURED},
ch AS (SELECT *, feature_total_changed AS mod_score, split_part(committed_date, ' ', 1) AS day
       FROM fz WHERE language_supported AND file_ext <> 'NoExt' AND file_ext <> '')"""

HISTORY = f"""{MODS},
fy AS (SELECT file_name AS fn, substr(committed_date, 1, 4) AS y, min(concat(committed_date, '|', hash)) AS k
       FROM mods GROUP BY 1, 2),
lh AS (SELECT hash AS orig_hash, file_new_path AS path, split_part(k, '|', 2) AS blame_hash
       FROM mods JOIN fy ON file_name = fn AND substr(committed_date, 1, 4) = y WHERE file_new_path IS NOT NULL),
bl AS (SELECT DISTINCT orig_hash, blame_hash, concat('/repo/', path) AS file FROM lh)"""

FIXES = """
alive AS (SELECT path FROM (
    SELECT path, max(concat(committed_date, '|', rpad(hash, 20, ' '), '|', lives)) AS last FROM (
        SELECT file_new_path AS path, committed_date, hash, '1' AS lives FROM mods WHERE file_new_path IS NOT NULL
        UNION ALL
        SELECT file_old_path, committed_date, hash, '0' FROM mods
        WHERE file_old_path IS NOT NULL AND file_old_path IS DISTINCT FROM file_new_path) e GROUP BY 1) z
    WHERE last LIKE '%|1'),
fixes AS (SELECT * FROM mods
          WHERE regexp_matches(message, '\\b(bug|Bug|Fix|fix)\\b') AND number_of_mod_files < 15
            AND number_lines_added < 1000 AND file_new_path IN (SELECT path FROM alive))"""
