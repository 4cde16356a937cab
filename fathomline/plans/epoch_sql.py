"""DuckDB SQL of near-exact runs and of the selection policies: one set of table expressions for each epoch.

Written from the epoch semantics, not from the Spark code: greedy covers are unrolled step by step, first-fit clusters
and the adaptive cap are recursive queries. Windows and containers of 256, position sampling of 1 in 9.
"""

from __future__ import annotations

FP = "('0x' || replace(chunk_id, ':', ''))::BIGINT"
RATE = "round({0}::DOUBLE / nullif({1}, 0), 6)"
NO_LOADS = "SELECT ''::VARCHAR AS trace, 0::BIGINT AS seq, ''::VARCHAR AS kind, 0::BIGINT AS subset_id, 0::INT AS load_rank WHERE false"


def _cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


def greedy(name: str, pairs: str, steps: int, size: str = "1") -> list[str]:
    """Greedy cover of ``pairs (trace, seq, chunk_id, subset_id)``: at each step the subset with the most uncovered hooks over ``size``, ties to the smaller id."""
    out, left = [], pairs
    for t in range(1, steps + 1):
        out.append(_cte(f"{name}_p{t}", f"SELECT trace, seq, subset_id FROM (SELECT trace, seq, subset_id, count(DISTINCT chunk_id)::DOUBLE / {size} AS g FROM {left} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY trace, seq ORDER BY g DESC, subset_id) = 1"))
        out.append(_cte(f"{name}_l{t}", f"SELECT l.* FROM {left} l ANTI JOIN (SELECT trace, seq, chunk_id FROM {left} JOIN {name}_p{t} USING (trace, seq, subset_id)) c USING (trace, seq, chunk_id)"))
        left = f"{name}_l{t}"
    out.append(_cte(name, " UNION ALL ".join(f"SELECT trace, seq, subset_id, {t}::INT AS load_rank FROM {name}_p{t}" for t in range(1, steps + 1))))
    return out


def level(name: str, candidates: str, made: str, cap: int, reach: int = 2) -> list[str]:
    """First-fit clusters of ``candidates (trace, seq, subset_id, score)`` around their first member's ``made``; the best cluster in scan order."""
    near = f"coalesce(list_position(list_transform(l.centers, lambda x: abs(c.made - x) <= {reach}), true), 0)"
    return [
        _cte(f"{name}_c", f"SELECT *, row_number() OVER (PARTITION BY trace, seq ORDER BY score DESC, subset_id) AS r FROM {candidates} JOIN {made} USING (trace, subset_id)"),
        f"""{name}_f AS (SELECT trace, seq, r, [made] AS centers, 1 AS k, subset_id, score FROM {name}_c WHERE r = 1
        UNION ALL SELECT c.trace, c.seq, c.r, CASE WHEN {near} = 0 THEN list_append(l.centers, c.made) ELSE l.centers END, CASE WHEN {near} = 0 THEN len(l.centers) + 1 ELSE {near} END, c.subset_id, c.score
        FROM {name}_f l JOIN {name}_c c ON c.trace = l.trace AND c.seq = l.seq AND c.r = l.r + 1)""",
        _cte(name, f"""SELECT trace, seq, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY r))::INT AS load_rank
        FROM {name}_f JOIN (SELECT trace, seq, k FROM (SELECT trace, seq, k, sum(score) AS total FROM {name}_f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY trace, seq ORDER BY total DESC, k) = 1) USING (trace, seq, k)
        QUALIFY load_rank <= {cap}"""),
    ]


def hybrid(name: str, pairs: str, limit: int) -> list[str]:
    """Recipes by greedy cover of ``recipe_hook``, then containers by ``cnr_ptr`` hits without those that the recipes' hooks overlap."""
    out = [_cte(f"{name}_rp", f"SELECT trace, seq, chunk_id, subset_id FROM {pairs} WHERE role = 'recipe_hook'"), *greedy(f"{name}_r", f"{name}_rp", limit)]
    out.append(_cte(f"{name}_cov", f"SELECT DISTINCT trace, seq, chunk_id, 1 AS covered FROM {name}_rp SEMI JOIN {name}_r USING (trace, seq, subset_id)"))
    out.append(_cte(f"{name}_gone", f"SELECT trace, seq, subset_id FROM (SELECT DISTINCT trace, seq, chunk_id, subset_id FROM {pairs} WHERE role = 'cnr_hook') LEFT JOIN {name}_cov USING (trace, seq, chunk_id) GROUP BY ALL HAVING count(covered) > floor(0.6::DOUBLE * count(*))"))
    out.append(_cte(f"{name}_c", f"SELECT trace, seq, subset_id, count(DISTINCT chunk_id) AS score FROM {pairs} ANTI JOIN {name}_gone USING (trace, seq, subset_id) WHERE role = 'cnr_ptr' GROUP BY ALL"))
    return [*out, both(name)]


def both(name: str) -> str:
    return _cte(name, f"""SELECT trace, seq, kind, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY first, own))::INT AS load_rank FROM (
        SELECT trace, seq, 'recipe' AS kind, subset_id, 0 AS first, load_rank AS own FROM {name}_r
        UNION ALL SELECT trace, seq, 'container', subset_id, 1, row_number() OVER (PARTITION BY trace, seq ORDER BY score DESC, subset_id) FROM {name}_c)""")


def basic(name: str, pairs: str, recipes: int = 6) -> list[str]:
    """Recipes by greedy cover; containers by the hits that the chosen recipes' ``recipe_ptr`` hooks leave."""
    return [
        _cte(f"{name}_rp", f"SELECT trace, seq, chunk_id, subset_id FROM {pairs} WHERE role = 'recipe_hook'"), *greedy(f"{name}_r", f"{name}_rp", recipes),
        _cte(f"{name}_c", f"""SELECT trace, seq, subset_id, count(DISTINCT chunk_id) AS score FROM {pairs}
        ANTI JOIN (SELECT trace, seq, chunk_id FROM {pairs} SEMI JOIN {name}_r USING (trace, seq, subset_id) WHERE role = 'recipe_ptr') g USING (trace, seq, chunk_id) WHERE role = 'cnr_ptr' GROUP BY ALL"""),
        both(name)]


def dense(name: str, pairs: str, sizes: str, cap: int, recipes: int = 5) -> list[str]:
    """Greedy by hooks over the subset's chunks: recipes, then containers for the hooks that are left."""
    sized = f"SELECT trace, seq, chunk_id, subset_id, coalesce(chunk_num, 1) AS chunk_num FROM {pairs} LEFT JOIN (SELECT trace, subset_id, chunk_num FROM {sizes} WHERE kind = '{{0}}') USING (trace, subset_id) WHERE role = '{{1}}'"
    return [
        _cte(f"{name}_rp", sized.format("recipe", "recipe_hook")), *greedy(f"{name}_r", f"{name}_rp", recipes, "any_value(chunk_num)"),
        _cte(f"{name}_cp", f"SELECT * FROM ({sized.format('container', 'cnr_ptr')}) ANTI JOIN (SELECT trace, seq, chunk_id FROM {name}_rp SEMI JOIN {name}_r USING (trace, seq, subset_id)) c USING (trace, seq, chunk_id)"),
        *greedy(f"{name}_g", f"{name}_cp", cap, "any_value(chunk_num)"),
        _cte(name, f"""SELECT trace, seq, kind, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY first, own))::INT AS load_rank FROM (
        SELECT trace, seq, 'recipe' AS kind, subset_id, 0 AS first, load_rank AS own FROM {name}_r UNION ALL SELECT trace, seq, 'container', subset_id, 1, load_rank FROM {name}_g) QUALIFY load_rank <= {cap}""")]


def adaptive(name: str, per: str, start: str, cap: int, cache: int) -> list[str]:
    """The credit recurrence over ``per (trace, seq, n_selected, n_candidates)``, from ``start (i, spent, met)``."""
    value = f"CASE WHEN p.n_selected <= {cap} OR p.n_candidates * (a.i + 1) < a.met + p.n_candidates THEN {cap} ELSE least({cache}, (a.i + 1) * {cap} - a.spent) END"
    return [
        _cte(f"{name}_n", f"SELECT *, row_number() OVER (PARTITION BY trace ORDER BY seq) AS rn FROM {per}"),
        f"""{name} AS (SELECT ''::VARCHAR AS trace, 0::BIGINT AS seq, 0::BIGINT AS rn, i::BIGINT AS i, spent::BIGINT AS spent, met::BIGINT AS met, 0::BIGINT AS cap FROM ({start})
        UNION ALL SELECT p.trace, p.seq, p.rn, a.i + 1, a.spent + least(p.n_selected, greatest({value}, 1)), a.met + p.n_candidates, {value} FROM {name} a JOIN {name}_n p ON p.rn = a.rn + 1)"""]


def _union(prefix: str, tag: str, n: int, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM {prefix}{tag}{e}" for e in range(n))


def epochs(tag: str, versions: int, kind: str = "container", policy: str = "sort", cap: int = 1, flush: bool = True, ratio: float = 0.5, cache: int = 16, adapt: bool = False, bits: int = 3, bound: int = 1000, source: str = "windowed") -> list[str]:
    """Table expressions of a whole run over ``source``, the windows of one trace: ``rows<tag>`` and ``loads<tag>`` at their end."""
    out = []
    for e in range(versions):
        w, k = f"w{tag}{e}", f"{tag}{e}"
        out.append(_cte(w, f"SELECT * FROM {source} WHERE version = {e}"))
        out.append(_cte(f"ids{k}", f"SELECT DISTINCT trace, seq, chunk_id FROM {w}"))
        if e == 0:
            out.append(_cte(f"sel{k}", NO_LOADS))
            out.append(_cte(f"found{k}", "SELECT ''::VARCHAR AS trace, 0::BIGINT AS seq, ''::VARCHAR AS chunk_id, 0::BIGINT AS location WHERE false"))
            if adapt:
                out.append(_cte(f"carry{k}", f"SELECT count(*) AS i, 0 AS spent, 0 AS met FROM (SELECT DISTINCT seq FROM {w})"))
        else:
            out += _selected(tag, e, kind, policy, cap, ratio, cache, adapt, bound)
            out.append(_cte(f"mem{k}", f"SELECT trace, kind, subset_id, chunk_id, min(location) AS location FROM ({_union('members', tag, e, '*')}) GROUP BY ALL"))
            if flush:
                out.append(_cte(f"found{k}", f"SELECT trace, seq, chunk_id, arg_min(location, load_rank) AS location FROM sel{k} JOIN mem{k} USING (trace, kind, subset_id) JOIN ids{k} USING (trace, seq, chunk_id) GROUP BY ALL"))
            else:
                out.append(_cte(f"first{k}", f"SELECT trace, chunk_id, min({{'seq': seq, 'r': load_rank, 'location': location}}) AS f FROM ({_union('sel', tag, e + 1, '*')}) JOIN mem{k} USING (trace, kind, subset_id) GROUP BY ALL"))
                out.append(_cte(f"found{k}", f"SELECT trace, seq, chunk_id, f.location AS location FROM ids{k} JOIN first{k} USING (trace, chunk_id) WHERE f.seq <= seq"))
        out.append(_cte(f"flag{k}", f"SELECT w.*, f.location FROM {w} w LEFT JOIN found{k} f USING (trace, seq, chunk_id)"))
        base = f"(SELECT coalesce(max(container_id) + 1, 0) FROM ({_union('new', tag, e, 'container_id')}))" if e else "0"
        stored = f"(SELECT count(*) FROM ({_union('new', tag, e, 'container_id')}))" if e else "0"
        out.append(_cte(f"new{k}", f"SELECT * EXCLUDE (location), {stored} + n AS ord, {base} + n // 256 AS container_id FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY seq, win_pos) - 1 AS n FROM flag{k} WHERE location IS NULL)"))
        out.append(_cte(f"out{k}", f"SELECT trace, version, pos, seq, win_pos, chunk_id, true AS is_dup, location, NULL::BIGINT AS ord FROM flag{k} WHERE location IS NOT NULL UNION ALL SELECT trace, version, pos, seq, win_pos, chunk_id, false, container_id, ord FROM new{k}"))
        own = f"SELECT trace, 'container' AS kind, container_id AS subset_id, chunk_id, container_id AS location, seq FROM new{k}"
        if kind == "container":
            out.append(_cte(f"members{k}", own))
            out.append(_cte(f"hooks{k}", f"SELECT trace, chunk_id, 'container' AS kind, container_id AS subset_id, min(ord) AS ord FROM new{k} WHERE (ord + 1) % 9 = 0 GROUP BY ALL"))
            continue
        first = f"(SELECT coalesce(max(recipe_id) + 1, 0) FROM ({_union('rec', tag, e, 'recipe_id')}))" if e else "0"
        if kind == "recipe":
            seen = f"(SELECT count(*) FROM ({_union('rec', tag, e, 'recipe_id')}))" if e else "0"
            out.append(_cte(f"rec{k}", f"SELECT * EXCLUDE (n), {seen} + n AS gpos, {first} + n // 256 AS recipe_id FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY seq, win_pos) - 1 AS n FROM out{k})"))
            out.append(_cte(f"hooks{k}", f"SELECT trace, chunk_id, 'recipe' AS kind, recipe_id AS subset_id, min(gpos) AS ord FROM rec{k} WHERE (gpos + 1) % 9 = 0 GROUP BY ALL"))
            out.append(_cte(f"members{k}", f"SELECT trace, 'recipe' AS kind, recipe_id AS subset_id, chunk_id, location, seq FROM rec{k}"))
        else:
            out.append(_cte(f"segs{k}", f"SELECT trace, seq, coalesce(sum(n) OVER (PARTITION BY trace ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM (SELECT trace, seq, max(win_pos // 64) + 1 AS n FROM out{k} GROUP BY ALL)"))
            out.append(_cte(f"rec{k}", f"SELECT o.*, {first} + b + win_pos // 64 AS recipe_id, {FP} & {(1 << bits) - 1} IN (0, {(1 << bits) - 1}) AS hook, coalesce((ord + 1) % 9 = 0, false) AS feature FROM out{k} o JOIN segs{k} USING (trace, seq)"))
            out.append(_cte(f"members{k}", f"{own} UNION ALL SELECT trace, 'recipe', recipe_id, chunk_id, location, seq FROM rec{k}"))
            out.append(_cte(f"hooks{k}", " UNION ALL ".join(f"SELECT trace, {e} AS version, chunk_id, '{role}' AS role, {subset}::BIGINT AS subset_id FROM rec{k} WHERE {where}" for role, subset, where in (
                ("recipe_ptr", "recipe_id", "NOT is_dup AND feature"), ("cnr_ptr", "location", "NOT is_dup AND feature"), ("cnr_hook", "location", "NOT is_dup AND hook"), ("recipe_hook", "recipe_id", "hook")))))
    out.append(_cte(f"rows{tag}", _union("out", tag, versions, "*")))
    out.append(_cte(f"loads{tag}", " UNION ALL ".join(f"SELECT *, {e}::INT AS version FROM sel{tag}{e}" for e in range(versions))))
    return out


def strict(name: str, policy: str, cap: int) -> str:
    """A run over ``windowed`` that walks the windows of one trace: ``name (step, fp, ord, stored, loads)``; a step's row without ``fp`` is its report.

    Each step hands on all stored chunks; a container is searched once a chunk stands behind it.
    """
    order = "score DESC, subset_id" if policy == "sort" else "first, subset_id"
    load = "row_number() OVER (ORDER BY r)" if policy == "sort" else "row_number() OVER (ORDER BY subset_id)"
    return f"""{name} AS (SELECT 0::BIGINT AS step, NULL::BIGINT AS fp, NULL::BIGINT AS ord, 0::BIGINT AS stored, 0::BIGINT AS loads
        UNION ALL SELECT * FROM (WITH cur AS (SELECT max(step) + 1 AS step FROM {name}), old AS (SELECT fp, ord FROM {name} WHERE fp IS NOT NULL), top AS (SELECT coalesce(max(ord), -1) AS m FROM old),
        w AS (SELECT {FP} AS fp, win_pos FROM windowed, cur WHERE seq = cur.step),
        seen AS (SELECT fp, ord, ord // 256 AS subset_id FROM old, top WHERE ord // 256 < m // 256),
        hk AS (SELECT fp, subset_id, min(ord) AS ord FROM seen WHERE (ord + 1) % 9 = 0 GROUP BY ALL),
        hits AS (SELECT fp, count(*) AS cnt, min(win_pos) AS first_pos FROM w GROUP BY ALL),
        cand AS (SELECT subset_id, sum(cnt) AS score, min({{'first_pos': first_pos, 'ord': ord}}) AS first FROM hits JOIN hk USING (fp) GROUP BY ALL),
        pick AS (SELECT subset_id, {load} AS load_rank FROM (SELECT subset_id, row_number() OVER (ORDER BY {order}) AS r FROM cand) WHERE r <= {cap}),
        fresh AS (SELECT fp, win_pos FROM w ANTI JOIN (SELECT fp FROM seen JOIN pick USING (subset_id)) f USING (fp)),
        n AS (SELECT (SELECT count(*) FROM fresh) AS stored, (SELECT count(*) FROM pick) AS loads)
        SELECT step, fp, ord, 0, 0 FROM old, cur WHERE EXISTS (FROM w)
        UNION ALL SELECT step, fp, m + row_number() OVER (ORDER BY win_pos), 0, 0 FROM fresh, top, cur
        UNION ALL SELECT step, NULL, NULL, stored, loads FROM n, cur WHERE EXISTS (FROM w)))"""


def _selected(tag: str, e: int, kind: str, policy: str, cap: int, ratio: float, cache: int, adapt: bool, bound: int) -> list[str]:
    k, w = f"{tag}{e}", f"w{tag}{e}"
    expired = f" WHERE role NOT LIKE 'recipe%' OR version >= {e - bound}" if kind == "hybrid" else ""
    out = [_cte(f"hk{k}", f"SELECT * FROM ({_union('hooks', tag, e, '*')}){expired}")]
    if kind == "hybrid":
        out.append(_cte(f"pairs{k}", f"SELECT trace, seq, chunk_id, role, subset_id FROM ids{k} JOIN hk{k} USING (trace, chunk_id)"))
        out += hybrid(f"any{k}", f"pairs{k}", -(-int(cap * ratio * 1000) // 1000))
        if not adapt:
            return [*out, _cte(f"sel{k}", f"SELECT * FROM any{k} WHERE load_rank <= {cap}")]
        out.append(_cte(f"per{k}", f"""SELECT trace, seq, coalesce(s, 0) AS n_selected, coalesce(c, 0) AS n_candidates FROM (SELECT DISTINCT trace, seq FROM {w})
            LEFT JOIN (SELECT trace, seq, count(*) AS s FROM any{k} GROUP BY ALL) USING (trace, seq) LEFT JOIN (SELECT trace, seq, count(DISTINCT subset_id) AS c FROM pairs{k} WHERE role = 'cnr_ptr' GROUP BY ALL) USING (trace, seq)"""))
        out += adaptive(f"ad{k}", f"per{k}", f"SELECT * FROM carry{tag}{e - 1}", cap, cache)
        out.append(_cte(f"carry{k}", f"SELECT max(i) AS i, max(spent) AS spent, max(met) AS met FROM ad{k}"))
        return [*out, _cte(f"sel{k}", f"SELECT a.* FROM any{k} a JOIN ad{k} d USING (trace, seq) WHERE load_rank <= greatest(d.cap, 1)")]
    out.append(_cte(f"hits{k}", f"SELECT trace, seq, chunk_id, count(*) AS cnt, min(win_pos) AS first_pos FROM {w} SEMI JOIN hk{k} USING (trace, chunk_id) GROUP BY ALL"))
    out.append(_cte(f"pairs{k}", f"SELECT h.*, subset_id, ord FROM hits{k} h JOIN hk{k} USING (trace, chunk_id)"))
    out.append(_cte(f"cand{k}", f"SELECT trace, seq, subset_id, sum(cnt)::BIGINT AS score, min({{'first_pos': first_pos, 'ord': ord}}) AS first FROM pairs{k} GROUP BY ALL"))
    if policy == "sort":
        out.append(_cte(f"pick{k}", f"SELECT trace, seq, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY score DESC, subset_id))::INT AS load_rank FROM cand{k} QUALIFY load_rank <= {cap}"))
    elif policy == "fifo":
        out.append(_cte(f"pick{k}", f"SELECT trace, seq, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY subset_id))::INT AS load_rank FROM (SELECT * FROM cand{k} QUALIFY row_number() OVER (PARTITION BY trace, seq ORDER BY first, subset_id) <= {cap})"))
    elif policy == "sparse":
        out += greedy(f"pick{k}", f"pairs{k}", cap)
    else:
        out.append(_cte(f"made{k}", f"SELECT trace, subset_id, max(seq) AS made FROM ({_union('members', tag, e, 'trace, subset_id, seq')}) GROUP BY ALL"))
        out += level(f"pick{k}", f"cand{k}", f"made{k}", cap)
    return [*out, _cte(f"sel{k}", f"SELECT trace, seq, '{kind}' AS kind, subset_id, load_rank FROM pick{k}")]


_SO_FAR = "OVER (PARTITION BY trace ORDER BY version)"


def report(tag: str, engine: str, policy: str | None, cap: int, cache: int, **hybrid_columns) -> str:
    """The report of a run: 22 columns, 28 for a hybrid one, beside trace and version."""
    sums = ["windows", "cnr_loads", "recipe_loads", "loads", "total", "stored"]
    running = ", ".join(f"(sum({c}) {_SO_FAR})::BIGINT AS all_{c}" for c in sums)
    hooks = hybrid_columns.pop("hooks")
    named = "".join(f", {v} AS {n}" for n, v in hybrid_columns.items())
    said = f"'{policy}' AS policy, " if policy else "all_cnr + stored_recipe AS stored_hooks, index_size, stored_recipe AS stored_recipe_hooks, all_cnr AS cnr_hooks, "
    return f"""SELECT trace, version, '{engine}' AS engine, {said}{cache}::INT AS cache_size, 256::INT AS container_size, 256::INT AS window_size, {cap}::INT AS io_cap{named}, {', '.join(sums)}, {', '.join('all_' + c for c in sums)},
     coalesce(round(all_total::DOUBLE / nullif(all_recipe, 0), 6), 0.0) AS recipe_sample_ratio, coalesce(round(all_stored::DOUBLE / nullif(all_cnr, 0), 6), 0.0) AS cnr_sample_ratio, {RATE.format('total', 'stored')} AS dedup_rate, {RATE.format('all_total', 'all_stored')} AS all_dedup_rate
     FROM (SELECT *, {running} FROM (SELECT trace, version, total, stored, windows, coalesce(c, 0) AS cnr_loads, coalesce(r, 0) AS recipe_loads, coalesce(c, 0) + coalesce(r, 0) AS loads
      FROM (SELECT trace, version, count(*) AS total, count(*) FILTER (NOT is_dup) AS stored, count(DISTINCT seq) AS windows FROM rows{tag} GROUP BY ALL)
      LEFT JOIN (SELECT trace, version, count(*) FILTER (kind = 'container') AS c, count(*) FILTER (kind = 'recipe') AS r FROM loads{tag} GROUP BY ALL) USING (trace, version))) JOIN ({hooks}) USING (trace, version)"""


def hook_sums(tag: str, versions: int, kind: str, bound: int = 1000) -> str:
    """``trace, version`` with hooks so far by kind, indexed ids, and recipe hooks of the last ``bound + 1`` versions."""
    recipe, cnr = ("role = 'recipe_hook'", "role LIKE 'cnr%'") if kind == "hybrid" else ("kind = 'recipe'", "kind = 'container'")
    every = " UNION ALL ".join(f"SELECT trace, {e}::INT AS version, chunk_id, ({recipe})::INT AS r, ({cnr})::INT AS c FROM hooks{tag}{e}" for e in range(versions))
    return f"""SELECT trace, version, (sum(r) {_SO_FAR})::BIGINT AS all_recipe, (sum(c) {_SO_FAR})::BIGINT AS all_cnr, (sum(f) {_SO_FAR})::BIGINT AS index_size,
     (sum(r) OVER (PARTITION BY trace ORDER BY version RANGE BETWEEN {bound} PRECEDING AND CURRENT ROW))::BIGINT AS stored_recipe
     FROM (SELECT trace, version, sum(r) AS r, sum(c) AS c, sum(first) AS f FROM (SELECT *, (row_number() OVER (PARTITION BY trace, chunk_id ORDER BY version) = 1)::INT AS first FROM ({every})) GROUP BY ALL)"""
