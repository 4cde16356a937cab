"""DuckDB SQL of the queries, built from shared table expressions. Windows and containers of 256."""

from __future__ import annotations

from fathomline.plans import epoch_sql as P


def _id(content: str) -> str:
    return rf"regexp_replace(substr(md5({content}),1,12),'(..)(..)(..)(..)(..)(..)','\1:\2:\3:\4:\5:\6')"


def _trace(name: str, version: str, content: str, order: str, source: str) -> str:
    return f"SELECT '{name}' AS trace, ({version})::INT AS version, row_number() OVER (PARTITION BY {version} ORDER BY {order}) - 1 AS pos, {_id(content)} AS chunk_id FROM {source}"


SNAPSHOT = f"SELECT 'snapshot' AS trace, v::INT AS version, o_orderkey AS pos, {_id("concat(o_orderkey, ':', (v + o_orderkey % 5) // 5)")} AS chunk_id FROM orders, range(5) AS t(v)"
LINEITEM = _trace("lineitem", "year(l_shipdate) - 1995", "l_partkey::VARCHAR", "l_orderkey, l_linenumber, l_partkey", "lineitem")
DOC_LINES = _trace("doc_lines", "doc_id % 5", "line", "doc_id, line_no", "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)")
EVENTS = _trace("events", "date_diff('day', DATE '2024-01-01', ts::DATE) // 6", "concat(user_id, ':', event_type)", "ts, event_id", "events")

_SNAP = f"chunks AS MATERIALIZED ({SNAPSHOT})"
_ALL = f"chunks AS MATERIALIZED ({SNAPSHOT} UNION ALL {LINEITEM} UNION ALL {DOC_LINES} UNION ALL {EVENTS})"
_WINDOWED = """
bases AS (SELECT trace, version, coalesce(sum(w) OVER (PARTITION BY trace ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
          FROM (SELECT trace, version, ceil(count(*) / 256.0)::BIGINT AS w FROM chunks GROUP BY ALL)),
windowed AS MATERIALIZED (SELECT c.*, pos // 256 AS win, (pos % 256)::INT AS win_pos, base + pos // 256 + 1 AS seq FROM chunks c JOIN bases USING (trace, version)),
flagged AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace, chunk_id ORDER BY version, pos) > 1 AS is_dup FROM windowed)"""
_PACKED = _WINDOWED + """,
packed AS MATERIALIZED (SELECT trace, version, pos, seq, win_pos, chunk_id, ord, ord // 256 AS container_id, (ord % 256)::INT AS slot
           FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY seq, win_pos) - 1 AS ord FROM flagged WHERE NOT is_dup))"""
_LOCATED = _PACKED + """,
located AS MATERIALIZED (SELECT f.*, p.container_id AS location FROM flagged f JOIN packed p USING (trace, chunk_id)),
recipes AS MATERIALIZED (SELECT *, gpos // 256 AS recipe_id, (gpos % 256)::INT AS slot FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY seq, win_pos) - 1 AS gpos FROM located))"""
_HOOKS = _LOCATED + """,
hooks AS MATERIALIZED (SELECT trace, chunk_id, 'container' AS kind, container_id AS subset_id, min(ord) AS ord, min(version) AS version FROM packed WHERE (ord + 1) % 9 = 0 GROUP BY ALL),
old_hooks AS MATERIALIZED (SELECT * FROM hooks WHERE version < 4),
last AS MATERIALIZED (SELECT * FROM windowed WHERE version = 4),
hits AS MATERIALIZED (SELECT trace, seq, chunk_id, count(*) AS cnt, min(win_pos) AS first_pos FROM last WHERE (trace, chunk_id) IN (SELECT (trace, chunk_id) FROM old_hooks) GROUP BY ALL),
cand AS MATERIALIZED (SELECT trace, seq, kind, subset_id, sum(cnt)::BIGINT AS score, count(DISTINCT chunk_id) AS n_hooks, min({'first_pos': first_pos, 'ord': ord}) AS first FROM hits JOIN old_hooks USING (trace, chunk_id) GROUP BY ALL),
sorted AS MATERIALIZED (SELECT trace, seq, kind, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY score DESC, subset_id))::INT AS load_rank FROM cand)"""
_FP = "('0x' || replace(chunk_id, ':', ''))::BIGINT"
_ROLES = _LOCATED + f""",
segmented AS MATERIALIZED (SELECT l.*, p.ord, l.win_pos // 64 AS seg FROM located l LEFT JOIN packed p USING (trace, version, pos)),
seg_base AS (SELECT trace, seq, coalesce(sum(n) OVER (PARTITION BY trace ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT trace, seq, max(seg) + 1 AS n FROM segmented GROUP BY ALL)),
rows_ AS MATERIALIZED (SELECT s.trace, s.version, s.seq, s.chunk_id, s.is_dup, s.location, base + seg AS recipe_id, {_FP.replace('chunk_id', 's.chunk_id')} AS fp, (s.ord + 1) % 9 = 0 AS feature FROM segmented s JOIN seg_base USING (trace, seq)),
roles AS MATERIALIZED (SELECT trace, version, chunk_id, 'recipe_ptr' AS role, recipe_id AS subset_id FROM rows_ WHERE NOT is_dup AND feature
 UNION ALL SELECT trace, version, chunk_id, 'cnr_ptr', location FROM rows_ WHERE NOT is_dup AND feature
 UNION ALL SELECT trace, version, chunk_id, 'cnr_hook', location FROM rows_ WHERE NOT is_dup AND fp & 7 IN (0, 7)
 UNION ALL SELECT trace, version, chunk_id, 'recipe_hook', recipe_id FROM rows_ WHERE fp & 7 IN (0, 7))"""
_RATE = "round(total::DOUBLE / nullif(stored, 0), 6)"


def _snap(ctes: str, body: str) -> str:
    return f"WITH {_SNAP}, {ctes.lstrip(', ')} {body}" if ctes else f"WITH {_SNAP} {body}"


def _all(ctes: str, body: str) -> str:
    return f"WITH {_ALL}, {ctes} {body}" if ctes else f"WITH {_ALL} {body}"


_SO_FAR = "OVER (PARTITION BY trace ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_VERSION = f"""SELECT *, {_RATE} AS dedup_rate, round(all_total::DOUBLE / nullif(all_stored, 0), 6) AS all_dedup_rate FROM (
 SELECT *, (sum(total) {_SO_FAR})::BIGINT AS all_total, (sum(stored) {_SO_FAR})::BIGINT AS all_stored, (sum(windows) {_SO_FAR})::BIGINT AS all_windows FROM (
 SELECT trace, version, count(*) AS total, count(*) FILTER (NOT is_dup) AS stored, count(DISTINCT seq) AS windows FROM flagged GROUP BY ALL))"""


def _segments(seg: str, where: str = "true") -> str:
    return _snap(_WINDOWED, f"SELECT trace, version, seq, seg, count(*) AS n, min(pos) AS first_pos FROM (SELECT *, ({seg})::BIGINT AS seg FROM windowed) WHERE {where} GROUP BY ALL")


def _running(boundary: str) -> str:
    return f"sum(CASE WHEN win_pos > 0 AND {boundary} THEN 1 ELSE 0 END) OVER (PARTITION BY trace, seq ORDER BY win_pos)"


def _sweep(cap: int, cfg: int) -> str:
    return f"""SELECT {cfg}::INT AS cfg_id, {cap}::INT AS io_cap, l.trace, l.version, count(*) AS total, count(*) FILTER (f.chunk_id IS NULL) AS stored,
 (SELECT count(*) FROM sorted WHERE load_rank <= {cap}) AS loads
 FROM last l LEFT JOIN (SELECT DISTINCT s.trace, s.seq, p.chunk_id FROM sorted s JOIN packed p ON p.trace = s.trace AND p.container_id = s.subset_id WHERE s.load_rank <= {cap} AND p.version < 4) f USING (trace, seq, chunk_id)
 GROUP BY ALL"""




def _step(location: str | None) -> str:
    """The last version against the loads of its windows; without ``location``, against those of all windows so far."""
    ids = ", held AS MATERIALIZED (SELECT p.trace, p.container_id, p.chunk_id FROM packed p SEMI JOIN last USING (trace, chunk_id) WHERE p.version < 4), loads AS MATERIALIZED (SELECT trace, seq, subset_id AS container_id, load_rank FROM sorted WHERE load_rank <= 4)"
    if location:
        found = f", found AS MATERIALIZED (SELECT i.trace, i.seq, i.chunk_id, {location} FROM (SELECT DISTINCT trace, seq, chunk_id FROM last) i JOIN held USING (trace, chunk_id) JOIN loads USING (trace, seq, container_id) GROUP BY ALL)"
    else:
        found = """, firsts AS MATERIALIZED (SELECT trace, chunk_id, min({'seq': seq, 'r': load_rank, 'location': container_id}) AS f FROM held JOIN loads USING (trace, container_id) GROUP BY ALL),
        found AS MATERIALIZED (SELECT DISTINCT l.trace, l.seq, l.chunk_id, f.location AS location FROM last l JOIN firsts USING (trace, chunk_id) WHERE f.seq <= l.seq)"""
    return _snap(_HOOKS, f"{ids}{found} SELECT l.trace, l.version, l.pos, l.seq, l.chunk_id, f.location IS NOT NULL AS is_dup, f.location FROM last l LEFT JOIN found f USING (trace, seq, chunk_id)")


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(chunk_id, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (((h - h % 256) + xor((h % 256)::BIGINT, b::BIGINT))::HUGEINT * 435 + (((h - h % 256) + xor((h % 256)::BIGINT, b::BIGINT))::HUGEINT % 16777216) * 1099511627776) % 18446744073709551616)"

SQL: dict[str, str] = {
    "version_dedup_report": _all(_WINDOWED, _VERSION),
    "window_dedup_report": _all(_WINDOWED, f"SELECT *, {_RATE} AS rate FROM (SELECT trace, version, seq, count(*) AS total, count(*) FILTER (NOT is_dup) AS stored FROM flagged GROUP BY ALL)"),
    "unique_chunks": _all("", "SELECT trace, chunk_id, f.version AS version, f.pos AS pos, n FROM (SELECT trace, chunk_id, min({'version': version, 'pos': pos}) AS f, count(*) AS n FROM chunks GROUP BY ALL)"),
    "windows_legacy": _snap(
        "bases AS (SELECT trace, version, coalesce(sum(w) OVER (PARTITION BY trace ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT trace, version, ceil(count(*) / 258.0)::BIGINT AS w FROM chunks GROUP BY ALL))",
        "SELECT trace, version, pos, base + pos // 258 + 1 AS seq, pos // 258 AS win, (pos % 258 - 1)::INT AS win_pos FROM chunks JOIN bases USING (trace, version) WHERE pos % 258 BETWEEN 1 AND 256"),
    "packed_containers": _snap(_PACKED, "SELECT trace, container_id, slot, chunk_id, version, seq, ord FROM packed"),
    "seal_status": _snap(_PACKED, "SELECT trace, container_id, lead(first_seq) OVER (PARTITION BY trace ORDER BY container_id) AS sealed_seq FROM (SELECT trace, container_id, min(seq) AS first_seq FROM packed GROUP BY ALL)"),
    "recipes_exact": _snap(_LOCATED, "SELECT trace, recipe_id, slot, chunk_id, location, version, seq FROM recipes"),
    "segment_recipes": _snap(_WINDOWED, """, segs AS (SELECT *, win_pos // 100 AS seg FROM windowed), base2 AS (SELECT trace, seq, coalesce(sum(n) OVER (PARTITION BY trace ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM (SELECT trace, seq, max(seg) + 1 AS n FROM segs GROUP BY ALL))
        SELECT trace, version, pos, b + seg AS recipe_id, (row_number() OVER (PARTITION BY trace, seq, seg ORDER BY win_pos) - 1)::INT AS slot FROM segs JOIN base2 USING (trace, seq)"""),
    "subset_meta": _snap(_LOCATED, "SELECT trace, 'container' AS kind, container_id AS subset_id, count(*) AS chunk_num, max(seq) AS seq, max(version) AS version FROM packed GROUP BY ALL UNION ALL SELECT trace, 'recipe', recipe_id, count(*), max(seq), max(version) FROM recipes GROUP BY ALL"),
    "segments_fixed": _segments("win_pos // 100"),
    "segments_fixed_dropped": _segments("win_pos // 100", "win_pos = 0 OR win_pos % 100 <> 0"),
    "segments_content": _segments(_running(f"{_FP} & 15 = 15")),
    "segments_pattern": _segments(_running(f"{_FP} & 15 = 3")),
    "sample_position": _snap(_PACKED, "SELECT trace, chunk_id, ord FROM packed WHERE (ord + 1) % 9 = 0"),
    "sample_chunk_id": _all("", "SELECT DISTINCT trace, chunk_id FROM chunks WHERE (('0x' || right(chunk_id, 2))::BIGINT + 1) % 8 = 0"),
    "sample_bits": _snap("", f"SELECT trace, chunk_id, fp, fp & 7 = 7 AS low_ones, fp & 7 = 0 AS low_zeros, fp >> 45 = 7 AS high_ones, fp >> 45 = 0 AS high_zeros, fp & 3 = 3 OR fp & 15 = 0 AS hook, false AS never FROM (SELECT DISTINCT trace, chunk_id, {_FP} AS fp FROM chunks)"),
    "sample_min_hash": _snap(_WINDOWED, "SELECT trace, seq, chunk_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY trace, seq ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT trace, seq, chunk_id FROM flagged WHERE NOT is_dup)) WHERE rank <= 5"),
    "hook_index": _snap(_HOOKS, "SELECT trace, chunk_id, kind, subset_id, ord, version FROM hooks"),
    "hook_lookup": _snap(_HOOKS, "SELECT trace, chunk_id, subset_id, ord FROM (SELECT DISTINCT trace, chunk_id FROM last) JOIN old_hooks USING (trace, chunk_id)"),
    "hook_stats": _snap(_HOOKS, "SELECT trace, count(DISTINCT chunk_id) AS fingerprints, count(*) AS pointers, (SELECT count(*) FROM chunks) // nullif(count(DISTINCT chunk_id), 0) AS sample_ratio, 0.0::DOUBLE AS recipe_ratio, (SELECT count(*) FROM packed)::DOUBLE / count(*) AS container_ratio FROM hooks GROUP BY trace"),
    "hooks_version_bound": _snap(_HOOKS, "SELECT trace, chunk_id, subset_id, version FROM hooks WHERE version >= 2"),
    "hook_pointer_counts": _snap(_HOOKS, "SELECT trace, version, pointers, (sum(pointers) OVER (PARTITION BY trace ORDER BY version RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS live_pointers FROM (SELECT trace, version, count(*) AS pointers FROM hooks GROUP BY ALL)"),
    "hybrid_hooks": _snap(_ROLES, "SELECT trace, version, chunk_id, role, subset_id FROM roles"),
    "hook_hits": _snap(_HOOKS, "SELECT trace, seq, chunk_id, cnt, first_pos FROM hits"),
    "hit_counts": _snap(_HOOKS, "SELECT trace, version, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM old_hooks)) AS hook_hits, count(*) FILTER (is_dup) AS cache_hits, count(*) FILTER (NOT is_dup) AS cache_misses FROM flagged GROUP BY ALL"),
    "candidate_scores": _snap(_HOOKS, "SELECT trace, seq, subset_id, score, n_hooks, first.first_pos AS first_pos, first.ord AS first_ord FROM cand"),
    "select_sort": _snap(_HOOKS, "SELECT * FROM sorted WHERE load_rank <= 4"),
    "select_fifo": _snap(_HOOKS, "SELECT trace, seq, kind, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY subset_id))::INT AS load_rank FROM (SELECT *, row_number() OVER (PARTITION BY trace, seq ORDER BY first, subset_id) AS met FROM cand) WHERE met <= 2"),
    "select_all": _snap(_HOOKS, "SELECT trace, seq, kind, subset_id, (row_number() OVER (PARTITION BY trace, seq ORDER BY subset_id))::INT AS load_rank FROM cand"),
    "dedup_step_sort": _step("arg_min(container_id, load_rank) AS location"),
    "dedup_step_no_flush": _step(None),
    "restore_cost": _snap(_LOCATED, "SELECT trace, version, count(*) AS n_windows, sum(n)::BIGINT AS locations, round(avg(n), 6) AS mean_locations FROM (SELECT trace, version, seq, count(DISTINCT location) AS n FROM located GROUP BY ALL) GROUP BY ALL"),
    "index_breadth": _snap(_LOCATED, """, old AS (SELECT * FROM recipes WHERE version < 4), rh AS (SELECT trace, chunk_id, recipe_id, min(gpos) AS ord FROM old WHERE (gpos + 1) % 9 = 0 GROUP BY ALL),
        h AS (SELECT trace, seq, chunk_id, count(*) AS cnt FROM windowed WHERE version = 4 GROUP BY ALL), c AS (SELECT trace, seq, recipe_id, sum(cnt) AS score FROM h JOIN rh USING (trace, chunk_id) GROUP BY ALL),
        s AS (SELECT trace, seq, recipe_id FROM (SELECT *, row_number() OVER (PARTITION BY trace, seq ORDER BY score DESC, recipe_id) AS r FROM c) WHERE r <= 4)
        SELECT s.trace, s.seq, count(DISTINCT location) AS breadth FROM s JOIN old o ON o.trace = s.trace AND o.recipe_id = s.recipe_id GROUP BY ALL"""),
    "recipe_fragmentation": _snap(_LOCATED, "SELECT trace, recipe_id, count(*) AS chunks, count(DISTINCT location) AS containers FROM recipes GROUP BY ALL"),
    "coverage_curve": _snap(_LOCATED, """, target AS (SELECT DISTINCT trace, chunk_id FROM windowed WHERE version = 4 AND win = 0),
        subsets AS (SELECT trace, 'recipe' AS kind, recipe_id AS subset_id, chunk_id, version FROM recipes UNION ALL SELECT trace, 'container', container_id, chunk_id, version FROM packed),
        mem AS (SELECT s.* FROM subsets s JOIN target USING (trace, chunk_id) WHERE version < 4),
        top AS (SELECT *, row_number() OVER (PARTITION BY trace, kind ORDER BY hits DESC, subset_id) AS rank FROM (SELECT trace, kind, subset_id, count(*) AS hits FROM mem GROUP BY ALL) QUALIFY rank <= 10),
        firsts AS (SELECT trace, kind, chunk_id, min(rank) AS rank FROM mem JOIN top USING (trace, kind, subset_id) GROUP BY ALL)
        SELECT trace, kind, rank::INT AS rank, subset_id, hits, (SELECT count(*) FROM firsts f WHERE f.trace = t.trace AND f.kind = t.kind AND f.rank <= t.rank) AS covered FROM top t"""),
    "fnv_partition": _snap("", f"SELECT trace, chunk_id, ({_FNV} % 65)::INT AS part FROM (SELECT DISTINCT trace, chunk_id FROM chunks)"),
    "partitioned_containers": _snap("", f""", firsts AS (SELECT trace, chunk_id, min({{'version': version, 'pos': pos}}) AS f FROM chunks GROUP BY ALL), parted AS (SELECT trace, chunk_id, f.version AS version, f.pos AS pos, ({_FNV} % 65)::INT AS part FROM firsts)
        SELECT trace, part, k // 256 AS bf_no, (k % 256)::INT AS slot, chunk_id, version, pos FROM (SELECT *, row_number() OVER (PARTITION BY trace, part ORDER BY version, pos) - 1 AS k FROM parted)"""),
    "io_cap_sweep": _snap(_HOOKS, " UNION ALL ".join(_sweep(c, i) for i, c in enumerate((1, 2, 4, 6, 20)))),
    "recipe_roundtrip": _snap(_LOCATED, "SELECT trace, recipe_id, slot, chunk_id, location FROM recipes"),
    "trace_roundtrip": _snap("", "SELECT trace, version, pos, chunk_id FROM chunks"),
    "stream_exact_dedup": f"SELECT DISTINCT 'events' AS trace, {_id("concat(user_id, ':', event_type)")} AS chunk_id FROM events",
}


def _with(ctes: list[str], body: str, chunks: str = SNAPSHOT, shared: str = _WINDOWED) -> str:
    return f"WITH RECURSIVE chunks AS MATERIALIZED ({chunks}), {shared.lstrip()}, {', '.join(ctes)} {body}" if ctes else f"WITH chunks AS MATERIALIZED ({chunks}), {shared.lstrip()} {body}"


def _near(tag: str, engine: str = "near_exact", cap: int = 4, cache: int = 1024, kind: str = "container", policy: str = "sort", **how) -> str:
    named = {"cap_adaptive": "true", "hybrid_recipe_ratio": "0.5::DOUBLE", "cnr_sampling": "'random_for_cnr'"} if kind == "hybrid" else {}
    body = P.report(tag, engine, None if kind == "hybrid" else policy, cap, cache, hooks=P.hook_sums(tag, 5, kind), **named)
    return _with(P.epochs(tag, 5, kind, policy, cap, cache=cache, **how), body)


_ROLE_PAIRS = ["pairs AS MATERIALIZED (SELECT l.trace, l.seq, chunk_id, role, subset_id FROM (SELECT DISTINCT trace, seq, chunk_id FROM windowed WHERE version = 4) l JOIN (SELECT trace, chunk_id, role, subset_id FROM roles WHERE version < 4) USING (trace, chunk_id))"]


def _roles(ctes: list[str], body: str = "SELECT * FROM s") -> str:
    return _with([*_ROLE_PAIRS, *ctes], body, shared=_ROLES)


def _policy(ctes: list[str]) -> str:
    return _with(["pairs AS MATERIALIZED (SELECT trace, seq, chunk_id, kind, subset_id FROM hits JOIN old_hooks USING (trace, chunk_id))", *ctes], "SELECT trace, seq, 'container' AS kind, subset_id, load_rank FROM s", shared=_HOOKS)


def _compare() -> str:
    cost = "SELECT trace, version, round(avg(n), 6) AS mean_locations FROM (SELECT trace, version, seq, count(DISTINCT location) AS n FROM {0} GROUP BY ALL) GROUP BY ALL"
    ctes, parts = [], []
    for name, how in {"sort": {}, "fifo": {"policy": "fifo"}, "sparse": {"policy": "sparse"}, "level": {"policy": "level"}, "recipe": {"kind": "recipe"}, "hybrid": {"kind": "hybrid", "cap": 4}}.items():
        ctes += P.epochs(f"_{name}_", 5, **how)
        parts.append((name, f"rows_{name}_", f"(SELECT trace, version, count(*) AS loads FROM loads_{name}_ GROUP BY ALL)", cost.format(f"rows_{name}_")))
    parts.append(("exact", "located", "(SELECT 'x' AS trace, 0 AS version, 0 AS loads)", cost.format("located")))
    blooms = "(SELECT l.* EXCLUDE (location), {'part': part, 'bf': bf_no} AS location FROM located l JOIN store USING (trace, chunk_id))"
    parts.append(("bloom", "located", "(SELECT trace, version, count(*) FILTER (load) AS loads FROM loads1 GROUP BY ALL)", cost.format(blooms)))
    body = " UNION ALL ".join(f"""SELECT '{n}' AS strategy, trace, version, total, stored, coalesce(loads, 0)::BIGINT AS loads, {_RATE} AS dedup_rate, mean_locations
        FROM (SELECT trace, version, count(*) AS total, count(*) FILTER (NOT is_dup) AS stored FROM {rows} GROUP BY ALL) LEFT JOIN {loads} USING (trace, version) JOIN ({costs}) USING (trace, version)""" for n, rows, loads, costs in parts)
    return _with([_BLOOM.lstrip().removeprefix(","), *ctes], body, shared=_LOCATED)


_TOTAL = "SELECT trace, version, count(*) AS total, count(*) FILTER (NOT is_dup) AS stored, count(DISTINCT seq) AS windows, min(seq) AS first_seq, max(seq) AS last_seq FROM {0} GROUP BY ALL"


def _runs(runs: list[tuple[str, str, dict]], chunks: str) -> str:
    """Whole runs of a grid, a report for each: name of the run, trace, and how it runs; the settings that vary are columns."""
    ctes, parts = [P._cte(f"only_{t}", f"SELECT * FROM windowed WHERE trace = '{t}'") for t in dict.fromkeys(t for _, t, _ in runs)], []
    for tag, trace, how in runs:
        shown = how.pop("shown")
        ctes += P.epochs(f"_{tag}_", 5, source=f"only_{trace}", **how)
        parts.append(f"""SELECT {shown}, trace, version, windows, total, stored, coalesce(loads, 0)::BIGINT AS loads, {_RATE} AS dedup_rate FROM ({_TOTAL.format(f"rows_{tag}_")})
        LEFT JOIN (SELECT trace, version, count(*) AS loads FROM loads_{tag}_ GROUP BY ALL) USING (trace, version)""")
    return _with(ctes, " UNION ALL ".join(parts), chunks)


def _run_sweep() -> str:
    runs = [(f"{t}{i}", t, {"cap": c, "shown": f"{i}::INT AS cfg_id, {c}::INT AS io_cap"}) for t in ("snapshot", "doc_lines", "events") for i, c in enumerate((4, 6, 20))]
    return _runs(runs, f"{SNAPSHOT} UNION ALL {DOC_LINES} UNION ALL {EVENTS}")


def _bit_sweep() -> str:
    runs = [(f"b{i}", "snapshot", {"kind": "hybrid", "cap": 4, "bits": b, "bound": v, "shown": f"{i}::INT AS cfg_id, '{b},{b}' AS hook_bits, {v}::INT AS version_bound"}) for i, (b, v) in enumerate(((2, 1000), (3, 1000), (3, 0), (4, 1)))]
    return _runs(runs, SNAPSHOT)


def _strict(policy: str) -> str:
    of = "(SELECT version, seq, count(*) AS n FROM windowed GROUP BY ALL)"
    one = lambda i, c: f"""SELECT {i}::INT AS cfg_id, {c}::INT AS io_cap, 'snapshot' AS trace, version, count(*) AS windows, sum(n)::BIGINT AS total, sum(stored)::BIGINT AS stored, sum(loads)::BIGINT AS loads, round(sum(n)::DOUBLE / nullif(sum(stored), 0), 6) AS dedup_rate
        FROM walk{c} JOIN {of} ON seq = step WHERE fp IS NULL GROUP BY version"""  # noqa: E731
    return _with([P.strict("walk1", policy, 1), P.strict("walk4", policy, 4)], f"{one(0, 1)} UNION ALL {one(1, 4)}")


def _ingest_bounded() -> str:
    ctes = [P._cte(f"only_{t}", f"SELECT * FROM windowed WHERE trace = '{t}'") for t in ("snapshot", "doc_lines")]
    parts = []
    for t in ("snapshot", "doc_lines"):
        ctes += P.epochs(f"_{t}_", 5, "hybrid", cap=4, bound=0, source=f"only_{t}")
        parts.append(f"""SELECT trace, version, total, stored, first_seq, last_seq, coalesce(loads, 0)::BIGINT AS loads FROM ({_TOTAL.format(f"rows_{t}_")})
        LEFT JOIN (SELECT trace, version, count(*) AS loads FROM loads_{t}_ GROUP BY ALL) USING (trace, version)""")
    return _with(ctes, " UNION ALL ".join(parts), f"{SNAPSHOT} UNION ALL {DOC_LINES}")


def _bloom_hashes(k: int = 9, m: int = 3323) -> str:
    """Bits of every stored id: ``k`` chained 32-bit hashes of its 17 bytes, each seeded by the one before."""
    word = lambda i: " + ".join(f"ascii(substr(chunk_id, {i * 4 + j + 1}, 1)) * {256**j}" for j in range(4))
    out = [f"h0 AS MATERIALIZED (SELECT *, {0xBC9F1D34}::UBIGINT AS x0, {', '.join(f'({word(i)})::UBIGINT AS w{i}' for i in range(4))}, ascii(substr(chunk_id, 17, 1))::UBIGINT AS w4 FROM store_)"]
    mul, full = 0xC6A4A793, 1 << 32
    for j in range(1, k + 1):
        steps = [f"xor(x{j - 1}, {17 * mul % full}::UBIGINT) AS a{j}_0"]
        for i in range(4):
            steps += [f"((a{j}_{i} + w{i}) % {full} * {mul}) % {full} AS b{j}_{i}", f"xor(b{j}_{i}, b{j}_{i} >> 16) AS a{j}_{i + 1}"]
        steps += [f"((a{j}_4 + w4) % {full} * {mul}) % {full} AS b{j}_4", f"xor(b{j}_4, b{j}_4 >> 24) AS x{j}"]
        out.append(f"h{j} AS MATERIALIZED (SELECT *, {', '.join(steps)} FROM h{j - 1})")
    every = ", ".join(f"(x{j} % {m})::INT" for j in range(1, k + 1))
    out.append(f"store AS MATERIALIZED (SELECT trace, part, bf_no, slot, n, chunk_id, version, pos FROM store_)")
    out.append(f"bits AS MATERIALIZED (SELECT DISTINCT trace, part, bf_no, n, chunk_id, unnest([{every}]) AS bit FROM h{k})")
    return ", ".join(out)


#: The partitioned store, its filters, where they match, and the matches of each arriving chunk.
_BLOOM = f""",
firsts AS MATERIALIZED (SELECT trace, chunk_id, min({{'version': version, 'pos': pos}}) AS f FROM chunks GROUP BY ALL),
parts AS MATERIALIZED (SELECT count(*) // {256 * 64} + 1 AS parts FROM firsts),
store_ AS MATERIALIZED (SELECT trace, part, n // 256 AS bf_no, (n % 256)::INT AS slot, n, chunk_id, version, pos FROM (SELECT *, row_number() OVER (PARTITION BY trace, part ORDER BY version, pos) - 1 AS n
 FROM (SELECT trace, chunk_id, f.version AS version, f.pos AS pos, ({_FNV} % (SELECT parts FROM parts))::INT AS part FROM firsts))),
{_bloom_hashes()},
set_at AS MATERIALIZED (SELECT trace, part, bf_no, bit, min(n) AS since FROM bits GROUP BY ALL),
matches AS MATERIALIZED (SELECT b.trace, b.part, b.chunk_id, b.bf_no AS own, s.bf_no, max(since) AS since FROM bits b JOIN set_at s USING (trace, part, bit) JOIN (SELECT trace, chunk_id, count(*) AS k FROM bits GROUP BY ALL) c USING (trace, chunk_id) GROUP BY ALL HAVING count(*) = any_value(k)),
arrivals AS MATERIALIZED (SELECT c.trace, m.part, c.version, c.pos, m.bf_no FROM chunks c JOIN matches m USING (trace, chunk_id) JOIN store s ON s.trace = m.trace AND s.part = m.part AND s.n = m.since WHERE (s.version, s.pos) < (c.version, c.pos)),
loads1 AS MATERIALIZED (SELECT *, bf_no IS DISTINCT FROM lag(bf_no) OVER (PARTITION BY trace, part ORDER BY version, pos, bf_no) AS load FROM arrivals),
runs AS MATERIALIZED (SELECT * EXCLUDE (load), bf_no IS DISTINCT FROM lag(bf_no, 2) OVER (PARTITION BY trace, part ORDER BY version, pos, bf_no) AS load FROM loads1 WHERE load)"""
_COUNTED = "SELECT trace, part, version, count(*) AS matches, coalesce(any_value(n), 0) AS loads FROM arrivals LEFT JOIN (SELECT trace, part, version, count(*) AS n FROM {0} GROUP BY ALL) USING (trace, part, version) GROUP BY ALL"


def _bloom(body: str) -> str:
    return f"WITH chunks AS MATERIALIZED ({SNAPSHOT}), {_BLOOM.lstrip().removeprefix(',')} {body}"


_STREAM = """SELECT 'events' AS trace, v::INT AS version, row_number() OVER (PARTITION BY v ORDER BY event_id) - 1 AS pos, chunk_id FROM (
 SELECT event_id, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS v, """ + _id("concat(user_id, ':', event_type)") + """ AS chunk_id FROM events)"""
_TOTALS = "SELECT trace, version, count(*) AS total, count(*) FILTER (NOT is_dup) AS stored, count(DISTINCT seq) AS windows FROM rows{0} GROUP BY ALL"
_META = "meta AS MATERIALIZED (SELECT trace, 'container' AS kind, container_id AS subset_id, count(*) AS chunk_num FROM packed GROUP BY ALL UNION ALL SELECT trace, 'recipe', recipe_id, count(*) FROM rows_ GROUP BY ALL)"
_PER = """SELECT trace, seq, coalesce(s, 0) AS n_selected, coalesce(c, 0) AS n_candidates FROM (SELECT DISTINCT trace, seq FROM windowed WHERE version = 4) LEFT JOIN (SELECT trace, seq, count(*) AS s FROM s GROUP BY ALL) USING (trace, seq)
 LEFT JOIN (SELECT trace, seq, count(DISTINCT subset_id) AS c FROM pairs WHERE role = 'cnr_ptr' GROUP BY ALL) USING (trace, seq)"""


def _ratios(ratios: tuple[int, ...], cap: int) -> str:
    ctes = ["newest AS MATERIALIZED (SELECT * FROM windowed WHERE version = 4)", "held AS MATERIALIZED (SELECT trace, container_id, chunk_id FROM packed WHERE version < 4)"]
    for i, r in enumerate(ratios):
        ctes.append(f"pick{i} AS MATERIALIZED (SELECT trace, seq, subset_id FROM (SELECT trace, seq, container_id AS subset_id, count(*) AS score FROM newest JOIN (SELECT DISTINCT trace, chunk_id, container_id FROM packed WHERE version < 4 AND (ord + 1) % {r + 1} = 0) USING (trace, chunk_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY trace, seq ORDER BY score DESC, subset_id) <= {cap})")
        ctes.append(f"got{i} AS MATERIALIZED (SELECT DISTINCT n.trace, n.seq, n.chunk_id, 1 AS hit FROM newest n JOIN held h USING (trace, chunk_id) JOIN pick{i} p ON p.trace = n.trace AND p.seq = n.seq AND p.subset_id = h.container_id)")
    return _with(ctes, " UNION ALL ".join(f"SELECT {i}::INT AS cfg_id, {r}::INT AS ratio, trace, version, count(*) AS total, count(*) FILTER (hit IS NULL) AS stored, (SELECT count(*) FROM pick{i}) AS loads FROM newest LEFT JOIN got{i} USING (trace, seq, chunk_id) GROUP BY ALL" for i, r in enumerate(ratios)), shared=_PACKED)


SQL |= {
    "sample_features": _snap(_PACKED, f"SELECT * FROM (SELECT trace, chunk_id, ord, (ord + 1) % 9 = 0 AS by_position, {_FP} & 15 = 15 OR {_FP} & 7 = 0 AS uniform FROM packed) WHERE by_position OR uniform"),
    "hook_hits_distinct": _snap(_ROLES, "SELECT DISTINCT trace, seq, chunk_id FROM windowed SEMI JOIN (SELECT trace, chunk_id FROM roles WHERE version < 4) r USING (trace, chunk_id) WHERE version = 4"),
    "select_sparse": _policy(P.greedy("s", "pairs", 4)),
    "select_level": _policy(["made AS MATERIALIZED (SELECT trace, container_id AS subset_id, max(seq) AS made FROM packed GROUP BY ALL)", *P.level("s", "cand", "made", 4)]),
    "select_hybrid": _roles(P.hybrid("s", "pairs", 2)),
    "select_hybrid_basic": _roles(P.basic("s", "pairs")),
    "select_hybrid_dense": _roles([_META, *P.dense("s", "pairs", "meta", 8)]),
    "adaptive_cap": _roles([*P.hybrid("s", "pairs", 2), f"per AS MATERIALIZED ({_PER})", *P.adaptive("ad", "per", "SELECT 0 AS i, 0 AS spent, 0 AS met", 2, 8)], "SELECT trace, seq, cap, least(n_selected, greatest(cap, 1)) AS loads FROM ad JOIN per USING (trace, seq)"),
    "near_exact_report": _near("_a"),
    "near_exact_no_flush_report": _near("_f", cap=1, policy="fifo", flush=False),
    "near_exact_recipe_report": _near("_r", kind="recipe"),
    "hybrid_report": _near("_h", "hybrid", cache=16, kind="hybrid", adapt=True),
    "incremental_ingest": _with(P.epochs("_i", 5), _TOTALS.format("_i")),
    "run_sweep": _run_sweep(),
    "bit_sweep": _bit_sweep(),
    "strict_sort_report": _strict("sort"),
    "strict_fifo_report": _strict("fifo"),
    "ingest_bounded": _ingest_bounded(),
    "strategy_compare": _compare(),
    "stream_near_exact": _with(P.epochs("_s", 4), _TOTALS.format("_s"), _STREAM),
    "bloom_filters": _bloom("SELECT trace, part, bf_no, count(DISTINCT chunk_id) AS members, count(DISTINCT bit) AS set_bits, md5(string_agg(DISTINCT bit::VARCHAR, ',' ORDER BY bit)) AS digest FROM bits GROUP BY ALL".replace("string_agg(DISTINCT bit::VARCHAR, ',' ORDER BY bit)", "array_to_string(list_sort(list(DISTINCT bit)), ',')")),
    "bloom_members": _bloom("SELECT trace, part, count(*) FILTER (bf_no = own) AS found, count(*) FILTER (bf_no <> own) AS others FROM matches GROUP BY ALL"),
    "bloom_loads": _bloom(_COUNTED.format("(SELECT * FROM loads1 WHERE load)")),
    "bloom_loads_cached": _bloom(_COUNTED.format("(SELECT * FROM runs WHERE load)")),
    "bloom_fpp": _bloom("SELECT trace, probes, false_matches, false_matches::DOUBLE / probes AS share FROM (SELECT trace, sum((f - 1) * s)::BIGINT AS probes FROM (SELECT trace, part, count(DISTINCT bf_no) AS f, count(*) AS s FROM store GROUP BY ALL) GROUP BY trace) JOIN (SELECT trace, count(*) FILTER (bf_no <> own) AS false_matches FROM matches GROUP BY trace) USING (trace)"),
    "bloom_report": _bloom(f"""SELECT *, {_RATE} AS dedup_rate, round(all_total::DOUBLE / nullif(all_stored, 0), 6) AS all_dedup_rate FROM (SELECT trace, version, (SELECT parts::INT FROM parts) AS partitions, 1 AS bf_cache, total, stored, filters * 52.0::DOUBLE AS filter_size, loads,
        (sum(total) {_SO_FAR})::BIGINT AS all_total, (sum(stored) {_SO_FAR})::BIGINT AS all_stored, (sum(filters) {_SO_FAR})::BIGINT * 52.0::DOUBLE AS all_filter_size, (sum(loads) {_SO_FAR})::BIGINT AS all_loads
        FROM (SELECT trace, version, total, coalesce(stored, 0) AS stored, coalesce(filters, 0) AS filters, coalesce(loads, 0) AS loads FROM (SELECT trace, version, count(*) AS total FROM chunks GROUP BY ALL)
        LEFT JOIN (SELECT trace, version, count(*) AS stored, count(*) FILTER (slot = 0) AS filters FROM store GROUP BY ALL) USING (trace, version) LEFT JOIN (SELECT trace, version, count(*) FILTER (load) AS loads FROM loads1 GROUP BY ALL) USING (trace, version)))"""),
    "ratio_sweep": _ratios((4, 8, 32), 4),
    "report_roundtrip": SQL["version_dedup_report"],
    "window_rates_roundtrip": _snap(_WINDOWED, f"SELECT version, seq, {_RATE} AS rate FROM (SELECT trace, version, seq, count(*) AS total, count(*) FILTER (NOT is_dup) AS stored FROM flagged GROUP BY ALL)"),
    "recipe_files_roundtrip": SQL["recipe_roundtrip"],
    "manifest_roundtrip": SQL["trace_roundtrip"],
}

SQL |= {f"{name}_roundtrip": SQL[name] for name in ("near_exact_report", "hybrid_report")}
