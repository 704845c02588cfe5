"""SQL of the clustering and the cover: recursive tables that take one piece, set or round at a time.

All tables but the recursive ones (``_w``, read once, by ``_v``) are to be materialized.

A set is a struct: n (order), its id, type and borders (s, si, ei, e), supports, and steps (see
operators.cluster). Each recursion handles the next row of every unit at once.
"""

from tessera.config import PAIR_REACH, SET_REACH

_WIDTH = "greatest({0}, {1}, {2}, {3}) - least({0}, {1}, {2}, {3})"
_ORDER = '"start", "end", inner_start, inner_end, kind, name, svtype, forward, mapcount'
_STEP = "STRUCT(s BIGINT, si BIGINT, ei BIGINT, e BIGINT, f BOOLEAN)"
SET = f"STRUCT(n BIGINT, id VARCHAR, svtype VARCHAR, s BIGINT, si BIGINT, ei BIGINT, e BIGINT, disc BIGINT, split BIGINT, unb BIGINT, steps {_STEP}[])"
FAMILY = "CASE {0} WHEN 'DELINV' THEN 'DELETION' WHEN 'INSINV' THEN 'INSERTION' WHEN 'TANDEM' THEN 'EVERSION' ELSE {0} END"


def units(name: str, rows: str, reach: str, letter: str) -> dict[str, str]:
    """``rows`` (file, chr, family, ...) with unit, k (its place there) and place (both, as text); a unit is a chain of rows that reach the next one's start."""
    part = "PARTITION BY file, chr, family"
    return {
        f"{name}_r": f"SELECT *, {reach} AS reach FROM {rows}",
        f"{name}_h": f'SELECT *, CASE WHEN "start" <= max(reach) OVER ({part} ORDER BY "start", reach ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN NULL ELSE "start" END AS head FROM {name}_r',
        f"{name}_u": f'SELECT *, max(head) OVER ({part} ORDER BY "start") AS unit FROM {name}_h',
        f"{name}_k": f"SELECT *, file || chr || ':' || family || ':' || unit || ':{letter}' || k AS place FROM (SELECT *, row_number() OVER ({part}, unit ORDER BY kind = 'unbalanced', {_ORDER}) AS k FROM {name}_u)",
    }


def clustered(name: str, rows: str, reach: str, letter: str) -> dict[str, str]:
    """Sets of pieces: ``name`` (file, chr, family, x: the set) and ``name``_members (id, name, kind, mapcount)."""
    step = f"{{'s': p.\"start\", 'si': p.inner_start, 'ei': p.inner_end, 'e': p.\"end\", 'f': CASE WHEN p.kind = 'unbalanced' THEN p.forward END}}::{_STEP}"
    own = f"{PAIR_REACH} * (p.inner_start - p.\"start\")"
    two = f"greatest({_WIDTH.format('x.s', 'x.si', 'p.start', 'p.inner_start')}, {_WIDTH.format('x.ei', 'x.e', 'p.inner_end', 'p.end')}) <= {own} AND {FAMILY.format('x.svtype')} = {FAMILY.format('p.svtype')}"
    disc = 'x.s <= p.inner_start AND x.si >= p."start" AND x.ei <= p."end" AND x.e >= p.inner_end AND p.inner_start < x.si AND p.inner_end > x.ei'
    split = '((p."start" < x.si AND x.ei < p."end" AND x.s < p.inner_start AND x.e > p.inner_end) OR (x.si = p.inner_start AND x.ei = p.inner_end))'
    one = f"x.svtype = 'DELETION' AND p.\"start\" < x.e AND p.\"end\" > x.s AND least({_WIDTH.format('x.s', 'x.si', 'p.start', 'p.end')}, {_WIDTH.format('x.ei', 'x.e', 'p.start', 'p.end')}) <= {PAIR_REACH} * (x.si - x.s)"
    one, two = (t.replace("p.start", 'p."start"').replace("p.end", 'p."end"') for t in (one, two))
    agrees = f"CASE p.kind WHEN 'unbalanced' THEN {one} WHEN 'disc' THEN {two} AND {disc} ELSE {two} AND {split} END"
    wide = (
        "{'n': x.n, 'id': x.id, 'svtype': x.svtype, 's': least(x.s, p.\"start\"), 'si': greatest(x.si, p.inner_start), 'ei': least(x.ei, p.inner_end), 'e': greatest(x.e, p.\"end\"),"
        " 'disc': x.disc + (p.kind = 'disc')::BIGINT, 'split': x.split + (p.kind = 'split')::BIGINT, 'unb': x.unb,"
        f" 'steps': [{{'s': least(x.steps[1].s, p.\"start\"), 'si': greatest(x.steps[1].si, p.inner_start), 'ei': least(x.steps[1].ei, p.inner_end), 'e': greatest(x.steps[1].e, p.\"end\"), 'f': NULL}}::{_STEP}]}}::{SET}"
    )
    at_start = 'abs(p."start" - x.s) < abs(p."end" - x.e)'
    faced = (
        f"{{'n': x.n, 'id': x.id, 'svtype': x.svtype, 's': x.s, 'si': CASE WHEN p.forward AND {at_start} AND p.\"start\" < x.ei THEN p.\"start\" ELSE x.si END,"
        f" 'ei': CASE WHEN NOT p.forward AND NOT ({at_start}) AND p.\"end\" > x.si THEN p.\"end\" ELSE x.ei END, 'e': x.e, 'disc': x.disc, 'split': x.split, 'unb': x.unb + 1, 'steps': list_append(x.steps, {step})}}::{SET}"
    )
    new = (
        f"{{'n': len(w.sets), 'id': w.prefix || len(w.sets), 'svtype': p.svtype, 's': p.\"start\", 'si': p.inner_start, 'ei': p.inner_end, 'e': p.\"end\","
        f" 'disc': (p.kind = 'disc')::BIGINT, 'split': (p.kind = 'split')::BIGINT, 'unb': 0, 'steps': [{step}]}}::{SET}"
    )
    return {
        **units(name, rows, reach, letter),
        f"{name}_w": f"""SELECT file, chr, family, unit, file || chr || ':' || family || ':' || unit || ':{letter}' AS prefix, 0::BIGINT AS k, []::{SET}[] AS sets, NULL::VARCHAR AS joined, NULL::VARCHAR AS name, NULL::VARCHAR AS kind, NULL::BIGINT AS mapcount
          FROM (SELECT DISTINCT file, chr, family, unit FROM {name}_k)
          UNION ALL SELECT file, chr, family, unit, prefix, k, CASE WHEN hit.n IS NOT NULL AND keeps THEN list_transform(sets, lambda x: CASE WHEN x.n = hit.n THEN moved ELSE x END) WHEN hit.n IS NULL AND kind <> 'unbalanced' THEN list_append(sets, fresh) ELSE sets END,
            CASE WHEN hit.n IS NOT NULL AND keeps THEN hit.id WHEN hit.n IS NULL AND kind <> 'unbalanced' THEN fresh.id END, name, kind, mapcount
          FROM (SELECT *, p.name AS name, p.kind AS kind, p.mapcount AS mapcount, p.kind = 'unbalanced' OR p.inner_end > hit.si AS keeps, CASE WHEN p.kind = 'unbalanced' THEN {faced.replace('x.', 'hit.')} ELSE {wide.replace('x.', 'hit.')} END AS moved
            FROM (SELECT w.file, w.chr, w.family, w.unit, w.prefix, p.k, w.sets, p, list_filter(w.sets, lambda x: {agrees})[1] AS hit, {new} AS fresh
              FROM {name}_w w JOIN {name}_k p ON p.place = w.prefix || (w.k + 1)))""",
        f"{name}_v": f"SELECT * FROM {name}_w",
        name: f"SELECT file, chr, family, unnest(sets) AS x FROM (SELECT file, chr, family, arg_max(sets, k) AS sets FROM {name}_v GROUP BY file, chr, family, unit)",
        f"{name}_members": f"SELECT joined AS id, name, kind, mapcount FROM {name}_v WHERE joined IS NOT NULL",
    }


def folded(name: str, first: str | None, second: str) -> dict[str, str]:
    """Sets of ``second`` folded into those of ``first``: ``name`` (chr, family, x) and ``name``_members, as in clustered."""
    there = f"SELECT chr, family, x FROM {first}" if first else f"SELECT chr, family, x FROM {second} WHERE false"
    meets = f"x.si < o.ei AND x.ei > o.si AND greatest({_WIDTH.format('x.s', 'x.si', 'o.s', 'o.si')}, {_WIDTH.format('x.ei', 'x.e', 'o.ei', 'o.e')}) <= {SET_REACH}"
    faced = "CASE WHEN hit.svtype = 'DELETION' AND {c} THEN {v} ELSE a.{o} END"
    at_start = "abs(t.s - a.s) < abs(t.e - a.e)"
    # Borders as a step: widened by a hull, or with the border moved that a piece faces.
    taken = (
        "list_reduce(o.steps, lambda a, t: CASE WHEN t.f IS NULL THEN {'s': least(a.s, a.si, t.s, t.si), 'si': greatest(a.s, a.si, t.s, t.si), 'ei': least(a.ei, a.e, t.ei, t.e), 'e': greatest(a.ei, a.e, t.ei, t.e), 'f': NULL::BOOLEAN}"
        f" ELSE {{'s': a.s, 'si': {faced.format(c=f't.f AND {at_start} AND t.s < a.ei', v='t.s', o='si')}, 'ei': {faced.format(c=f'NOT t.f AND NOT ({at_start}) AND t.e > a.si', v='t.e', o='ei')}, 'e': a.e, 'f': NULL::BOOLEAN}} END, begin)"
    )
    four = "list_sort([o.s, o.e, o.si, o.ei])"
    begin = f"{{'s': least(hit.s, hit.si, {four}[1], {four}[2]), 'si': greatest(hit.s, hit.si, {four}[1], {four}[2]), 'ei': least(hit.ei, hit.e, {four}[3], {four}[4]), 'e': greatest(hit.ei, hit.e, {four}[3], {four}[4]), 'f': NULL}}::{_STEP}"
    merged = "{'n': hit.n, 'id': hit.id, 'svtype': hit.svtype, 's': b.s, 'si': b.si, 'ei': b.ei, 'e': b.e, 'disc': hit.disc + o.disc, 'split': hit.split + o.split, 'unb': hit.unb + o.unb, 'steps': list_concat(hit.steps, o.steps)}::" + SET
    kept = "{'n': 1000000000 + k, 'id': o.id, 'svtype': o.svtype, 's': o.s, 'si': o.si, 'ei': o.ei, 'e': o.e, 'disc': o.disc, 'split': o.split, 'unb': o.unb, 'steps': o.steps}::" + SET
    numbered = "{'n': r, 'id': x.id, 'svtype': x.svtype, 's': x.s, 'si': x.si, 'ei': x.ei, 'e': x.e, 'disc': x.disc, 'split': x.split, 'unb': x.unb, 'steps': x.steps}::" + SET
    return {
        f"{name}_a": f"SELECT chr, family, {numbered} AS x FROM (SELECT *, row_number() OVER (PARTITION BY chr, family ORDER BY x.s, x.n, x.id) AS r FROM ({there}))",
        f"{name}_o": f"SELECT chr, family, x AS o, row_number() OVER (PARTITION BY chr, family ORDER BY x.s, x.n, x.id) AS k, lag(x.s) OVER (PARTITION BY chr, family ORDER BY x.s, x.n, x.id) AS before FROM {second}",
        # What comes into reach with each set; what comes into reach of none is done as it is.
        f"{name}_e": f"SELECT o.chr, o.family, o.k, list(a.x ORDER BY a.x.n) AS enter FROM {name}_o o JOIN {name}_a a ON a.chr = o.chr AND a.family = o.family AND a.x.s <= o.o.s + {SET_REACH} AND (o.before IS NULL OR a.x.s > o.before + {SET_REACH}) GROUP BY ALL",
        f"{name}_n": f"SELECT o.*, o.chr || ':' || o.family || ':' || o.k AS place, coalesce(e.enter, []::{SET}[]) AS enter FROM {name}_o o LEFT JOIN {name}_e e USING (chr, family, k)",
        f"{name}_w": f"""SELECT chr, family, 0::BIGINT AS k, []::{SET}[] AS live, []::{SET}[] AS done, NULL::VARCHAR AS gone, NULL::VARCHAR AS target FROM (SELECT DISTINCT chr, family FROM {name}_o)
          UNION ALL SELECT chr, family, k, CASE WHEN hit.n IS NULL THEN list_append(near, {kept}) WHEN o.ei > hit.si THEN list_transform(near, lambda x: CASE WHEN x.n = hit.n THEN {merged} ELSE x END) ELSE near END, done, CASE WHEN hit.n IS NOT NULL THEN o.id END, CASE WHEN o.ei > hit.si THEN hit.id END
          FROM (SELECT *, {taken} AS b FROM (SELECT *, {begin} AS begin FROM (SELECT *, list_sort(list_filter(near, lambda x: {meets}))[1] AS hit FROM (
            SELECT w.chr, w.family, n.k, n.o, list_filter(list_concat(w.live, n.enter), lambda x: x.s + {SET_REACH} >= n.o.s) AS near, list_filter(list_concat(w.live, n.enter), lambda x: x.s + {SET_REACH} < n.o.s) AS done
            FROM {name}_w w JOIN {name}_n n ON n.place = w.chr || ':' || w.family || ':' || (w.k + 1)))))""",
        f"{name}_v": f"SELECT * FROM {name}_w",
        f"{name}_last": f"SELECT chr, family, arg_max(live, k) AS live, max(k) AS k FROM {name}_v GROUP BY chr, family",
        name: f"""SELECT chr, family, unnest(done) AS x FROM {name}_v UNION ALL SELECT chr, family, unnest(live) AS x FROM {name}_last
          UNION ALL SELECT chr, family, x FROM {name}_a a WHERE NOT EXISTS (SELECT 1 FROM {name}_o o WHERE o.chr = a.chr AND o.family = a.family AND a.x.s <= o.o.s + {SET_REACH})""",
        f"{name}_members": (f"SELECT * FROM {first}_members UNION ALL " if first else "")
        + f"SELECT coalesce(w.target, m.id) AS id, m.name, m.kind, m.mapcount FROM {second}_members m LEFT JOIN (SELECT gone, target FROM {name}_v WHERE gone IS NOT NULL) w ON w.gone = m.id WHERE w.gone IS NULL OR w.target IS NOT NULL",
    }


SHOWN = 'x.id AS set_id, chr, family, x.s AS "start", x.si AS inner_start, x.ei AS inner_end, x.e AS "end", x.svtype AS svtype, x.disc + x.split + x.unb AS raw_reads, x.disc AS disc_support, x.split AS split_support, x.unb AS unbalanced_support'


def covered(name: str, sets: str, min_reads: int, min_support: int) -> dict[str, str]:
    """``name`` (set_id, support): in each round, the sets that outweigh all they share a name with."""
    weight = "(sum(units) + 500000) // 1000000"
    return {
        f"{name}_m": f"""SELECT set_id, name, 1000000000000000 // max(mapcount) AS units FROM (SELECT id AS set_id, CASE WHEN kind = 'disc' THEN 'p:' ELSE 's:' END || name AS name, mapcount FROM {sets}_members)
          WHERE set_id IN (SELECT x.id FROM {sets} WHERE x.disc + x.split + x.unb >= {min_reads}) GROUP BY set_id, name""",
        f"{name}_w": f"""SELECT 'm' AS tag, m.set_id, m.name, m.units, w.weight FROM {name}_m m JOIN (SELECT set_id, {weight} AS weight FROM {name}_m GROUP BY set_id) w ON w.set_id = m.set_id WHERE w.weight >= {min_support} * 1000000000
          UNION ALL (WITH live AS (SELECT set_id, name, units, weight FROM {name}_w WHERE tag = 'm'),
            best AS (SELECT name, min({{'w': -weight, 'id': set_id}}) AS best FROM live GROUP BY name),
            won AS (SELECT l.set_id, l.weight FROM live l JOIN best b ON b.name = l.name GROUP BY l.set_id, l.weight HAVING bool_and(b.best.id = l.set_id)),
            used AS (SELECT DISTINCT name FROM live WHERE set_id IN (SELECT set_id FROM won)),
            rest AS (SELECT set_id, name, units FROM live WHERE set_id NOT IN (SELECT set_id FROM won) AND name NOT IN (SELECT name FROM used)),
            heavy AS (SELECT set_id, {weight} AS weight FROM rest GROUP BY set_id HAVING {weight} >= {min_support} * 1000000000)
            SELECT 'w' AS tag, set_id, NULL AS name, NULL AS units, weight FROM won UNION ALL SELECT 'm', r.set_id, r.name, r.units, h.weight FROM rest r JOIN heavy h ON h.set_id = r.set_id)""",
        name: f"SELECT set_id, weight / 1000000000 AS support FROM {name}_w WHERE tag = 'w'",
    }
