"""SQL text of the views in ``suite/fixtures.py`` for the side-by-side check."""

from __future__ import annotations

VIEWS = {
    "fx_px": """SELECT vec_id AS frame_id, label AS sample_id, ((p.i - 1) // 8)::INTEGER AS y,
        ((p.i - 1) % 8)::INTEGER AS x, round_even((embedding[p.i]::DOUBLE + 1) * 127.5, 0)::INTEGER AS g
        FROM embeddings, (SELECT unnest(range(1, 65)) AS i) p""",
    "fx_rgb": """SELECT (frame_id // 3)::BIGINT AS frame_id, y, x, max(CASE WHEN frame_id % 3 = 0 THEN g END) AS r,
        max(CASE WHEN frame_id % 3 = 1 THEN g END) AS g, max(CASE WHEN frame_id % 3 = 2 THEN g END) AS b
        FROM fx_px GROUP BY 1, 2, 3 HAVING count(*) = 3""",
    "fx_frames": """SELECT l_suppkey AS sample_id, l_orderkey AS k, n.name, l_extendedprice, l_discount, l_tax, l_partkey,
        l_linenumber, '/scan/sample_' || l_suppkey || '/' || lpad(l_orderkey::VARCHAR, 9, '0') || '/' || n.name AS path
        FROM lineitem, LATERAL (SELECT 'Y' || lpad(l_partkey::VARCHAR, 5, '0') || ' X' || l_linenumber || ' Z29 F'
        || (floor(l_quantity)::BIGINT * 100 + l_linenumber) || '.tiff' AS name) n""",
    "fx_seq": """SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY y) - 1)::BIGINT AS seq FROM (
        SELECT * FROM (SELECT *, regexp_extract(name, 'Y(\\d+)', 1)::BIGINT AS y,
        regexp_extract(name, 'F(\\d+)', 1)::BIGINT AS f FROM fx_frames)
        QUALIFY row_number() OVER (PARTITION BY sample_id, y
        ORDER BY f DESC, path, l_extendedprice, l_discount, l_tax) = 1)""",
    "fx_pairs": """SELECT sample_id, seq AS pair_idx, y, next_y, name, next_name,
        (600 + floor(l_extendedprice)::BIGINT % 900)::INTEGER AS x_overlap, ((l_partkey % 25) - 12)::INTEGER AS y_offset,
        round(0.88::DOUBLE + (cents % 1201) / 10000.0::DOUBLE, 4) AS score,
        round(0.86::DOUBLE + ((cents // 7) % 1401) / 10000.0::DOUBLE, 4) AS coarse_score FROM (
        SELECT *, round_even(l_extendedprice * 100, 0)::BIGINT AS cents,
        lead(y) OVER (PARTITION BY sample_id ORDER BY y) AS next_y,
        lead(name) OVER (PARTITION BY sample_id ORDER BY y) AS next_name FROM fx_seq) WHERE next_y IS NOT NULL""",
    "fx_zsweep": """SELECT stack_id, seq, (1600 + 560 - 4 * least(seq % 560, 560 - seq % 560))::INTEGER AS z, score FROM (
        SELECT l_suppkey AS stack_id, l_extendedprice AS score, (row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice) - 1)::BIGINT AS seq FROM lineitem)""",
    "fx_events": """SELECT event_id, ts, user_id, event_type, value,
        json_extract_string(props, '$.k')::INTEGER AS k FROM events""",
    "fx_series": """SELECT user_id AS sample_id, event_id AS seq, ts, k AS y, trunc(value / 10)::INTEGER AS hard,
        trunc(value / 5)::INTEGER AS soft, (event_id % 60)::INTEGER AS ylum, event_type = 'signup' AS is_break
        FROM fx_events""",
    "fx_tilehits": """SELECT CASE WHEN user_id % 2 = 0 THEN 3584 ELSE 1792 END AS grid_w,
        CASE WHEN user_id % 2 = 0 THEN 2748 ELSE 1374 END AS grid_h, (k % 10)::INTEGER AS col,
        (k // 10)::INTEGER AS "row", ts, event_id AS frame_id FROM fx_events""",
    "fx_captures": """SELECT user_id AS camera, CASE WHEN event_type = 'click' THEN 'still' ELSE 'stream' END AS source,
        ts, event_id FROM fx_events""",
    "fx_cmdlog": """SELECT user_id AS device, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'G28'
        WHEN 'view' THEN 'G0 X' || printf('%.2f', k::DOUBLE * 2.35::DOUBLE)
        WHEN 'click' THEN 'G0 Y' || printf('%.2f', k::DOUBLE * 1.75::DOUBLE) || ' Z'
        || printf('%.2f', (event_id % 3000)::DOUBLE / 50)
        WHEN 'purchase' THEN 'G1 Z' || printf('%.2f', (event_id % 3000)::DOUBLE / 50) || ' rate=' || k
        ELSE 'M400' END AS line FROM fx_events""",
    "fx_replies": """SELECT user_id AS device, ts, event_id AS reply_seq,
        (['ok', 'processing', 'error: probe', 'echo: busy'])[event_id % 4 + 1] AS reply FROM fx_events
        WHERE event_type IN ('view', 'error')""",
    "fx_desc": """SELECT label AS image_id, vec_id AS kp_id, ((37 * vec_id) % 640)::DOUBLE AS px,
        ((91 * vec_id) % 480)::DOUBLE AS py, embedding AS "desc" FROM embeddings""",
    "fx_cameras": """SELECT 'camera ' || p_partkey AS title, 1000 + p_size * 50 AS nx, 800 + p_size * 40 AS ny,
        1 + p_retailprice / 1000 AS pixel_um, 0.1::DOUBLE + p_size / 100 AS na FROM part""",
    "fx_timings": """SELECT l_suppkey % 10 AS run_id, l_returnflag AS category, l_quantity AS seconds FROM lineitem""",
}

# view -> views it is built on
NEEDS = {
    "fx_rgb": ["fx_px"], "fx_seq": ["fx_frames"], "fx_pairs": ["fx_seq"], "fx_series": ["fx_events"],
    "fx_tilehits": ["fx_events"], "fx_captures": ["fx_events"], "fx_cmdlog": ["fx_events"],
    "fx_replies": ["fx_events"],
}


def sql(body: str, *views: str, recursive: bool = False, **ctes: str) -> str:
    """``body`` behind a WITH clause that holds the named views, their bases and further named CTEs."""
    wanted: list[str] = []

    def add(view: str) -> None:
        for base in NEEDS.get(view, []):
            add(base)
        if view not in wanted:
            wanted.append(view)

    for view in views:
        add(view)
    parts = [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in wanted] + [f"{n} AS {'' if recursive else 'MATERIALIZED '}({t})" for n, t in ctes.items()]
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + body
