"""The queries in SQL for DuckDB over the same tables, written from the definitions."""

from __future__ import annotations

from .columns import SQL_TYPES, pairs

F1 = """f1 AS (
  SELECT i.image_id, y.y, x.x, coalesce(e.v, 0) AS v
  FROM (SELECT DISTINCT dayofyear(ts) - 1 AS image_id FROM events) i, (SELECT unnest(range(16)) AS y) y, (SELECT unnest(range(24)) AS x) x
  LEFT JOIN (SELECT dayofyear(ts) - 1 AS image_id, user_id % 16 AS y, hour(ts) AS x, max(ascii(event_type) % 4 + 1) AS v FROM events GROUP BY ALL) e
    ON e.image_id = i.image_id AND e.y = y.y AND e.x = x.x)"""
F2 = """f2 AS (
  SELECT image_id, i // 8 AS y, i % 8 AS x, least(greatest(floor((e::DOUBLE + 0.25) * 8), 0), 15)::INTEGER AS v
  FROM (SELECT vec_id AS image_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings))"""
F3 = """f3 AS (
  SELECT image_id, y, x, floor((embedding[4*x+1]::DOUBLE + 1) * 127.5)::INTEGER AS r, floor((embedding[4*x+2]::DOUBLE + 1) * 127.5)::INTEGER AS g,
    floor((embedding[4*x+3]::DOUBLE + 1) * 127.5)::INTEGER AS b, CASE WHEN (vec_id + x) % 11 = 0 THEN 0 ELSE floor((embedding[4*x+4]::DOUBLE + 1) * 127.5)::INTEGER END AS a
  FROM (SELECT label AS image_id, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings), (SELECT unnest(range(16)) AS x)),
  f3n AS (SELECT image_id, y, x, CASE a WHEN 0 THEN 0 ELSE r END AS r, CASE a WHEN 0 THEN 0 ELSE g END AS g, CASE a WHEN 0 THEN 0 ELSE b END AS b, a FROM f3),
  h3 AS (SELECT image_id, r, g, b, a, count(*) AS n FROM f3n GROUP BY ALL)"""
F4 = """f4 AS (
  SELECT image_id, i // 64 AS y, i % 64 AS x, ord(c) & 255 AS v
  FROM (SELECT image_id, unnest(range(size)) AS i, unnest(string_split(text || repeat(chr(256), size - length(text)), '')) AS c
    FROM (SELECT doc_id AS image_id, coalesce(text, '') AS text, greatest(512, (length(coalesce(text, '')) + 63) // 64 * 64) AS size FROM documents)))"""
F5 = """h5 AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS image_id, trunc(l_quantity * 5)::INTEGER AS r, round_even(l_discount * 2500, 0)::INTEGER AS g,
    round_even(l_tax * 3000, 0)::INTEGER AS b, CASE l_linestatus WHEN 'F' THEN 255 ELSE 128 END AS a, count(*) AS n
  FROM lineitem GROUP BY ALL)"""
F6 = """f6 AS (
  SELECT user_id AS layout_id, event_id AS seq, 8 + event_id * 7 % 40 AS xp, CASE WHEN event_type IN ('click', 'view') THEN 4 ELSE 70 END + event_id % 8 AS yp, 4 + event_id % 5 AS w, 2 + event_id % 3 AS h FROM events),
  mp AS (SELECT layout_id, seq, yp + j AS y, xp + i AS x FROM (SELECT *, unnest(range(w)) AS i FROM (SELECT *, unnest(range(h)) AS j FROM f6))),
  scr AS (SELECT DISTINCT layout_id, y, x FROM mp),
  tight AS (SELECT layout_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM scr GROUP BY 1)"""


def padded(source: str, name: str) -> str:
    def take(lo: str, hi: str) -> str:
        return f"least(greatest(0, 8 - ({hi} - {lo})), {lo})"

    x, y = take("x1", "x2"), take("y1", "y2")
    return f"{name} AS (SELECT * REPLACE (x1 - {x} AS x1, x2 + greatest(0, 8 - (x2 - x1)) - {x} AS x2, y1 - {y} AS y1, y2 + greatest(0, 8 - (y2 - y1)) - {y} AS y2) FROM {source})"


BOXES = F6 + ", " + padded("tight", "box") + """,
  ext AS (SELECT *, greatest(0, x1 - 7) AS ex1, greatest(0, y1 - 7) AS ey1, least(128, x2 + 7) AS ex2, least(96, y2 + 7) AS ey2 FROM box)"""  # fmt: skip


def cuts(axis: str, other: str, rank: int) -> str:
    """All cuts of one axis, each half's contents found by a plain join, not by windows."""
    parts = []
    for k, test in ((0, "<"), (1, ">=")):
        lo = {"x": "ex1", "y": "ey1"} | ({axis: "pos"} if k else {})
        hi = {"x": "ex2", "y": "ey2"} | ({} if k else {axis: "pos"})
        inside = f"s.layout_id = c.layout_id AND s.{axis} {test} c.pos"
        parts.append(f"""h{axis}{k} AS (
  SELECT c.layout_id, pos, least(coalesce(min(s.{other}), 1000000), any_value({hi[other]}) - 8) AS a1, coalesce(max(s.{other}) + 1, -1000000) AS ahi,
    greatest(coalesce(max(s.{axis}) + 1, -1000000), any_value({lo[axis]}) + 8) AS b2, coalesce(min(s.{axis}), 1000000) AS blo
  FROM p{axis} c LEFT JOIN scr s ON {inside} GROUP BY c.layout_id, pos),
  w{axis}{k} AS (SELECT layout_id, pos, a1 AS w{k}_{other}1, greatest(ahi, a1 + 8) AS w{k}_{other}2, b2 AS w{k}_{axis}2, least(blo, b2 - 8) AS w{k}_{axis}1 FROM h{axis}{k})""")
    pos = f"p{axis} AS (SELECT *, unnest(range(e{axis}1 + 8, e{axis}2 - 7)) AS pos FROM ext)"
    return f"{pos}, {', '.join(parts)}, c{axis} AS (SELECT {rank} AS axis_rank, * FROM w{axis}0 JOIN w{axis}1 USING (layout_id, pos))"


CUTS = BOXES + ", " + cuts("y", "x", 0) + ", " + cuts("x", "y", 1) + """,
  cand AS (SELECT *, (w0_x2 - w0_x1) * (w0_y2 - w0_y1) + (w1_x2 - w1_x1) * (w1_y2 - w1_y1) AS area FROM (SELECT * FROM cy UNION ALL BY NAME SELECT * FROM cx)),
  best AS (SELECT c.* FROM cand c JOIN box USING (layout_id) WHERE area < (x2 - x1) * (y2 - y1) QUALIFY row_number() OVER (PARTITION BY layout_id ORDER BY area, axis_rank, pos) = 1)"""  # fmt: skip

CODE = """CASE WHEN v = 0 AND len < 64 THEN '00' || printf('%02X', len) WHEN v = 0 THEN '00' || printf('%02X', 64 | (len >> 8)) || printf('%02X', len & 255)
  WHEN len < 3 THEN repeat(printf('%02X', v), len) WHEN len < 64 THEN '00' || printf('%02X', 128 + len) || printf('%02X', v)
  ELSE '00' || printf('%02X', 192 | (len >> 8)) || printf('%02X', len & 255) || printf('%02X', v) END"""


def runs(source: str, tag: str = "") -> str:
    """Runs as differences of two numberings, and their codes, rows and images."""
    return f"""isl{tag} AS (SELECT image_id, y, x, v, x - row_number() OVER (PARTITION BY image_id, y, v ORDER BY x) AS grp FROM {source}),
  run0{tag} AS (SELECT image_id, y, min(x) AS x_start, count(*)::INTEGER AS len, v::INTEGER AS v FROM isl{tag} GROUP BY image_id, y, v, grp),
  runs{tag} AS (SELECT *, row_number() OVER (PARTITION BY image_id, y ORDER BY x_start) - 1 AS run_idx FROM run0{tag}),
  codes{tag} AS (SELECT *, {CODE} AS code FROM runs{tag}),
  lines{tag} AS (SELECT image_id, y, string_agg(code, '' ORDER BY run_idx) AS line, sum(len) AS width FROM codes{tag} GROUP BY 1, 2),
  enc{tag} AS (SELECT image_id, max(width) AS width, count(*) AS height, string_agg(line || '0000', '' ORDER BY y) AS data_hex FROM lines{tag} GROUP BY 1)"""


BOTH = f"""{F1}, {F2}, both_ AS (SELECT image_id, y, x, v FROM f1 UNION ALL SELECT image_id + 1000000, y, x, v FROM f2)"""


#: Images and streams of which some break a rule.
MIXED = f"""{F2}, {runs('f2')}, mixed AS (SELECT image_id, width, CASE WHEN image_id % 7 = 0 THEN 4 ELSE height END AS height,
    CASE WHEN image_id % 7 = 0 THEN 'sides not allowed' WHEN image_id % 5 = 0 THEN 'width times height is not its size' END AS error, data_hex FROM enc)"""
BROKEN = f"""{BOTH}, sound AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, string_agg(printf('%02X', v), '' ORDER BY y, x) AS data_hex FROM both_ GROUP BY 1),
  broken AS (SELECT *, CASE WHEN image_id % 11 = 0 THEN 'no rows' WHEN image_id % 5 = 0 THEN 'rows differ in width' WHEN image_id % 7 = 0 THEN 'truncated' END AS error FROM sound)"""


def tree(hist: str, colours: int) -> str:
    shift = ", ".join(f"({c} >> (7 - level)) AS p{c}" for c in "rgba")
    child = " || ',' || ".join(f"({c} >> greatest(6 - level, 0))" for c in "rgba")
    up = " AND ".join(f"f.p{c} = l.p{c} >> 1" for c in "rgba")
    mean = ", ".join(f"least(255, greatest(0, round_even(s{c} / n, 0)))::INTEGER AS {c}" for c in "rgba")
    return f"""nodes AS (SELECT image_id, level, {shift}, sum(n)::BIGINT AS n, count(DISTINCT {child}) AS nchild, {", ".join(f"sum({c} * n)::DOUBLE AS s{c}" for c in "rgba")}
    FROM {hist}, (SELECT unnest(range(8))::INTEGER AS level) GROUP BY ALL),
  sizes AS (SELECT image_id, level, count(*) AS n_nodes FROM nodes GROUP BY ALL),
  split AS (SELECT image_id, max(level) FILTER (n_nodes <= {colours}) AS level FROM sizes GROUP BY 1 HAVING max(n_nodes) FILTER (level = 7) > {colours}),
  fold AS (SELECT n.*, s.n_nodes - coalesce(sum(nchild - 1) OVER (PARTITION BY n.image_id ORDER BY n, pr, pg, pb, pa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > {colours} AS folds
    FROM nodes n JOIN split USING (image_id, level) JOIN sizes s ON s.image_id = n.image_id AND s.level = n.level + 1),
  leaves AS (SELECT * FROM nodes WHERE level = 7 AND image_id NOT IN (SELECT image_id FROM split)
    UNION ALL BY NAME SELECT * EXCLUDE (folds) FROM fold WHERE folds
    UNION ALL BY NAME SELECT l.* FROM nodes l JOIN fold f ON NOT f.folds AND f.image_id = l.image_id AND l.level = f.level + 1 AND {up}),
  pal0 AS (SELECT image_id, level, pr, pg, pb, pa, n, {mean}, row_number() OVER (PARTITION BY image_id ORDER BY level DESC, n, pr, pg, pb, pa) - 1 AS pid FROM leaves),
  pal AS (SELECT * REPLACE (CASE a WHEN 0 THEN 0 ELSE r END AS r, CASE a WHEN 0 THEN 0 ELSE g END AS g, CASE a WHEN 0 THEN 0 ELSE b END AS b) FROM pal0),
  cidx AS (SELECT h.image_id, h.r, h.g, h.b, h.a, p.pid FROM {hist} h JOIN pal p ON p.image_id = h.image_id AND {" AND ".join(f"h.{c} >> (7 - p.level) = p.p{c}" for c in "rgba")})"""


def stats(step: int) -> str:
    """Statistics of the clusters in m<step>."""
    s = step
    mean = ", ".join(f"least(255, greatest(0, round_even(sum({c} * n)::DOUBLE / sum(n), 0)))::INTEGER AS m{c}" for c in "rgba")
    return f"""a{s} AS (SELECT image_id, cid, sum(n)::BIGINT AS weight, count(*) AS pop, {mean} FROM m{s} GROUP BY 1, 2),
  b{s} AS (SELECT * REPLACE (CASE ma WHEN 0 THEN 0 ELSE mr END AS mr, CASE ma WHEN 0 THEN 0 ELSE mg END AS mg, CASE ma WHEN 0 THEN 0 ELSE mb END AS mb) FROM a{s}),
  e{s} AS (SELECT image_id, cid, {", ".join(f"sum(abs({c} - m{c}) * n)::DOUBLE AS e{c}" for c in "rgba")} FROM m{s} JOIN b{s} USING (image_id, cid) GROUP BY 1, 2),
  st{s} AS (SELECT *, CASE greatest(er, eg, eb, ea) WHEN er THEN 0 WHEN eg THEN 1 WHEN eb THEN 2 ELSE 3 END AS chn, least(255, round_even(greatest(er, eg, eb, ea) / weight, 0))::INTEGER AS max_err
    FROM b{s} JOIN e{s} USING (image_id, cid)),
  ch{s} AS (SELECT image_id, cid, k FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS k FROM st{s}) WHERE pop > 1
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY max_err * pow(weight, 0.75 - (k + 0.5) / 16) DESC, cid) = 1)"""


def split(step: int) -> str:
    s, c = step, ("r", "g", "b", "a")
    value = "CASE chn " + " ".join(f"WHEN {i} THEN {x} - m{x}" for i, x in enumerate(c)) + " END"
    return f"""d{s} AS (SELECT m.*, sign({value}) AS side, k FROM m{s} m LEFT JOIN ch{s} USING (image_id, cid) LEFT JOIN st{s} USING (image_id, cid)),
  w{s} AS (SELECT *, coalesce(sum(n) FILTER (k IS NOT NULL AND side > 0) OVER (PARTITION BY image_id), 0) AS up, coalesce(sum(n) FILTER (k IS NOT NULL AND side < 0) OVER (PARTITION BY image_id), 0) AS down FROM d{s}),
  m{s + 1} AS (SELECT image_id, r, g, b, a, n, (CASE WHEN k IS NOT NULL AND (side > 0 OR side = 0 AND up <= down) AND NOT (down = 0 AND up <= down) THEN k ELSE cid END)::INTEGER AS cid FROM w{s})"""


M0 = f"{F5}, m0 AS (SELECT *, 0 AS cid FROM h5)"
SEVEN = M0 + ", " + ", ".join(f"{stats(i)}, {split(i)}" for i in range(7))
HISTORY = F6 + """,
  ep AS (SELECT layout_id, seq // 1000 AS epoch, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM mp GROUP BY 1, 2),
  g1 AS (SELECT e.layout_id, e.epoch, min(p.x1) AS x1, min(p.y1) AS y1, max(p.x2) AS x2, max(p.y2) AS y2 FROM ep e JOIN ep p ON p.layout_id = e.layout_id AND p.epoch <= e.epoch GROUP BY 1, 2), """ + padded("g1", "g2") + """,
  g3 AS (SELECT e.layout_id, e.epoch, min(p.x1) AS x1, min(p.y1) AS y1, max(p.x2) AS x2, max(p.y2) AS y2 FROM g2 e JOIN g2 p ON p.layout_id = e.layout_id AND p.epoch <= e.epoch GROUP BY 1, 2)"""  # fmt: skip
_rel = ", ".join(f"coalesce(w{k}_{c}, box.{c}) - (CASE WHEN axis_rank IS NULL THEN box.{c[0]}1 ELSE e{c[0]}1 END) AS w{k}_{c}" for k in (0, 1) for c in ("x1", "y1", "x2", "y2"))
_outer = ", ".join(f"CASE WHEN axis_rank IS NULL THEN box.{c} ELSE e{c} END AS {c}" for c in ("x1", "y1", "x2", "y2"))
_nib = ", ".join(f"CASE a WHEN 0 THEN 0 ELSE (r >> {7 - i} & 1) + (g >> {7 - i} & 1) * 2 + (b >> {7 - i} & 1) * 4 + (a >> {7 - i} & 1) * 8 END AS d{i}" for i in range(8))
_far = "(h.r - p.r) * (h.r - p.r) + (h.g - p.g) * (h.g - p.g) + (h.b - p.b) * (h.b - p.b) + 3 * (h.a - p.a) * (h.a - p.a)"

#: name -> (common tables, rows)
SOURCES = {
    "bitmap_to_pixels": (F2, "SELECT * FROM f2"),
    "pixels_to_bitmap": (F2, "SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, string_agg(printf('%02X', v), '' ORDER BY y, x) AS data_hex FROM f2 GROUP BY 1"),
    "rgba_pixels": (F3, "SELECT * FROM f3"),
    "rgba_normalize": (F3, "SELECT * FROM f3n"),
    "rle_validate_dims": ("t4 AS (SELECT doc_id, (length(coalesce(text, '')) + 63) // 64 AS height FROM documents)", "SELECT doc_id AS image_id, 64 AS width, height, height BETWEEN 8 AND 4096 AS valid FROM t4"),
    "rle_runs": (f"{F2}, {runs('f2')}", "SELECT * FROM runs"),
    "rle_run_codes": (f"{F2}, {runs('f2')}", "SELECT * FROM codes"),
    "rle_encode": (f"{F2}, {runs('f2')}", "SELECT * FROM enc"),
    "rle_encode_events": (f"{F1}, {runs('f1')}", "SELECT * FROM enc"),
    "rle_encode_text": (f"{F4}, {runs('f4')}", "SELECT *, md5(data_hex) AS data_md5 FROM enc"),
    "rle_encode_dense": (MIXED, "SELECT * REPLACE (CASE WHEN error IS NULL THEN data_hex ELSE '' END AS data_hex, coalesce(error, '') AS error) FROM mixed"),
    "rle_encode_dense_arrow": (MIXED, "SELECT * REPLACE (CASE WHEN error IS NULL THEN data_hex ELSE '' END AS data_hex, coalesce(error, '') AS error) FROM mixed"),
    "rle_decode_dense": (BROKEN, "SELECT image_id, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN width ELSE 0 END AS width, CASE WHEN error IS NULL THEN height ELSE 0 END AS height, CASE WHEN error IS NULL THEN data_hex ELSE '' END AS data_hex FROM broken"),
    "rle_decode_dense_arrow": (BROKEN, "SELECT image_id, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN width ELSE 0 END AS width, CASE WHEN error IS NULL THEN height ELSE 0 END AS height, CASE WHEN error IS NULL THEN data_hex ELSE '' END AS data_hex FROM broken"),
    "rle_size_ratio": (f"{F2}, {runs('f2')}", "SELECT image_id, width * height AS n_pixels, length(data_hex) // 2 AS n_bytes FROM enc"),
    "rle_row_budget": (f"{F2}, {runs('f2')}", "SELECT image_id, y, length(line) // 2 AS n_bytes, width, length(line) // 2 <= width AS fits FROM lines"),
    "rle_tokenize": (f"{BOTH}, {runs('both_')}", "SELECT * FROM runs"),
    "rle_decode": (BOTH, "SELECT * FROM both_"),
    "rle_row_widths": (BROKEN, """SELECT image_id, CASE WHEN image_id % 11 = 0 THEN 1 ELSE height + (image_id % 5 = 0)::INTEGER END AS height,
  CASE WHEN image_id % 11 = 0 THEN 0 WHEN image_id % 5 = 0 THEN 1 ELSE width END AS narrowest, CASE WHEN image_id % 11 = 0 THEN 0 ELSE width END AS widest, image_id % 11 = 0 OR image_id % 5 <> 0 AS consistent FROM broken"""),
    "rgba_histogram": (F3, "SELECT * FROM h3"),
    "color_nibbles": (F5, f"SELECT *, {_nib} FROM h5"),
    "color_distance": (F3, "SELECT image_id, y, x, (r - lr) * (r - lr) + (g - lg) * (g - lg) + (b - lb) * (b - lb) + 3 * (a - la) * (a - la) AS distance FROM (SELECT *, "
      + ", ".join(f"coalesce(lag({c}) OVER line, {c}) AS l{c}" for c in "rgba") + " FROM f3 WINDOW line AS (PARTITION BY image_id, y ORDER BY x))"),
    "palette_nearest": (f"{F5}, {tree('h5', 16)}", f"SELECT h.*, p.pid, {_far} AS distance FROM h5 h JOIN pal p USING (image_id) QUALIFY row_number() OVER (PARTITION BY h.image_id, h.r, h.g, h.b, h.a ORDER BY {_far}, p.pid) = 1"),
    "layout_validate_masks": (F6, "SELECT layout_id, seq, xp + w <= 48 AND yp + h <= 80 AS valid FROM f6"),
    "layout_screen": (F6, "SELECT * FROM scr"),
    "layout_changed": (F6, "SELECT layout_id, seq, bool_or(first) AS changed FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, y, x ORDER BY seq) = 1 AS first FROM mp) GROUP BY 1, 2"),
    "layout_container": (BOXES, "SELECT * FROM box"),
    "layout_raw_container": (BOXES, "SELECT l.layout_id, coalesce(x1, -1) AS x1, coalesce(y1, -1) AS y1, coalesce(x2, -1) AS x2, coalesce(y2, -1) AS y2 FROM (SELECT n_nationkey AS layout_id FROM nation UNION ALL SELECT n_nationkey - 1000 FROM nation) l LEFT JOIN box ON box.layout_id = l.layout_id"),
    "layout_container_history": (HISTORY, "SELECT * FROM g3"),
    "layout_extended": (BOXES, "SELECT * FROM ext"),
    "layout_candidates": (CUTS, "SELECT * FROM cand"),
    "layout_best_split": (CUTS, "SELECT * FROM best"),
    "layout_find": (CUTS, f"SELECT box.layout_id, {_outer}, {_rel}, coalesce(1 - axis_rank, -1) AS flag FROM box JOIN ext USING (layout_id) LEFT JOIN best USING (layout_id)"),
    "hextree_levels": (f"{F3}, {tree('h3', 64)}", "SELECT * FROM nodes"),
    "hextree_level_counts": (f"{F3}, {tree('h3', 64)}", "SELECT * FROM sizes"),
    "hextree_fold": (f"{F3}, {tree('h3', 64)}", "SELECT * FROM fold"),
    "hextree_palette": (f"{F3}, {tree('h3', 64)}", "SELECT * FROM pal"),
    "hextree_index": (f"{F3}, {tree('h3', 64)}", "SELECT * FROM cidx"),
    "hextree_quantize": (f"{F3}, {tree('h3', 64)}", "SELECT * FROM f3n JOIN cidx USING (image_id, r, g, b, a)"),
    "hextree_quantize_bitmap": (f"{F3}, {tree('h3', 64)}", "SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, string_agg(printf('%02X', pid), '' ORDER BY y, x) AS data_hex, '' AS error FROM f3n JOIN cidx USING (image_id, r, g, b, a) GROUP BY 1"),
    "hextree_quantize_palette": (f"{F3}, {tree('h3', 64)}", "SELECT image_id, pid, r, g, b, a FROM pal"),
    "utc_cluster_stats": (f"{M0}, {stats(0)}", "SELECT * FROM st0"),
    "utc_split_choice": (f"{M0}, {stats(0)}, {split(0)}, {stats(1)}", "SELECT image_id, cid FROM ch1"),
    "utc_first_split": (f"{M0}, {stats(0)}, {split(0)}", "SELECT * FROM m1"),
    "utc_palette_k8": (f"{SEVEN}, {stats(7)}", "SELECT image_id, cid AS pid, mr AS r, mg AS g, mb AS b, ma AS a, weight AS n FROM st7"),
    "utc_index_k8": (SEVEN, "SELECT *, cid AS pid FROM m7"),
}


def oracle_sql() -> dict[str, str]:
    def typed(name: str, tables: str, rows: str) -> str:
        columns = ", ".join(f"{c}::{SQL_TYPES[t]} AS {c}" for c, t in pairs(name))
        return f"WITH {tables}\nSELECT {columns} FROM ({rows})"

    return {name: typed(name, *x) for name, x in SOURCES.items()}
