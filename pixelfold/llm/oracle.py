"""SQL for DuckDB with the results of those operators that SQL can express.

Tokenizers and trained models (2, 4, 6, 7's expressions, 8, 10 and the pipeline) have no SQL; their
tests compare them with the libraries, brute force or held-out labels.
"""

from __future__ import annotations

from . import quality_rules as rules
from . import sharding

SHARDS = 24


def crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes; ``crc_table`` must be joined."""
    hexed = f"hex(encode({text}))"
    bytes_ = f"list_transform(regexp_extract_all({hexed}, '..'), lambda h: ('0x' || h)::BIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    return f"(CASE WHEN coalesce({text}, '') = '' THEN 0 ELSE xor({fold}, 4294967295::BIGINT) END)::BIGINT"


#: The remainders of all bytes, bit by bit.
CRC_TABLE = (
    "b0 AS (SELECT i AS n, i::BIGINT AS v FROM range(256) r(i))"
    + "".join(f", b{k + 1} AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END AS v FROM b{k})" for k in range(8))
    + ", crc_table AS (SELECT list(v ORDER BY n) AS t FROM b8)"
)


def _draw(s: int) -> str:
    start = 1 + sharding.DIGITS * (s % 2)
    return f"1.0::DOUBLE / -ln((('0x' || md5(doc_id::VARCHAR || ':{s // 2}')[{start}:{start + sharding.DIGITS - 1}])::BIGINT + 0.5::DOUBLE) / {float(16**sharding.DIGITS)}::DOUBLE)"


OP1 = f"""WITH {CRC_TABLE},
sized AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, {crc32("text")} AS text_crc32 FROM documents, crc_table),
drawn AS (SELECT *, [{", ".join(_draw(s) for s in range(SHARDS + 1))}] AS scores FROM sized),
placed AS (SELECT *, list_position(scores[1:{SHARDS}], list_max(scores[1:{SHARDS}])) - 1 AS shard, list_position(scores, list_max(scores)) - 1 AS grown_shard,
  (('0x' || md5(doc_id::VARCHAR || ':slot')[1:7])::BIGINT + text_crc32) % {sharding.BUCKETS} AS bucket FROM drawn)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard FROM placed"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id))::INTEGER AS rank,
  c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""

_UPPER = "".join(map(chr, range(65, 91)))
OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS both_ FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * both_ >= 90 * (nx + ny - both_)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY 1) m ON m.x = s.doc_id"""


def _chain() -> str:
    """The estimates of the quality rules, step after step."""
    group = "g_lang, g_source"
    same = "m.g_lang IS NOT DISTINCT FROM s.g_lang AND m.g_source IS NOT DISTINCT FROM s.g_source"

    def nested(source: str, steps: list[tuple[str, str]]) -> str:
        for name, expression in steps:
            source = f"(SELECT *, {expression} AS {name} FROM {source})"
        return source

    def medians(name: str, source: str, of: dict[str, str]) -> list[str]:
        values = " UNION ALL ".join(f"SELECT {group}, '{n}' AS i, {x} AS v FROM {source}" for n, x in of.items())
        least = ", ".join(f"min(v) FILTER (i = '{n}') AS {n}" for n in of)
        return [
            f"{name}_k AS (SELECT *, sum(k) OVER (PARTITION BY {group}, i ORDER BY v) AS below, sum(k) OVER (PARTITION BY {group}, i) AS n FROM (SELECT {group}, i, v, count(*) AS k FROM ({values}) GROUP BY ALL))",
            f"{name} AS (SELECT {group}, {least}, max(n) AS rows FROM {name}_k WHERE below * 2 >= n GROUP BY {group})",
        ]

    factor = ", ".join((f"greatest({rules.LEAST}::DOUBLE, {rules.SPREAD}::DOUBLE * mad_{rules.Z[i]})" if i == j else "0::DOUBLE") + f" AS l{i}{j}" for j in range(4) for i in range(j, 4))
    out = [
        *medians("centres", "shares", {f"med_{t}": t for t in rules.T}),
        f"passed AS (SELECT s.g_lang, s.g_source, {', '.join(f'{x} AS {z}' for z, x in rules.CENTRED.items())} FROM shares s JOIN centres m ON {same})",
        *medians("spreads", "passed", {f"mad_{z}": f"abs({z})" for z in rules.Z}),
        f"medians AS (SELECT {group}, {', '.join(f'0::DOUBLE AS {m}' for m in rules.MEAN)}, {factor}, rows FROM spreads)",
    ]
    sums = rules.moment_sums()
    kept = ", ".join([*rules.MEAN, *rules.FACTOR])
    moments, shaped = ", ".join(f"{x} AS {n}" for n, x in sums.items()), ", ".join(f"{x} AS {n}" for n, x in rules.covariance().items())
    out += [
        f"halves AS (SELECT {group}, 2 + {rules.HALF} AS start, count(*) AS n, {moments} FROM passed GROUP BY ALL UNION ALL SELECT {group}, 1, count(*), {', '.join(sums.values())} FROM passed GROUP BY ALL)",
        f"shapes AS (SELECT {group}, start, 0 AS rows, {shaped} FROM (SELECT * REPLACE ({', '.join(f'{n}::DOUBLE AS {n}' for n in sums)}) FROM halves))",
        f"e0 AS (SELECT {group}, 0 AS start, {kept}, rows FROM medians UNION ALL SELECT {group}, start, {kept}, rows FROM {nested('shapes', rules.cholesky())})",
    ]
    each = f"{group}, start"
    for k in range(rules.STEPS):
        out += [
            f"d{k} AS (SELECT *, least(floor(d2 / {rules.BIN}), {rules.LAST_BIN}) AS bin FROM {nested(f'(SELECT s.*, m.* EXCLUDE (g_lang, g_source, rows) FROM passed s JOIN e{k} m ON {same})', rules.distance())})",
            f"n{k} AS (SELECT *, sum(k) OVER (PARTITION BY {each} ORDER BY bin) - k AS before, sum(k) OVER (PARTITION BY {each}) AS rows FROM (SELECT {each}, bin, count(*) AS k, {moments} FROM d{k} GROUP BY ALL))",
            f"t{k} AS (SELECT {each}, sum(k) AS n, any_value(rows) AS rows, {', '.join(f'sum({n})::DOUBLE AS {n}' for n in sums)} FROM n{k} WHERE before < {rules.NEAREST} * rows GROUP BY {each})",
            f"c{k} AS (SELECT {each}, rows, {shaped} FROM t{k})",
            f"e{k + 1} AS (SELECT {each}, {kept}, rows FROM {nested(f'c{k}', rules.cholesky())})",
        ]
    out.append(f"best AS (SELECT * EXCLUDE (start) FROM e{rules.STEPS} QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY {rules.DETERMINANT}, start) = 1)")
    fitted = f"(SELECT m.*, {', '.join(f'med_{t}' for t in rules.T)} FROM best m JOIN centres s ON {same})"
    last = f"(SELECT s.*, m.* EXCLUDE (g_lang, g_source) FROM grouped s LEFT JOIN {fitted} m ON {same})"
    out.append(f"judged AS (SELECT *, NOT base_failed AND NOT coalesce(rows >= {rules.FEW} AND d2 > {rules.CUTOFF}, false) AS kept FROM {nested(last, [*rules.CENTRED.items(), *rules.distance()])})")
    return ",\n".join(out)


OP5 = f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) >= 5),
rep AS (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM rep GROUP BY 1),
lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
counts AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(w, lambda x: length(x) <= {rules.SHORT})) AS n_short, len(list_filter(w, lambda x: regexp_matches(x, '{rules.MARK}'))) AS n_marked,
  len(list_filter(w, lambda x: regexp_matches(x, '{rules.CAPITAL}'))) AS n_capital, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_again, coalesce(cov.n, 0) AS n_repeat_words FROM lines LEFT JOIN cov USING (doc_id)),
made AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in rules.STATISTICS.items())} FROM counts),
vectors AS (SELECT DISTINCT lang, source, n_words, word_chars, {", ".join(rules.T)} FROM made WHERE NOT base_failed),
sizes AS (SELECT *, CASE WHEN k >= {rules.SMALL} THEN coalesce(lang, '') END AS g_lang, CASE WHEN k >= {rules.SMALL} THEN coalesce(source, '') END AS g_source
  FROM (SELECT lang, source, count(*) AS k FROM vectors GROUP BY ALL)),
grouped AS (SELECT m.*, g_lang, g_source FROM made m LEFT JOIN sizes s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source),
shares AS (SELECT g_lang, g_source, n_words, {", ".join(rules.T)} FROM vectors m JOIN sizes s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source),
{_chain()}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1, "op3_exact_top_k": OP3, "op5_quality_rules": OP5, "op9_jaccard_join": OP9}
