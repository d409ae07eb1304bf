"""DuckDB SQL of the llm queries that SQL can express. The others have brute-force tests."""

from __future__ import annotations

from .hilbert import SHARDS, curve
from .mixing import CAP, SHARE_PCT, WEIGHTS
from .spelling import DROP, FORM_FACTOR, MIN_COUNT, MIN_LENGTH

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return "[" + ", ".join(f"{x}::BIGINT" for x in out) + "]"


#: CRC-32 of UTF-8 text, byte by byte over its hex form.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({t})), lambda i: ('0x' || substr(hex(encode({t})), 2 * i + 1, 2))::BIGINT)),"
    " lambda acc, b: xor(tab[xor(acc & 255, b) + 1], acc >> 8)), 4294967295::BIGINT)"
)


HILBERT = f"""WITH tab AS (SELECT {_crc_table()} AS tab, {curve()} AS curve),
sq AS (SELECT s AS sv, (row_number() OVER (ORDER BY s) - 1) * 16 // count(*) OVER () AS a FROM (SELECT DISTINCT coalesce(source, '') AS s FROM documents)),
lq AS (SELECT s AS lv, (row_number() OVER (ORDER BY s) - 1) * 16 // count(*) OVER () AS b FROM (SELECT DISTINCT coalesce(lang, '') AS s FROM documents)),
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, a, b FROM documents JOIN sq ON sv = coalesce(source, '') JOIN lq ON lv = coalesce(lang, '')),
c AS (SELECT doc_id, size, CAST({CRC32.format(t='t')} AS BIGINT) AS text_crc32, curve[a * 256 + b * 16 + greatest(0, least(15, length(bin(size)) - 4)) + 1] AS hilbert FROM d, tab),
k AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32), 1, 12))::BIGINT AS tie FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY hilbert, tie, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER () AS total FROM k),
s AS (SELECT *, CAST(rank * {SHARDS} // total AS INT) AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard, CAST(rank - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, CAST(hilbert AS INT) AS hilbert FROM s"""

MIX = f"""WITH d AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS marks,
 (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS DOUBLE) + 1) / 281474976710656.0::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.25::DOUBLE, CAST(size AS DOUBLE) / (CAST(size + marks AS DOUBLE) + 1e-9::DOUBLE)) AS k FROM d),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % {len(WEIGHTS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(WEIGHTS))} END AS weight FROM g),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank) AS place, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fullsum, sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
m AS (SELECT *, CAST(2 * {SHARE_PCT} * total AS DOUBLE) / 100 - CAST(2 * {CAP} * fullsum AS DOUBLE) AS left2 FROM l),
e AS (SELECT min(place) AS ends FROM m WHERE left2 * weight <= 2 * {CAP} * source_size * rest),
v AS (SELECT left2 AS l2, rest AS r FROM m, e WHERE place = ends),
t AS (SELECT source, source_size, CASE WHEN place < ends THEN CAST({CAP} * source_size AS DOUBLE) ELSE weight * l2 / CAST(2 * r AS DOUBLE) END AS target FROM m, e, v),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
 CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target / t.source_size) AS BIGINT) END AS epochs FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * ahead + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VARIANTS = f"""WITH RECURSIVE tab AS (SELECT {_crc_table()} AS tab),
raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(run, '{_CAPITALS}', '{_CAPITALS.lower()}') AS run, count(*) AS n FROM raw GROUP BY ALL HAVING length(run) >= {MIN_LENGTH}),
h AS (SELECT run, n, CAST({CRC32.format(t='(id || run)')} AS BIGINT) AS h FROM r, tab),
w AS (SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
e AS (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (SELECT e.word, v.word AS other FROM e JOIN v ON v.word = e.rest UNION SELECT v.word, e.word FROM e JOIN v ON v.word = e.rest
 UNION SELECT a.word, b.word FROM e a JOIN e b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS other, max(v.n) AS other_n FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FORM_FACTOR} * v.n THEN other END AS form, CASE WHEN other_n >= {FORM_FACTOR} * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.at WHERE g.form IS NULL"""


def _leaf(text: str) -> str:
    parts = (f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "src.source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, rows: str) -> str:
    """A tree over (g, j, h, n) in `rows`, its nodes with their siblings."""
    side = "coalesce(string_agg(h, '') OVER (PARTITION BY g, level, j // 3 ORDER BY j ROWS BETWEEN {}), '')"
    return f"""{name} AS (SELECT g, 0 AS level, j, h, n FROM {rows} UNION ALL SELECT g, level + 1, j // 3, sha256(string_agg(h, '' ORDER BY j)), max((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY g, level, j // 3),
{name}_sides AS (SELECT g, level, j, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS behind FROM {name} WHERE n > 1)"""


def _climb(name: str, start: str, tree: str) -> str:
    return f"""{name} AS ({start} UNION ALL SELECT row, p.g, p.level + 1, p.j // 3, sha256(before || x || behind), proof || before || behind FROM {name} p JOIN {tree}_sides s ON s.g = p.g AND s.level = p.level AND s.j = p.j)"""


MERKLE = f"""WITH RECURSIVE tab AS (SELECT {_crc_table()} AS tab),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
cut AS (SELECT *, CASE WHEN {CRC32.format(t='CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut_text FROM documents, tab),
d AS (SELECT row_number() OVER () AS row, g, doc_id, {_leaf('text')} AS leaf,
 {_leaf('cut_text')} AS told FROM cut JOIN src ON src.source IS NOT DISTINCT FROM cut.source),
own AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree('low', 'own')},
subs AS (SELECT 0 AS g, g AS j, h, (SELECT count(*) FROM src) AS n FROM low WHERE n = 1),
{_tree('high', 'subs')},
{_climb('one', "SELECT row, g, 0 AS level, j, told AS x, '' AS proof FROM own", 'low')},
met AS (SELECT row, 0 AS g, 0 AS level, g AS j, x, proof FROM one p WHERE NOT EXISTS (SELECT 1 FROM low_sides s WHERE s.g = p.g AND s.level = p.level AND s.j = p.j)),
{_climb('two', 'SELECT row, g, level, j, x, proof FROM met', 'high')},
ends AS (SELECT row, x, proof FROM two p WHERE NOT EXISTS (SELECT 1 FROM high_sides s WHERE s.level = p.level AND s.j = p.j))
SELECT doc_id, leaf, subs.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = top.h AS verified
FROM own JOIN ends USING (row) JOIN subs ON subs.j = own.g JOIN high top ON top.n = 1"""

ORACLES: dict[str, str] = {"op2_hilbert_shards": HILBERT, "op7_source_mix": MIX, "op11_spelling_variants": VARIANTS, "op13_merkle_manifest": MERKLE}
