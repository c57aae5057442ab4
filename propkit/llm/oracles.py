"""DuckDB SQL for the queries that SQL can express on whole tables."""

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
c(d, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.d WHERE c.r < l.b)
SELECT n.doc_id, n.n AS n_shingles, least(min(r), n.doc_id) AS component_id, least(min(r), n.doc_id) = n.doc_id AS kept
FROM n JOIN c ON c.d = n.doc_id GROUP BY n.doc_id, n.n
"""

OP1 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size,
    ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(cap) OVER o - cap AS below, sum(w) OVER (ORDER BY cap / w DESC, source DESC NULLS FIRST) AS free,
    (SELECT 1.5::DOUBLE * sum(source_size) FROM s0) AS budget FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
lv AS (SELECT max((budget - below) / free) AS level FROM s2),
s3 AS (SELECT *, least(w * level, cap) AS target FROM s2, lv),
s AS (SELECT source, source_size, target, least(round(target), cap)::BIGINT AS words FROM s3),
n AS (SELECT greatest(1, floor(sqrt(count(*))))::BIGINT AS n FROM d),
t AS (SELECT d.*, s.source_size, s.target, s.words, sum(size) OVER (PARTITION BY d.source ORDER BY k % n.n, k, doc_id, size
    ROWS UNBOUNDED PRECEDING) - size AS p FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, n)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  (greatest(0, least(p + size, words) - p) + greatest(0, least(source_size + p + size, words) - source_size - p))::BIGINT AS taken FROM t
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {ASCII_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

def _jump(shards: int) -> str:
    """The shard of ``doc_id`` by unrolled jumps in 128-bit arithmetic."""
    steps = ["j0 AS (SELECT doc_id, (CASE WHEN doc_id IS NULL THEN 18446744073709551615 WHEN doc_id < 0 THEN 18446744073709551616 + doc_id::HUGEINT"
             " ELSE doc_id END)::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM documents)"]
    for i in range(1, shards + 1):
        steps.append(f"h{i} AS (SELECT *, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS q FROM j{i - 1})")
        steps.append(f"j{i} AS (SELECT doc_id, CASE WHEN j < {shards} THEN q ELSE k END AS k, CASE WHEN j < {shards} THEN j ELSE b END AS b,"
                     f" CASE WHEN j < {shards} THEN floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((q // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT ELSE j END AS j FROM h{i})")
    return f"(WITH {', '.join(steps)} SELECT DISTINCT doc_id, b::INTEGER AS shard FROM j{shards})"



#: The 256 steps of the CRC-32 with the reversed polynomial 0xEDB88320, as a one-row table.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) AS crc_t FROM range(256) r(i))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 text; ``crc_t`` of ``CRC_TABLE`` has to be in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({text}))), "
            f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)), "
            "lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295)")


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _repair_step() -> dict[str, str]:
    """The cheapest (cost, audit, rows) of each state before a row, from those behind it."""
    put = lambda cost, edit, line, x: f"{{'c': {x}.c + {cost}, 'a': '{edit}' || {x}.a, 'r': {line}}}"
    row = lambda role, x: f"list_prepend({role} || ':' || text, {x}.r)"
    bad = "{'c': 9223372036854775::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    delete = lambda x: put(3, "D", f"{x}.r", x)
    live = lambda x, role: (
        f"CASE WHEN fault IN ('b', 'd') THEN {bad} ELSE {put('2 + late', 'R', row(repr(role), x), x)} END, "
        f"CASE WHEN fault IN ('b', 'd') OR ini <> '{role[0]}' THEN {bad} ELSE {put('late', 'K', row('role', x), x)} END")
    system = f"CASE WHEN fault IN ('b', 'd') OR ini <> 's' THEN {bad} ELSE {put('late', 'K', row('role', 'x1'), 'x1')} END"
    base = {"b0": _best(delete("x0"), live("x2", "user"), system), "b1": _best(delete("x1"), live("x2", "user")),
            "b2": _best(delete("x2"), live("x3", "assistant")), "b3": _best(delete("x3"), live("x2", "user"))}
    add = lambda role, x: put(2, "I", f"list_prepend('{role}:', {x}.r)", x)
    m2 = _best("b2", add("assistant", "b3"))
    return base | {"m2": m2, "m3": _best("b3", add("user", "b2")), "m0": _best("b0", add("user", "m2")), "m1": _best("b1", add("user", "m2"))}


_S = _repair_step()
OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
m AS (SELECT o.*, {crc32("k")} % 20 AS m FROM o, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN m = 3 THEN [1, 2] ELSE [1] END) AS copy FROM m WHERE m <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN seen THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS prev FROM n),
s AS (SELECT conv_id, (max(turn) - min(turn) + 1 - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS len FROM f GROUP BY conv_id),
g AS (SELECT f.*, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS late FROM f),
dp(conv_id, p, x0, x1, x2, x3) AS (
  SELECT conv_id, len + 1, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}}, {{'c': 4::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}},
    {{'c': 2::BIGINT, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} FROM s
  UNION ALL
  SELECT conv_id, p, m0, m1, m2, m3 FROM (SELECT *, {_S["m0"]} AS m0, {_S["m1"]} AS m1 FROM (SELECT *, {_S["m2"]} AS m2, {_S["m3"]} AS m3 FROM (
    SELECT dp.conv_id, g.p, {_S["b0"]} AS b0, {_S["b1"]} AS b1, {_S["b2"]} AS b2, {_S["b3"]} AS b3
    FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.p = dp.p - 1)))),
e AS (SELECT conv_id, x0 FROM dp WHERE p = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.x0.c, 0) AS cost, coalesce(e.x0.a, '') AS audit, sha256(coalesce(array_to_string(e.x0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
c AS (SELECT doc_id, {ASCII_LOWER.format("w")} AS w, count(*) AS k FROM r WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT c.*, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM c, crc_table),
f AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM f WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
y AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM x),
p AS (SELECT a.word, b.word AS o, b.n AS m FROM y a JOIN y b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM y a JOIN v b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM y a JOIN v b ON a.d = b.word),
g AS (SELECT word, count(*) AS n_near, list_sort(list({{'m': -m, 'w': o}}))[1] AS best FROM p GROUP BY word),
z AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * v.n THEN best.w END AS form, CASE WHEN -best.m >= 10 * v.n THEN -best.m END AS form_n
  FROM v LEFT JOIN g USING (word)),
t(word, root, step) AS (SELECT word, word, 0 FROM z UNION ALL SELECT t.word, z.form, step + 1 FROM t JOIN z ON z.word = t.root WHERE z.form IS NOT NULL)
SELECT z.word, form, arg_max(root, step) AS root, n, n_near, form_n FROM z JOIN t USING (word) GROUP BY z.word, form, n, n_near, form_n
"""


OP2 = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, CASE WHEN text IS NULL THEN 0 ELSE {crc32("coalesce(text, '')")} END AS text_crc32,
  ('0x' || substr(md5(coalesce(doc_id, -1)::VARCHAR), 1, 15))::BIGINT AS k FROM documents, crc_table),
n AS (SELECT greatest(1, floor(sqrt(count(*))))::BIGINT AS n FROM d),
s AS (SELECT d.*, a.shard, b.shard AS grown_shard FROM d JOIN {_jump(8)} a ON a.doc_id IS NOT DISTINCT FROM d.doc_id JOIN {_jump(9)} b ON b.doc_id IS NOT DISTINCT FROM d.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k % n.n, k, coalesce(doc_id, -1), text_crc32, size) - 1 AS slot,
  grown_shard FROM s, n
"""


ORACLES = {"op1_mixing": OP1, "op2_sharding": OP2, "op7_minhash_near_dedup": OP7, "op9_exact_dedup": OP9, "op11_conversation_repair": OP11, "op12_spelling_variants": OP12}
