"""DuckDB SQL of the queries that SQL can express, over the same whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS spread FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM s),
w AS (SELECT *, [3, 1, 2][(ordinal % 3) + 1] AS weight FROM o),
f AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY source_size / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - CAST(capped AS DOUBLE) * 2) / CAST(open AS DOUBLE) AS level FROM f),
m AS (SELECT arg_min(level, (source_size / weight, ordinal)) AS level FROM l WHERE level * weight <= source_size * 2),
t AS (SELECT source, source_size, ordinal, coalesce(least(CAST(source_size * 2 AS DOUBLE), m.level * weight), CAST(source_size * 2 AS DOUBLE)) AS target FROM l LEFT JOIN m ON true),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY spread, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN a = b THEN u ELSE (sqrt(a * a + (b * b - a * a) * u) - a) / (b - a) END END AS position
FROM (SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) + greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - start)) AS BIGINT) AS taken,
    CASE WHEN target > 0 THEN least(1.0::DOUBLE, CAST(start AS DOUBLE) / target) END AS u, ([1.5, 0.5, 1.0]::DOUBLE[])[(ordinal % 3) + 1] AS a, ([0.5, 1.5, 1.0]::DOUBLE[])[(ordinal % 3) + 1] AS b
    FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 90 * (nx.n + ny.n - common)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(v, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(root) AS root FROM r GROUP BY v) m ON m.v = d.doc_id
"""

OP10 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM win JOIN least USING (s) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS text, count(*) AS n FROM word LEFT JOIN cov ON cov.doc_id = word.doc_id AND cov.p = word.p WHERE cov.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

# the texts of conversation -1 and the marks of a turn, 24 characters beside its role and text
OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) AS head, replace(replace(text, '\', '\\'), '<|', '<\|') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# base32 of the 160 bits of a digest, five at a time from its hex digits
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
r AS (SELECT page_id, html, hex, first, coalesce(page_id > first, first IS NOT NULL) AS later FROM p JOIN f USING (hex))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda k:
        (((instr('0123456789abcdef', substr(hex, (c * 5 + k) // 4 + 1, 1)) - 1) >> (3 - (c * 5 + k) % 4)) & 1) << (4 - k))) AS INT), 1)), '') AS payload_digest,
    CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN first END AS refers_to, true AS complete
FROM r
"""

# the checksum of a text's bytes, by a table of 256 values that the polynomial makes
CRC = """crc_table AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(range(0, 8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), CAST(x AS BIGINT))) AS crc_of)"""


def crc32(text: str) -> str:
    """SQL for the unsigned checksum of a text, where ``crc_of`` is the table."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))"
    return f"(xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_of[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295))"


OP12 = rf"""
WITH RECURSIVE {CRC},
t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, n FROM r),
h AS (SELECT run, n, {crc32("key")} AS h FROM k, crc_table),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1),
w AS (SELECT word, n FROM v WHERE length(word) >= 6 AND n >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
pair AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = cut.rest UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.rest),
best AS (SELECT x, count(*) AS n_near, arg_min(y, (-w.n, y)) AS near, max(w.n) AS near_n FROM pair JOIN w ON w.word = y GROUP BY x),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN best ON x = word),
walk(word, root) AS (SELECT word, word FROM f UNION SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f last ON last.word = walk.root WHERE last.form IS NULL
"""

OP13 = f"""
WITH {CRC},
l AS (SELECT CAST(floor((2 * CAST(floor(100 * amount + 0.5) AS BIGINT) + quantity)::BIGINT // (2 * quantity)::BIGINT) AS BIGINT) AS u, item_id, sale_id, CAST(line_no AS BIGINT) AS line_no,
        concat_ws(',', sale_id, line_no, item_id) AS key FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity >= 1 AND amount IS NOT NULL),
c AS (SELECT l.*, {crc32("key")} AS crc FROM l, crc_table),
i AS (SELECT item_id, row_number() OVER () AS row, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
j AS (SELECT row, c.*, abs(u - p) AS gap FROM i JOIN c ON u BETWEEN p - greatest(10, 2 * p // 1000) AND p + greatest(10, 2 * p // 1000) AND c.item_id IS DISTINCT FROM i.item_id),
s AS (SELECT row, count(*) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(crc) AS BIGINT) AS lines_crc FROM j GROUP BY row),
k AS (SELECT row, gap, u, sale_id, line_no, item_id AS line_item_id, row_number() OVER (PARTITION BY row ORDER BY gap, u, sale_id, line_no, item_id) AS rank FROM j QUALIFY rank <= 5)
SELECT i.item_id, CAST(coalesce(k.rank, 0) AS INT) AS rank, k.gap, k.u, k.sale_id, k.line_no, k.line_item_id,
    coalesce(n_pairs, 0) AS n_pairs, coalesce(s.gap_sum, 0) AS gap_sum, coalesce(s.lines_crc, 0) AS lines_crc
FROM i LEFT JOIN s USING (row) LEFT JOIN k USING (row)
"""

ORACLES = {"op3_chat": OP3, "op7_warc": OP7, "op4_mixing": OP4, "op5_jaccard_join": OP5, "op10_substring_dedup": OP10, "op12_spelling_variants": OP12, "op13_band_join": OP13}
