"""Thin queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers

from quarry.llm import bpe, exact_dedup, html_text, mixing, ngram_join, periodic_runs, prefix_trie, quality_rules, secrets, sharding, token_files, toxicity, weak_quality
from quarry.sources.tables import table


def op1_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxic_passages(documents, toxicity.train(documents, table(spark, sf_dir, "labels"))).drop("passages")


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents")).drop("cls", "root")


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_source_mix(spark, sf_dir):
    return mixing.mix_figures(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.quality_figures(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op7_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_html_text(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_weak_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return weak_quality.quality_scores(documents, weak_quality.train(documents))


def op10_byte_bpe(spark, sf_dir):
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op12_histogram_shards(spark, sf_dir):
    return sharding.shard_figures(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_ngram_jaccard_join, op4_exact_dedup, op5_source_mix, op6_quality_rules, op7_token_files, op8_html_text, op9_weak_quality, op10_byte_bpe, op11_periodic_runs, op12_histogram_shards, op13_prefix_trie)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_sql() -> str:
    """Spans as running lengths of what lies between and in the matches; weak ones need a partner near."""
    S = secrets
    patterns = [("assign", S.ASSIGN, f"length(regexp_extract(m, {_q(S.ASSIGN)}, 2)) >= {S.ASSIGN_LEAST}"), ("access", S.ACCESS, f"length(m) >= {S.ACCESS_LEAST}"), ("hex", S.HEX, f"length(m) >= {S.HEX_LEAST}"), *((k, p, "true") for k, p in S.WEAK)]
    parts = []
    for i, (kind, pattern, test) in enumerate(patterns):
        role, needs = S.ROLE[kind], S.NEEDS.get(kind, ())
        found = f"SELECT doc_id, regexp_extract_all(t, {_q(pattern)}) AS ms, string_split_regex(t, {_q(pattern)}) AS gs FROM docs WHERE regexp_matches(t, {_q(pattern)})"
        flat = f"SELECT doc_id, ms, gs, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM ({found})"
        start = "coalesce(list_sum(list_transform(gs[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0)"
        parts.append(f"SELECT doc_id, {i} AS k, '{kind}' AS kind, '{role}' AS role, {list(needs)!r}::VARCHAR[] AS needs, ({start})::BIGINT AS a, ({start})::BIGINT + length(m) AS z FROM ({flat}) WHERE {test}")
    n = len(S.BASE)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)}),
weak AS (SELECT * FROM found w WHERE k >= {n} AND EXISTS (SELECT 1 FROM found o WHERE o.doc_id = w.doc_id AND list_contains(w.needs, o.role) AND abs(o.a - w.a) <= {S.SCOPE} AND (w.z <= o.a OR o.z <= w.a)) AND NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = w.doc_id AND b.k < {n} AND b.a <= w.a AND w.z <= b.z)),
kept AS (SELECT * FROM found WHERE k < {n} UNION ALL SELECT * FROM weak),
sums AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < {n}), '') AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, z, k) AS spans, count(*) FILTER (k >= {n}) AS n_weak FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak FROM docs LEFT JOIN sums USING (doc_id)"""


DEDUP_SQL = r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""


def _rules_sql() -> str:
    """Places in repeats of n words or more are the places in windows of n words that occur twice."""
    R = quality_rules
    grams = lambda n: f"SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g FROM places) WHERE i + {n} <= n) WHERE c > 1"
    cover = lambda n: f"SELECT doc_id, count(DISTINCT i + k) AS n FROM ({grams(n)}), range({n}) r(k) GROUP BY doc_id"
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w), c3 AS ({cover(R.WINDOW)}), c5 AS ({cover(R.REPEAT)}), long AS (SELECT DISTINCT doc_id, true AS is_long FROM ({grams(R.LONGEST + 1)})),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(c5.n, 0) AS n_covered, coalesce(is_long, false) AS is_long FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, n_words < {R.MIN_WORDS} OR 100 * n_repeat_words > {R.MAX_REPEAT_PERCENT} * n_words AS base_failed, NOT (n_words < {R.MIN_WORDS} OR 100 * n_repeat_words > {R.MAX_REPEAT_PERCENT} * n_words) AND 100 * n_covered <= {R.MAX_COVERED} * n_words AND NOT is_long AS kept FROM f"""


#: The steps of a CRC-32 for each byte, as a list t.
_CRC_STEPS = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t)"


def _crc(text: str) -> str:
    """CRC-32 of a text in UTF-8, where _CRC_STEPS is joined."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda c: ('0x' || c)::BIGINT)), lambda h, c: xor(t[(xor(h, c) & 255) + 1], h >> 8)), 4294967295)"


def _runs_sql() -> str:
    """Equal words p apart, as islands of places on end for each p; of equal stretches the least p."""
    R = periodic_runs
    least = f"greatest({R.LEAST}, {R.PERIODS} * p)"
    return rf"""WITH d AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AS planted, h // 10 AS g FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc("doc_id::VARCHAR")} AS h FROM documents, {_CRC_STEPS})),
w AS (SELECT doc_id, n, i, ws[CASE WHEN planted AND i >= g % n THEN g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) ELSE i END + 1] AS x FROM (SELECT *, unnest(range(n)) AS i FROM d)),
pairs AS (SELECT u.doc_id, u.i, v.i - u.i AS p FROM w u JOIN w v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i WHERE {R.PERIODS} * (v.i - u.i) <= u.n),
stretches AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM pairs) GROUP BY doc_id, p, k HAVING count(*) + p >= {least}),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretches GROUP BY ALL),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, arg_min(length, (-length, start, period)) AS length, arg_min(period, (-length, start, period)) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN best USING (doc_id) LEFT JOIN rest USING (doc_id)"""


def _shards_sql() -> str:
    """For each target the nearest end of a group of keys with the same first digits, of the first depth at which one is
    within the tolerance, else of the last."""
    S = sharding
    depths = [x for x in S.DEPTHS if x <= 2 * S.DIGITS]
    return f"""WITH k AS (SELECT doc_id, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) + 1 AS size, substr(md5(coalesce(text, '')), 1, {S.DIGITS}) || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {S.DIGITS}) AS key FROM documents),
placed AS (SELECT *, sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS below FROM k),
groups AS (SELECT d, min(below) AS low, max(below + size) AS high FROM placed, unnest({depths}) AS u(d) GROUP BY d, substr(key, 1, d)),
targets AS (SELECT s, (SELECT sum(size) FROM k) * s / {S.SHARDS} AS target, {S.TOLERANCE} * (SELECT sum(size) FROM k) / {S.SHARDS} AS near FROM range(1, {S.SHARDS}) AS r(s)),
edges AS (SELECT s, d, near, CASE WHEN target - low <= high - target THEN low ELSE high END AS edge, least(target - low, high - target) AS off FROM targets, groups WHERE low <= target AND target < high),
cuts AS (SELECT s, arg_min(edge, CASE WHEN off <= near THEN d ELSE 1000 - d END) AS edge FROM edges GROUP BY s),
dealt AS (SELECT doc_id, x, size, key, (SELECT count(*) FROM cuts WHERE edge <= below)::INTEGER AS shard FROM placed)
SELECT doc_id, size, {_crc("x")} AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt, {_CRC_STEPS}"""


def _trie_sql() -> str:
    """Nodes are digests of all turns so far; each node counts for all nodes on its least member's path."""
    P = prefix_trie
    return f"""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % {P.SHARED} AS base, {_crc("conv_id::VARCHAR")} % {P.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t), {_CRC_STEPS}),
r AS (SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = base AND t.k < h UNION ALL SELECT c.conv_id, least(h, coalesce(b.n, 0)) + t.k - h, t.role, t.text FROM c JOIN t USING (conv_id) LEFT JOIN (SELECT DISTINCT conv_id, n FROM t) b ON b.conv_id = base WHERE t.k >= h),
p AS (SELECT conv_id, 0 AS depth, 0 AS chars, '' AS key FROM c UNION ALL SELECT conv_id, k + 1, length(text), sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY k)) FROM r),
q AS (SELECT *, lag(key) OVER w AS parent, lead(key) OVER w IS NULL AS is_end FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end) AS ends FROM q GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
sums AS (SELECT q.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * o.chars)::BIGINT AS saved_tokens FROM own o JOIN q ON q.conv_id = o.conv_id AND q.depth <= o.depth GROUP BY q.key)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256 FROM own o JOIN sums USING (key) LEFT JOIN nodes u ON u.key = o.parent"""


#: The others have no SQL: what they compute is compared with brute force, library encoders or held-out labels in tests.
ORACLE_SQL = {"op1_secret_scan": _secret_sql(), "op4_exact_dedup": DEDUP_SQL, "op6_quality_rules": _rules_sql(), "op11_periodic_runs": _runs_sql(), "op12_histogram_shards": _shards_sql(), "op13_prefix_trie": _trie_sql()}
