"""SQL that gives the same rows as the queries of the same name, over the driver's views."""

from __future__ import annotations

from stratapack.functions import classify, hashing
from stratapack.plans import queries as q
from stratapack.sources import views

DOC_PATH = "'documents/' || lang || '/' || source || '/' || doc_id || '.txt'"
DOC_FILES = f"SELECT doc_id * 2 AS file_id, {DOC_PATH} AS path, text AS body FROM documents"
PAGE_FILES = "SELECT page_id * 2 + 1 AS file_id, 'pages/' || page_id || '.html' AS path, html AS body FROM pages"
ALL_FILES = f"{DOC_FILES} UNION ALL {PAGE_FILES}"
PRINTABLE = r"length(regexp_replace({0}, '[^\x20-\x7e\n\r\t]', '', 'g'))"
IS_TEXT = f"strlen({{0}}) > 0 AND (100 * {PRINTABLE}) // greatest(strlen({{0}}), 1) >= 85"
FIRST = "SELECT doc_id, source, strlen(text) AS size, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents"
EXT = r"lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+(\.[^.]*)$', 1))"
TOKENS = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{4,}')) AS token FROM documents),
s AS (SELECT doc_id, token, count(*) AS n, count(*) * (length(token) - 2) AS saving FROM t GROUP BY doc_id, token),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY saving DESC, length(token) DESC, token) AS rank FROM s WHERE n > 1 AND saving > length(token))
"""
BYTES = "SELECT {0}, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents"


def values(names: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + n.replace("'", "''") + "')" for n in names) + ")"


def _in(exts: list[str]) -> str:
    return "(" + ", ".join(f"'{e}'" for e in exts) + ")"


def _probes() -> str:
    return "(VALUES " + ", ".join(f"('{n}', '{h.upper()}')" for n, h in views.PROBES) + ") AS p(path, h)"


RAW_MAGIC = " OR ".join(f"starts_with(h, '{m}')" for m in classify.RAW_MAGICS)
PROBED = f"""
WITH e AS (SELECT path, h, length(h) // 2 AS n, {EXT.format("path")} AS ext FROM {_probes()}),
f AS (SELECT *, ext IN {_in(classify.RAW_EXTENSIONS)} OR {RAW_MAGIC} OR (n >= 12 AND (substr(h, 9, 8) = '66747970' OR (starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250'))) AS raw,
    len(list_filter(regexp_extract_all(h, '..'), lambda x: (x >= '20' AND x <= '7E') OR x IN ('0A', '0D', '09'))) AS printable,
    CASE WHEN starts_with(h, '4D5A') AND n >= 64 THEN ('0x' || substr(h, 127, 2) || substr(h, 125, 2) || substr(h, 123, 2) || substr(h, 121, 2))::BIGINT END AS pe FROM e),
g AS (SELECT *, CASE WHEN pe < n - 5 AND substr(h, 2 * pe + 1, 8) = '50450000' THEN CASE substr(h, 2 * pe + 9, 4) WHEN '4C01' THEN 'x86' WHEN '6486' THEN 'x86' WHEN '64AA' THEN 'arm64' WHEN 'C001' THEN 'arm' WHEN 'C401' THEN 'thumb' END END AS branch,
    n > 0 AND (100 * printable) // greatest(n, 1) >= 85 AS is_text, ext IN {_in(classify.EXECUTABLE_EXTENSIONS)} OR starts_with(h, '4D5A') AS exe, starts_with(h, '1F8B0800') AND n >= 10 AS gz FROM f)
"""
FAST = f"WHEN exe AND branch IS NOT NULL THEN 'branch_' || branch WHEN ext IN {_in(classify.DELTA_EXTENSIONS)} THEN 'delta'"

ARCHIVE_FIRST = f"SELECT file_id, path, min(file_id) OVER (PARTITION BY sha256(body)) AS first_id FROM ({ALL_FILES})"

RUNS = """
WITH d AS (SELECT lang AS dataset, sum(strlen(text))::BIGINT AS raw FROM documents GROUP BY lang),
e AS (SELECT *, row_number() OVER (ORDER BY dataset) AS i FROM d),
t(j, tool) AS (VALUES (1, 'alpha'), (2, 'bravo'), (3, 'charlie'), (4, 'delta'), (5, 'gzip')),
m AS (SELECT *, CASE WHEN tool = 'gzip' THEN 'ok' WHEN (i * 5 + j) % 9 = 0 THEN 'failed' WHEN (i * 5 + j) % 9 = 1 THEN 'skipped' ELSE 'ok' END AS status FROM e, t),
runs AS (SELECT tool, dataset, status, CASE WHEN status = 'ok' THEN (1 + (i * 7 + j * 3) % 5)::DOUBLE END AS seconds, CASE WHEN status = 'ok' THEN raw // (j + 1) END AS archive_size FROM m)
"""
STATUS = "CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN 'partial' ELSE 'failed' END WHEN count(*) FILTER (status = 'ok') > 0 THEN CASE WHEN count(*) FILTER (status = 'skipped') > 0 THEN 'partial' ELSE 'ok' END ELSE 'skipped' END"
SUMS = "coalesce(sum(seconds) FILTER (status = 'ok'), 0.0) AS seconds, coalesce(sum(archive_size) FILTER (status = 'ok'), 0)::BIGINT AS archive_size"
TOTALS = f"SELECT tool, {STATUS} AS status, {SUMS} FROM runs GROUP BY tool"
SCORE = "CASE WHEN {s} > 0 AND {t} > 0 AND {bs} > 0 AND {bt} > 0 AND CASE WHEN {t} > 0 THEN abs(ln({t})) ELSE 0 END > 1e-12 THEN round(({bs} / {s}) * (ln({bt}) / ln({t})), 6) END"


def _score(s: str, t: str, bs: str, bt: str) -> str:
    return SCORE.format(s=s, t=t, bs=bs, bt=bt)


def _fnv_lane(seed: int) -> str:
    """One lane in 128-bit integers, its result's bytes reversed."""
    bytes_ = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::HUGEINT)"
    h = f"list_reduce({bytes_}, lambda a, b: (xor(a, b) * {hashing.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT, {int(seed)}::HUGEINT)"
    return f"lower(array_to_string(list_reverse(regexp_extract_all(lpad(hex(({h})::UBIGINT), 16, '0'), '..')), ''))"


SQL: dict[str, str] = {
    "flagship": f"""
        WITH f AS (SELECT doc_id AS file_id, {DOC_PATH} AS path, strlen(text) AS size, ({IS_TEXT.format("text")}) AS text, sha256(text) AS content_ck, min(doc_id) OVER (PARTITION BY sha256(text)) AS stored_as FROM documents)
        SELECT *, coalesce(sum(CASE WHEN stored_as = file_id THEN size ELSE 0 END) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stored_before FROM f""",
    "scan_canonical_order": f"""
        WITH f AS (SELECT {DOC_PATH} AS path, strlen(text) AS size FROM documents)
        SELECT path, size, row_number() OVER w - 1 AS position, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before
        FROM f WINDOW w AS (ORDER BY translate(path, '{classify.UPPER}', '{classify.LOWER}'), path)""",
    "classify_text": f"SELECT doc_id, strlen(text) AS size, {PRINTABLE.format('text')} AS printable, ({IS_TEXT.format('text')}) AS is_text FROM documents",
    "route_matrix": PROBED
    + f"""SELECT path, ext, raw, branch, CASE WHEN ext IN {_in(classify.EXECUTABLE_EXTENSIONS)} THEN 'executable' ELSE 'compressible' END AS bucket,
        CASE WHEN gz THEN 'gzip' WHEN raw THEN 'stored' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') OR ext IN {_in(classify.JPEG_EXTENSIONS)} THEN 'jpeg' {FAST} WHEN is_text THEN 'dictionary' ELSE 'none' END AS route,
        CASE WHEN gz THEN 'gzip' WHEN raw THEN 'stored' {FAST} ELSE 'none' END AS route_fast FROM g""",
    "route_counts": f"""
        WITH f AS (SELECT path, body, ({IS_TEXT.format("body")}) AS is_text FROM ({ALL_FILES}))
        SELECT {EXT.format("path")} AS ext, CASE WHEN is_text THEN 'dictionary' WHEN strlen(body) > 65536 AND is_text THEN 'chunk' ELSE 'none' END AS route, count(*) AS files, sum(strlen(body))::BIGINT AS bytes FROM f GROUP BY ALL""",
    "extension_stats": f"""
        WITH c AS (SELECT '.md' AS ext, strlen(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS n FROM conversations GROUP BY conv_id),
        f AS (SELECT {EXT.format("path")} AS ext, strlen(body) AS n FROM ({ALL_FILES}) UNION ALL SELECT * FROM c)
        SELECT ext, count(*) AS files, sum(n)::BIGINT AS bytes FROM f GROUP BY ext""",
    "file_dedup": f"SELECT doc_id, first_id, doc_id <> first_id AS is_copy FROM ({FIRST})",
    "dedup_savings": f"SELECT source, count(*) AS files, count(*) FILTER (doc_id <> first_id) AS copies, sum(size)::BIGINT AS bytes, coalesce(sum(size) FILTER (doc_id <> first_id), 0)::BIGINT AS saved FROM ({FIRST}) GROUP BY source",
    "block_dedup": f"""
        WITH b AS (SELECT doc_id, unnest(range(0, greatest((strlen(text) + {q.BLOCK - 1}) // {q.BLOCK}, 1))) AS i, hex(encode(text)) AS h FROM documents),
        c AS (SELECT doc_id, i, substr(h, i * {2 * q.BLOCK} + 1, {2 * q.BLOCK}) AS h FROM b),
        d AS (SELECT doc_id, length(h) // 2 AS size, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) = 1 AS own FROM c)
        SELECT doc_id, count(*) AS blocks, count(*) FILTER (own) AS own_blocks, coalesce(sum(size) FILTER (own), 0)::BIGINT AS own_bytes FROM d GROUP BY doc_id""",
    "token_dictionary": TOKENS + "SELECT doc_id, token, n, saving, rank FROM r WHERE rank <= 16",
    "dictionary_roundtrip": TOKENS
    + ", g AS (SELECT doc_id, sum(saving) AS won FROM r WHERE rank <= 16 GROUP BY doc_id) SELECT doc_id, (strlen(text) - coalesce(won, 0))::BIGINT AS encoded_size, sha256(text) AS restored_sha256 FROM documents LEFT JOIN g USING (doc_id)",
    "gzip_normalize": PROBED + "SELECT path, substr(h, 1, 8) || '000000000000' || substr(h, 21) AS payload, 'gzip:' || lower(substr(h, 9, 12)) AS recipe, h AS restored FROM g WHERE gz",
    "delta_roundtrip": "SELECT 'delta' AS transform, count(*) AS files, count(*) AS restored, sum(4 * len(embedding))::BIGINT AS bytes FROM embeddings",
    "branch_roundtrip": "SELECT transform, count(*) AS files, count(*) AS restored, sum(4 * len(embedding))::BIGINT AS bytes FROM embeddings, (VALUES ('branch_x86'), ('branch_arm64'), ('branch_arm'), ('branch_thumb')) AS t(transform) GROUP BY transform",
    "byte_histogram": f"SELECT lang, ('0x' || h)::BIGINT AS byte, count(*) AS n FROM ({BYTES.format('lang')}) GROUP BY ALL",
    "entropy": f"WITH b AS (SELECT source, h, count(*) AS n FROM ({BYTES.format('source')}) GROUP BY ALL) SELECT source, sum(n)::BIGINT AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM b GROUP BY source",
    "cosine_neighbors": """
        WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY ALL),
        s AS (SELECT vec_id, c.label AS centre, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS s FROM x JOIN c USING (i) GROUP BY ALL)
        SELECT vec_id, arg_max(centre, s)::BIGINT AS nearest_label, round(max(s), 6) AS similarity FROM s GROUP BY vec_id""",
    "similarity_chain": """
        WITH r AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 4096 AS run_no FROM documents)
        SELECT '.txt' AS ext, run_no, count(*) AS items, count(*) AS distinct_items, count(*) AS positions, count(*) - 1 AS last_position FROM r GROUP BY run_no""",
    "solid_groups": f"""
        WITH RECURSIVE i AS (SELECT doc_id, source, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY {DOC_PATH}) - 1 AS place FROM documents),
        j AS (SELECT doc_id, source, size, place // 4096 AS run_no, place % 4096 AS p FROM i),
        f AS (SELECT doc_id, source, size, run_no, p, 0 AS group_no, 0 AS payload_offset, size >= {q.SOLID_CAP} AS alone FROM j WHERE p = 0
            UNION ALL SELECT i.doc_id, i.source, i.size, i.run_no, i.p,
            CASE WHEN f.alone OR i.size >= {q.SOLID_CAP} OR f.payload_offset + f.size + i.size > {q.SOLID_CAP} THEN f.group_no + 1 ELSE f.group_no END,
            CASE WHEN f.alone OR i.size >= {q.SOLID_CAP} OR f.payload_offset + f.size + i.size > {q.SOLID_CAP} THEN 0 ELSE f.payload_offset + f.size END, i.size >= {q.SOLID_CAP}
            FROM f JOIN j AS i ON i.source = f.source AND i.run_no = f.run_no AND i.p = f.p + 1)
        SELECT doc_id, source, run_no, group_no::BIGINT AS group_no, payload_offset::BIGINT AS payload_offset FROM f""",
    "cdc_chunks": f"""
        WITH b AS (SELECT source, doc_id // {views.BUNDLE_SPAN} AS span, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY ALL)
        SELECT 'bundles/' || source || '-' || span || '.txt' AS path, strlen(body) AS size, true AS bounds_hold, sha256(body) AS restored_sha256 FROM b""",
    "block_layout": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS block_no, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS payload_offset FROM ({FIRST}) WHERE doc_id = first_id",
    "codec_best_of_n": f"""
        WITH b AS (SELECT source, doc_id // {views.BUNDLE_SPAN} AS span, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY ALL)
        SELECT 'bundles/' || source || '-' || span || '.txt' AS path, strlen(body) AS raw_size, true AS round_trips, true AS winner_is_least, true AS shrinks FROM b""",
    "codec_selective": f"""
        WITH f AS (SELECT path FROM {_probes()} UNION ALL SELECT path FROM ({ALL_FILES})), e AS (SELECT {EXT.format("path")} AS ext FROM f)
        SELECT ext, CASE WHEN ext IN {_in(classify.STRONGER_EXTENSIONS)} THEN 'lzma' ELSE 'zstd-3' END AS codec, count(*) AS files FROM e GROUP BY ALL""",
    "archive_roundtrip": f"SELECT path, strlen(body) AS size, sha256(body) AS sha256, true AS ok FROM ({ALL_FILES})",
    "archive_verify": f"SELECT count(*) AS files, 0::BIGINT AS bad, sum(strlen(body))::BIGINT AS bytes, 0::BIGINT AS faults, true AS uses_codec FROM ({ALL_FILES})",
    "archive_tamper": f"SELECT path FROM ({ARCHIVE_FIRST}) WHERE first_id % 7 = 0",
    "missing_blocks": f"SELECT DISTINCT 'missing block' AS fault, first_id::VARCHAR AS id FROM ({ARCHIVE_FIRST}) WHERE first_id % 11 = 0",
    "roundtrip_multiset": f"SELECT count(*) AS files, 0::BIGINT AS lost, 0::BIGINT AS made_up FROM ({ALL_FILES})",
    "path_guard": f"SELECT path, path = '' OR regexp_matches(replace(path, chr(92), '/'), '^(/|[A-Za-z]:)|(^|/)[.][.](/|$)') AS refused FROM {values(q.PATHS)} AS t(path)",
    "stamp_parse": f"SELECT stamp, coalesce(nullif(regexp_extract(stamp, '^zpaq-m([0-9]+)', 1), '')::BIGINT, 4) AS level FROM {values(q.STAMPS)} AS t(stamp)",
    "dictionary_sizes": "WITH d AS (SELECT DISTINCT l_orderkey * l_partkey AS n FROM lineitem) SELECT least(greatest(pow(2, ceil(log2(greatest(n, 1)))), 1048576), 536870912)::BIGINT AS dictionary_size, count(*) AS inputs FROM d GROUP BY 1",
    "legacy_spans": "WITH e AS (SELECT source || '-' || doc_id // 1000 AS entry, doc_id, text FROM documents) SELECT entry, row_number() OVER (PARTITION BY entry ORDER BY doc_id) - 1 AS span_idx, doc_id::VARCHAR AS block_id, 0::BIGINT AS \"offset\", strlen(text) AS size FROM e",
    "bench_matrix": RUNS + "SELECT * FROM runs",
    "bench_aggregate": RUNS + f"SELECT tool, {STATUS} AS status, {SUMS}, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM runs WHERE tool <> 'gzip' GROUP BY tool",
    "bench_baseline": RUNS + f"SELECT {STATUS} AS status, {SUMS} FROM runs WHERE tool = 'gzip'",
    "bench_weissman": RUNS + f"SELECT r.tool, r.dataset, r.status, CASE WHEN r.status = 'ok' THEN {_score('r.archive_size', 'r.seconds', 'b.archive_size', 'b.seconds')} END AS score FROM runs r LEFT JOIN runs b ON b.tool = 'gzip' AND b.status = 'ok' AND b.dataset = r.dataset WHERE r.tool <> 'gzip'",
    "bench_tool_scores": RUNS + f", z AS ({TOTALS}) SELECT a.tool, a.status, CASE WHEN a.status = 'ok' AND b.status = 'ok' THEN {_score('a.archive_size', 'a.seconds', 'b.archive_size', 'b.seconds')} END AS score FROM z a, z b WHERE a.tool <> 'gzip' AND b.tool = 'gzip'",
    "bench_delta": RUNS + f", z AS ({TOTALS}) SELECT a.tool, a.archive_size, CASE WHEN a.archive_size > 0 AND b.archive_size > 0 THEN round((a.archive_size - b.archive_size) * 100.0::DOUBLE / b.archive_size, 6) END AS delta_percent FROM z a, z b WHERE b.tool = 'gzip'",
    "bench_gate": RUNS
    + f", z AS ({TOTALS}), w AS (SELECT a.tool, CASE WHEN a.status = 'ok' AND b.status = 'ok' THEN (b.archive_size - a.archive_size) * 100.0::DOUBLE / b.archive_size END AS win FROM z a, z b WHERE a.tool <> 'gzip' AND b.tool = 'gzip') SELECT tool, round(win, 6) AS win_percent, CASE WHEN win IS NULL THEN 'incomplete' WHEN win >= -200 THEN 'pass' ELSE 'fail' END AS verdict FROM w",
    "bench_best_rival": RUNS
    + ", g AS (SELECT dataset, min(archive_size) FILTER (tool <> 'gzip') AS best, max(archive_size) FILTER (tool = 'gzip') AS own FROM runs WHERE status = 'ok' GROUP BY dataset) SELECT dataset, best, own, round((best - own) * 100.0::DOUBLE / best, 6) AS win_percent FROM g",
    "rolling_hash": "SELECT doc_id, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor((a * 33) % 4294967296, b), 0::BIGINT) AS h FROM documents",
    "fnv_checksum": f"SELECT doc_id, {_fnv_lane(hashing.FNV_SEED_A)} || {_fnv_lane(hashing.FNV_SEED_B)} AS fnv FROM documents",
    "content_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}

#: Whatever the level and scope, every file comes back as it was.
SQL |= {name: SQL["archive_roundtrip"] for name in ("archive_write_read", "archive_balanced", "archive_max", "archive_insane", "archive_chunk_scope")}
