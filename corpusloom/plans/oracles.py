"""SQL that states what each registered query must return."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_TXT = "source || '/' || lang || '/' || doc_id || '.txt'"
_MIXED = """source || '/' || lang || '/' || doc_id ||
    CASE doc_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.md' ELSE '.txt' END"""
_NOT_BLANK = r"regexp_matches({}, '[^\s\x{{85}}\p{{Z}}]')"
_LINES = r"string_split(regexp_replace(replace({}, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10))"


def not_blank(text: str) -> str:
    return _NOT_BLANK.format(text)


def line_list(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) ELSE {_LINES.format(text)} END"


def capped(rows: str, cap: int | None) -> str:
    """CTEs from ``rows(file_path, text, ...)`` to ``cut``, the same with ``text`` within the cap."""
    if cap is None:
        return f"raw AS ({rows}), cut AS (SELECT *, false AS was_truncated FROM raw)"
    return f"""
    raw AS ({rows}),
    letters AS (
        SELECT file_path, unnest(string_split(text, '')) AS letter,
               generate_subscripts(string_split(text, ''), 1) AS n
        FROM raw WHERE strlen(text) > {cap}
    ),
    placed AS (
        SELECT file_path, letter, n,
               sum(strlen(letter)) OVER (PARTITION BY file_path ORDER BY n) AS upto
        FROM letters
    ),
    heads AS (
        SELECT file_path, string_agg(letter, '' ORDER BY n) AS head
        FROM placed WHERE upto <= {cap} GROUP BY file_path
    ),
    cut AS (
        SELECT raw.* REPLACE (coalesce(head, text) AS text), strlen(text) > {cap} AS was_truncated
        FROM raw LEFT JOIN heads USING (file_path)
    )"""


def whole_files(path: str) -> str:
    return f"""
        SELECT {path} AS file_path, text,
               CAST(1 AS BIGINT) AS start_line,
               CAST(greatest(len({line_list('text')}), 1) AS BIGINT) AS end_line
        FROM documents"""


_REPORT = """file_path, start_line, end_line, item_name, language,
    CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5"""

ORACLES["whole_file_chunks"] = f"""
WITH {capped(whole_files(_TXT), 48_000)}
SELECT file_path, start_line, end_line, file_path AS item_name, 'text' AS language,
       CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5
FROM cut WHERE {not_blank('text')}
"""

ORACLES["split_lines"] = f"""
WITH l AS (SELECT doc_id, {line_list('text')} AS lines FROM documents)
SELECT doc_id, CAST(generate_subscripts(lines, 1) AS BIGINT) AS line_no, unnest(lines) AS line FROM l
"""

ORACLES["line_offsets"] = r"""
WITH l AS (
    SELECT doc_id, CASE WHEN text = '' THEN CAST([] AS VARCHAR[])
           ELSE string_split(regexp_replace(text, '\n\z', ''), chr(10)) END AS lines
    FROM documents
), e AS (
    SELECT doc_id, generate_subscripts(lines, 1) AS line_no, unnest(lines) AS line FROM l
)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
       CAST(coalesce(sum(strlen(line) + 1) OVER (
           PARTITION BY doc_id ORDER BY line_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
FROM e
"""

_SMALL_CUT = f"WITH {capped(whole_files(_TXT), 2_000)}"

ORACLES["truncate_bytes"] = f"""
{_SMALL_CUT}
SELECT file_path, CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5, was_truncated
FROM cut WHERE {not_blank('text')}
"""

ORACLES["truncated_chunks"] = f"""
{_SMALL_CUT}
SELECT count(*) FILTER (WHERE was_truncated) AS truncated_chunks FROM cut WHERE {not_blank('text')}
"""

_HEADED = f"""
    source_lines AS (
        SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS file_path,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS n
        FROM documents
    ),
    marked AS (
        SELECT file_path, n,
               (n - 1 + doc_id) % 4 = 1 AS heading,
               CASE WHEN (n - 1 + doc_id) % 4 = 1 THEN '## ' || substring(line, 1, 20)
                    WHEN (n - 1 + doc_id) % 7 = 3 THEN '#### ' || line
                    ELSE line END AS line
        FROM source_lines
    ),
    sectioned AS (
        SELECT *, sum(CAST(heading AS INTEGER)) OVER (PARTITION BY file_path ORDER BY n) AS section
        FROM marked
    ),
    sections AS (
        SELECT file_path, min(n) AS start_line, max(n) AS end_line,
               first(line ORDER BY n) AS head, bool_or(heading) AS headed,
               string_agg(line, chr(10) ORDER BY n) AS text
        FROM sectioned GROUP BY file_path, section
    )"""

ORACLES["heading_sections"] = f"""
WITH {_HEADED}
SELECT file_path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
       CASE WHEN headed AND trim(head[3:]) <> '' THEN trim(head[3:]) ELSE file_path END AS item_name,
       'markdown' AS language, CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5
FROM sections WHERE {not_blank('text')}
"""

ORACLES["chunks_per_file"] = f"""
WITH {_HEADED}
SELECT file_path, count(*) AS chunks FROM sections WHERE {not_blank('text')} GROUP BY file_path
"""

# Prose has no headings and no declarations: a Markdown file is one section, and a Rust
# file one preamble of its non-blank lines.
_MIXED_ROWS = f"""
        SELECT file_path, text, start_line, end_line, item_name, language FROM (
            SELECT {_MIXED} AS file_path,
                   CASE doc_id % 3
                       WHEN 0 THEN array_to_string([x.line FOR x IN kept], chr(10))
                       WHEN 1 THEN array_to_string([x.line FOR x IN numbered], chr(10))
                       ELSE text END AS text,
                   CAST(CASE doc_id % 3 WHEN 0 THEN kept[1].n ELSE 1 END AS BIGINT) AS start_line,
                   CAST(CASE doc_id % 3 WHEN 0 THEN kept[-1].n WHEN 1 THEN len(numbered)
                        ELSE greatest(len(numbered), 1) END AS BIGINT) AS end_line,
                   CASE doc_id % 3 WHEN 0 THEN 'preamble' ELSE {_MIXED} END AS item_name,
                   CASE doc_id % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'markdown' ELSE 'text' END AS language
            FROM (
                SELECT *, list_filter(numbered, lambda x: {not_blank('x.line')}) AS kept
                FROM (
                    SELECT *, list_transform({line_list('text')}, lambda s, i: {{'line': s, 'n': i}}) AS numbered
                    FROM documents
                )
            )
        ) WHERE {not_blank('text')}"""
_MIXED_CUT = f"WITH {capped(_MIXED_ROWS, None)}"

ORACLES["mixed_chunks"] = f"{_MIXED_CUT} SELECT {_REPORT} FROM cut WHERE {not_blank('text')}"

ORACLES["dry_run_by_root"] = f"""
{_MIXED_CUT}
SELECT split_part(file_path, '/', 1) AS root, count(*) AS chunks,
       CAST(sum(strlen(text)) // 4 AS BIGINT) AS tokens
FROM cut WHERE {not_blank('text')} GROUP BY root ORDER BY root
"""

ORACLES["dry_run_totals"] = f"""
{_MIXED_CUT}
SELECT count(*) AS total_chunks,
       CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS total_characters,
       CAST(coalesce(sum(strlen(text)), 0) // 4 AS BIGINT) AS estimated_tokens,
       CAST((count(*) + 127) // 128 AS BIGINT) AS embedding_batches,
       count(*) FILTER (WHERE was_truncated) AS truncated_chunks,
       'hashing' AS model, CAST(1024 AS INTEGER) AS dimensions
FROM cut WHERE {not_blank('text')}
"""

_ALL_ROWS = f"""
        SELECT 'documents/' || {_TXT} AS file_path, text FROM documents
        UNION ALL SELECT 'pages/' || page_id, html FROM pages
        UNION ALL SELECT 'conversations/' || conv_id || '-' || turn, text FROM conversations"""

ORACLES["dry_run_all_tables"] = f"""
WITH {capped(_ALL_ROWS, None)}
SELECT split_part(file_path, '/', 1) AS root, count(*) AS chunks,
       CAST(sum(strlen(text)) // 4 AS BIGINT) AS tokens
FROM cut WHERE {not_blank('text')} GROUP BY root ORDER BY root
"""

ORACLES["dry_run_report"] = f"""
WITH {capped(_ALL_ROWS, None)}
SELECT split_part(file_path, '/', 1) AS root, grouping(split_part(file_path, '/', 1)) = 1 AS whole,
       count(*) AS chunks, CAST(sum(strlen(text)) AS BIGINT) AS characters,
       CAST(sum(strlen(text)) // 4 AS BIGINT) AS tokens,
       CAST((count(*) + 127) // 128 AS BIGINT) AS batches,
       count(*) FILTER (WHERE was_truncated) AS truncated
FROM cut WHERE {not_blank('text')} GROUP BY GROUPING SETS ((split_part(file_path, '/', 1)), ())
"""

# Declarations: all positions follow from the supplier key.
_SUPPLIER_FILES = """
    s AS (
        SELECT s_suppkey AS k, 1 + s_suppkey % 5 AS b,
               CASE WHEN s_suppkey % 3 = 0 THEN 40 ELSE 2 END AS r,
               'suppliers/' || s_suppkey || '.rs' AS file_path
        FROM supplier
    ),
    methods AS (
        SELECT *, unnest(range(1, r + 1)) AS j FROM s
    ),
    bodies AS (
        SELECT k, string_agg('    fn m_' || j || '() {' || chr(10) || '        x' || chr(10) || '    }' || chr(10), '' ORDER BY j) AS body
        FROM methods GROUP BY k
    ),
    chunks AS (
        SELECT file_path, 0 AS chunk_ord, 1 AS start_line,
               CASE WHEN r = 40 THEN 9 + b + 3 * r ELSE 3 END AS end_line, 'preamble' AS item_name,
               'use std::fmt;' || chr(10) || '/// doc ' || k ||
               CASE WHEN r = 40 THEN chr(10) || 'impl S' || k || ' {' || chr(10) || '}' ELSE '' END AS text
        FROM s
        UNION ALL
        SELECT file_path, 1, 4, 5 + b, 'f_' || k,
               'pub fn f_' || k || '(x: i32) -> i32 {' || chr(10) ||
               repeat('    let s = "}";' || chr(10), CAST(b AS INTEGER)) || '}'
        FROM s
        UNION ALL
        SELECT file_path, 2, 7 + b, 7 + b, 'S' || k, 'struct S' || k || ';' FROM s
        UNION ALL
        SELECT file_path, 3, 8 + b, 9 + b + 3 * r, 'impl S' || k || ' {',
               'impl S' || k || ' {' || chr(10) || body || '}'
        FROM s JOIN bodies USING (k) WHERE r = 2
        UNION ALL
        SELECT file_path, 2 + j, 9 + b + 3 * (j - 1), 11 + b + 3 * (j - 1), 'S' || k || '::m_' || j,
               'fn m_' || j || '() {' || chr(10) || '        x' || chr(10) || '    }'
        FROM methods WHERE r = 40
    )"""
_POSITION = "CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line"

ORACLES["decl_chunks"] = f"""
WITH {_SUPPLIER_FILES}
SELECT file_path, CAST(chunk_ord AS INTEGER) AS chunk_ord, {_POSITION}, item_name, text, 'rust' AS language
FROM chunks
"""

ORACLES["impl_split"] = f"""
WITH {_SUPPLIER_FILES}
SELECT file_path, {_POSITION}, item_name, text FROM chunks WHERE contains(item_name, '::')
"""

ORACLES["preamble"] = f"""
WITH {_SUPPLIER_FILES}
SELECT file_path, {_POSITION}, text FROM chunks WHERE item_name = 'preamble'
"""

# Order, first and last line, name and text of the items in the file of every part; n lines in the body.
_KINDS = [
    ("1", "1", "22", "'preamble'", """'#![allow(dead_code)]
/* outer } ' || held || ' */
#[derive(Debug)]
/// says
#[inline]'"""),
    ("2", "4", "6", "'S' || k", """'pub struct S' || k || ' {
    pub a: u8,
}'"""),
    ("3", "7", "7", "'E' || k", "'pub(crate) enum E' || k || ' { A, B(u8) }'"),
    ("4", "8", "10", "'T' || k", """'pub unsafe trait T' || k || ': Send {
    fn go(&self);
}'"""),
    ("5", "11", "13", "'m' || k", """'mod m' || k || ' {
    pub fn inner() {}
}'"""),
    ("6", "14", "14", "'C' || k", """'pub const C' || k || ': &str = "}";'"""),
    ("7", "15", "15", "'V' || k", "'static mut V' || k || ': u8 = 1;'"),
    ("8", "16", "16", "'A' || k", "'type A' || k || '<T> = Vec<T>;'"),
    ("9", "17", "19", "'w' || k", """'macro_rules! w' || k || ' {
    () => {};
}'"""),
    ("10", "20", "20", "'impl T' || k || ' for S' || k || ' { fn go(&self) {} }'", "'impl T' || k || ' for S' || k || ' { fn go(&self) {} }'"),
    ("11", "23", "24 + n", "'f' || k", """'pub async unsafe fn f' || k || '<const N: usize>() where [u8; N]: Sized {
' || repeat('    a();
', n) || '}'"""),
]
_PARTS = """WITH s AS (
    SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(1 + p_partkey % 4 AS INTEGER) AS n,
           CASE WHEN p_partkey % 8 = 0 THEN '/* inner } */ {' ELSE '{' END AS held
    FROM part
) """
ORACLES["decl_kinds"] = _PARTS + " UNION ALL ".join(
    f"""SELECT 'parts/' || k || '.rs' AS file_path, CAST({i} - 1 AS INTEGER) AS chunk_ord, CAST({a} AS BIGINT) AS start_line,
    CAST({b} AS BIGINT) AS end_line, {name} AS item_name, {text} AS text FROM s"""
    for i, a, b, name, text in _KINDS
)

ORACLES["impl_trait_split"] = """
WITH s AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST(34 + s_suppkey % 3 AS INTEGER) AS n,
           '<Own' || k || ' as Owner>::Kind<T><Make' || k || '<T>>::' AS own
    FROM supplier
), m AS (SELECT *, unnest(generate_series(1, n)) AS j FROM s)
SELECT 'makers/' || k || '.rs' AS file_path, CAST(ord AS INTEGER) AS chunk_ord, CAST(a AS BIGINT) AS start_line,
       CAST(b AS BIGINT) AS end_line, item_name, text
FROM (
    SELECT k, 0 AS ord, 1 AS a, 5 + 3 * n AS b, 'preamble' AS item_name,
           'impl<T: Into<Vec<u8>>> Make' || k || '<T> /* x for y */ for <Own' || k || ' as Owner>::Kind<T>
where T: Clone {
}' AS text FROM s
    UNION ALL SELECT k, 1, 3, 3, own || 'K', 'const K: usize = ' || k || ';' FROM s
    UNION ALL SELECT k, 2, 4, 4, own || 'Out', 'type Out = Vec<T>;' FROM s
    UNION ALL SELECT k, 2 + j, 2 + 3 * j, 4 + 3 * j, own || 'm_' || j, 'fn m_' || j || '(&self) -> u8 {
        1
    }' FROM m
)
"""

ORACLES["split_chunks"] = f"""
WITH raw AS ({_MIXED_ROWS})
SELECT file_path, md5(text) AS text_md5, true AS within, true AS distinct_ids, start_line, end_line FROM raw
"""

ORACLES["last_write_wins"] = """
SELECT 'parts/' || p_partkey || '.rs:1-1' AS external_id, 'B_' || p_partkey AS item_name,
       'const B_' || p_partkey || ': u8 = 2;' AS text
FROM part
"""
ORACLES["last_write_wins_in_file"] = ORACLES["last_write_wins"]

# Sources

ORACLES["glob_filter"] = rf"""
WITH p AS (SELECT doc_id, {_MIXED} AS file_path FROM documents),
rel AS (SELECT *, split_part(file_path, '/', 2) || '/' || split_part(file_path, '/', 3) AS rel FROM p)
SELECT doc_id, file_path FROM rel
WHERE regexp_full_match(rel, '(.*/)?[^/]*\.(rs|md)') AND NOT regexp_full_match(rel, '(.*/)?fr/.*')
"""

ORACLES["glob_filter_table"] = f"""
WITH p AS (SELECT doc_id, {_MIXED} AS file_path FROM documents),
rel AS (SELECT *, split_part(file_path, '/', 2) AS folder, split_part(file_path, '/', 3) AS name FROM p)
SELECT doc_id, file_path FROM rel
WHERE (name IN (SELECT p_partkey || '.md' FROM part)
    OR length(folder) = 2 AND EXISTS (SELECT 1 FROM nation WHERE name LIKE n_nationkey || '_.%')
    OR EXISTS (SELECT 1 FROM region WHERE ends_with(name, r_regionkey || '.rs')))
  AND name NOT IN (SELECT s_suppkey || '.rs' FROM supplier) AND NOT name LIKE '9%.md'
"""

ORACLES["decoded_files"] = f"""
SELECT {_TXT} AS file_path, md5(text) AS source_md5 FROM documents WHERE doc_id % 5 <> 0
"""

ORACLES["skipped_files"] = f"""
SELECT {_TXT} AS file_path, 'not valid UTF-8' AS reason FROM documents WHERE doc_id % 5 = 0
"""

ORACLES["skipped_reasons"] = """
SELECT 'not valid UTF-8' AS reason, count(*) AS files FROM documents WHERE doc_id % 5 = 0
"""

# Reports

ORACLES["batch_ids"] = """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 128 AS BIGINT) AS batch_id FROM documents
"""

# Embedding


def hash_vectors(rows: str) -> str:
    """CTEs from ``rows(id, text)`` to ``vectors(id, v)``: float vectors of 64 dimensions."""
    return f"""
    texts AS ({rows}),
    words AS (
        SELECT id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS word
        FROM texts
    ),
    signed AS (
        SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket,
               1 - 2 * (('0x' || substr(md5(word), 9, 1))::BIGINT % 2) AS sign
        FROM words
    ),
    sums AS (SELECT id, bucket, CAST(sum(sign) AS DOUBLE) AS s FROM signed GROUP BY id, bucket),
    norms AS (SELECT id, sqrt(sum(s * s)) AS norm FROM sums GROUP BY id HAVING sum(s * s) > 0),
    weights AS (
        SELECT id, bucket, CAST(s / norm AS FLOAT) AS weight FROM sums JOIN norms USING (id)
    ),
    vectors AS (
        SELECT id, list(CAST(coalesce(weight, 0) AS DOUBLE) ORDER BY d.bucket) AS v
        FROM (SELECT id, unnest(range(64)) AS bucket FROM norms) d LEFT JOIN weights USING (id, bucket)
        GROUP BY id
    )"""


ORACLES["hash_embed"] = f"""
WITH {hash_vectors('SELECT item_id AS id, text FROM benchmark')}
SELECT id AS item_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(weight AS DOUBLE), 6) AS weight
FROM weights WHERE weight <> 0
"""

ORACLES["hash_token_usage"] = """
SELECT CAST(sum(len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))) AS BIGINT)
    AS total_tokens
FROM documents
"""

ORACLES["model_embed"] = """
SELECT doc_id, CAST(length(text) AS DOUBLE) AS e0,
       CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS e1,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS e2,
       CAST(0 AS DOUBLE) AS e3,
       CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS usage_tokens
FROM documents
"""

# Index

ORACLES["index_table_rows"] = f"""
WITH {capped(whole_files(_TXT), None)}
SELECT file_path || ':' || start_line || '-' || end_line AS external_id, CAST(64 AS INTEGER) AS dimensions,
       file_path, start_line, end_line, file_path AS item_name, md5(text) AS chunk_md5, 'text' AS language
FROM cut WHERE {not_blank('text')}
"""


def _ids_and_texts(edited: str) -> str:
    rows = f"""
        SELECT {_TXT} AS file_path, {edited} AS text,
               CAST(greatest(len({line_list(edited)}), 1) AS BIGINT) AS end_line
        FROM documents"""
    return f"""(WITH {capped(rows, None)}
        SELECT file_path || ':1-' || end_line AS external_id, text FROM cut WHERE {not_blank('text')})"""


_EDITED = "(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', 'E') ELSE text || chr(10) || 'more' END)"

ORACLES["upsert_merge"] = f"""
WITH old AS {_ids_and_texts('text')}, new AS {_ids_and_texts(_EDITED)}
SELECT external_id, md5(text) AS chunk_md5 FROM new
UNION ALL
SELECT external_id, md5(text) AS chunk_md5 FROM old
WHERE external_id NOT IN (SELECT external_id FROM new)
"""

# Search

_VECTORS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_RANK = "CAST(row_number() OVER ({} ORDER BY score DESC, {}) AS INTEGER) AS rank"
_FIRST_HITS = f"""
WITH {_VECTORS},
scored AS (
    SELECT vec_id, label, list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 0)) AS score FROM e
)"""

ORACLES["topk_cosine"] = f"""
{_FIRST_HITS}
SELECT vec_id, {_RANK.format('', 'vec_id')}, round(score, 6) AS score
FROM scored QUALIFY rank <= 10
"""

_PAIRS = f"""
WITH {_VECTORS},
scored AS (
    SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.v, q.v) AS score FROM e, e AS q
)"""

ORACLES["topk_batch"] = f"""
{_PAIRS}
SELECT query_id, vec_id, {_RANK.format('PARTITION BY query_id', 'vec_id')}, round(score, 6) AS score
FROM scored QUALIFY rank <= 10
"""
ORACLES["ivf_kmeans_full_probe"] = ORACLES["topk_batch"]

ORACLES["unit_vectors"] = f"""
WITH {_VECTORS},
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos,
       round(CAST(CAST(unnest(v) / norm AS FLOAT) AS DOUBLE), 6) AS value
FROM n
"""

_CENTROIDS = f"""
WITH {_VECTORS},
parts AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos),
c AS (SELECT label AS centroid, list(x ORDER BY pos) AS c FROM means GROUP BY label),
near AS (
    SELECT vec_id, v, centroid,
           row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(v, c) DESC, centroid) AS place
    FROM e, c
),
assigned AS (SELECT vec_id, v, centroid FROM near WHERE place = 1)"""

ORACLES["centroid_assign"] = f"{_CENTROIDS} SELECT vec_id, centroid FROM assigned"

_PROBED = f"""
{_CENTROIDS},
scored AS (
    SELECT q.vec_id AS query_id, a.vec_id, list_cosine_similarity(a.v, q.v) AS score
    FROM near q JOIN assigned a USING (centroid) WHERE q.place <= 3
)"""

ORACLES["ivf_probe"] = f"""
{_PROBED}
SELECT vec_id, {_RANK.format('', 'vec_id')}, round(score, 6) AS score
FROM scored WHERE query_id = 0 QUALIFY rank <= 10
"""

ORACLES["ivf_probe_batch"] = f"""
{_PROBED}
SELECT query_id, vec_id, {_RANK.format('PARTITION BY query_id', 'vec_id')}, round(score, 6) AS score
FROM scored QUALIFY rank <= 10
"""

_SEARCHED = f"""
    SELECT 'd' || file_path || ':1-' || end_line AS id, text FROM cut WHERE {not_blank('text')}
    UNION ALL SELECT 'q' || item_id, text FROM benchmark"""

ORACLES["semantic_search"] = f"""
WITH {capped(whole_files(_TXT), None)}, {hash_vectors(_SEARCHED)},
scored AS (
    SELECT CAST(q.id[2:] AS BIGINT) AS item_id, d.id[2:] AS external_id,
           list_cosine_similarity(d.v, q.v) AS score
    FROM vectors q, vectors d WHERE q.id[1] = 'q' AND d.id[1] = 'd'
)
SELECT item_id, external_id, {_RANK.format('PARTITION BY item_id', 'external_id')}, round(score, 6) AS score
FROM scored QUALIFY rank <= 5
"""

ORACLES["render_hits"] = f"""
{_FIRST_HITS},
hits AS (
    SELECT *, CAST(row_number() OVER (ORDER BY score DESC, 'vec/' || vec_id) AS INTEGER) AS rank
    FROM scored QUALIFY rank <= 10
)
SELECT rank,
       'Result ' || rank || ' (score: ' || printf('%.4f', score) || ')' || chr(10) ||
       '  File: ' || CASE WHEN vec_id % 3 > 0 THEN 'vectors/' ELSE 'vec/' END || vec_id ||
       ':' || (label + 1) || '-' || (label + 2) || chr(10) ||
       CASE WHEN label % 2 = 1 THEN '  Item: label_' || label || chr(10) ELSE '' END ||
       '  ---' || chr(10) || '  label ' || label || chr(10) || '  vector ' || vec_id || chr(10) ||
       '  ---' || chr(10) AS rendered
FROM hits
"""

ORACLES["topk_batch_grid"] = ORACLES["topk_batch_blocks"] = ORACLES["topk_batch"]
ORACLES["centroid_assign_grid"] = ORACLES["centroid_assign"]
ORACLES["ivf_probe_batch_grid"] = ORACLES["ivf_probe_batch"]

_SCANNED = (
    "nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

ORACLES["scanned_paths"] = f"""
SELECT path_in_root, 'not valid UTF-8' AS reason
FROM (VALUES {", ".join(f"('{name}.parquet')" for name in _SCANNED)}) AS t(path_in_root)
"""
