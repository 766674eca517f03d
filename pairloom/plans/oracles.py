"""Independent SQL for the queries, over the same tables.

Corpus results are stated from the lines themselves, not by parsing rendered files, so they check the extraction too.
"""

from __future__ import annotations

from pairloom.plans.queries import LIBRARY_DIRS, VOCAB_SIZE

# Lines and the two functions made of each.
_LINES = r"""
base AS (
  SELECT doc_id, source AS artifact, n_chars, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
ln AS (
  SELECT doc_id, artifact, line, CAST(pos AS INTEGER) AS pos, length(line) AS n,
         'do_' || coalesce(nullif(regexp_extract(line, '^[A-Za-z]+'), ''), 'anon') AS nm,
         'emit("' || replace(replace(line, '\', '\\'), '"', '\"') || '");' AS q,
         'f' || lpad(CAST((doc_id // 20) % 25 AS VARCHAR), 2, '0') AS stem,
         artifact || '/d' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '/f'
           || lpad(CAST((doc_id // 20) % 25 AS VARCHAR), 2, '0') AS fstem
  FROM base),
src AS (
  SELECT doc_id, artifact, line, n, stem, pos,
         fstem || CASE doc_id % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' ELSE '.cc' END AS path,
         nm || CASE WHEN n % 7 = 0 THEN '_local' ELSE '' END AS name,
         CASE WHEN n % 11 = 0 THEN ' ' ELSE ' ' || q || ' ' END AS body
  FROM ln),
dec AS (
  SELECT doc_id, artifact, n, stem, pos, fstem || '.o.c' AS path, q,
         CASE WHEN n % 5 = 0 THEN 'FUN_' ELSE '' END || nm AS name,
         CASE WHEN n % 13 = 0 THEN '<int>' ELSE '' END AS template,
         CASE WHEN n % 17 = 0 THEN ''
              ELSE chr(10) || '  if (ok) {' || chr(10) || '    ' || q || chr(10) || '  }' || chr(10) END AS body
  FROM ln),
dtext AS (
  SELECT *, chr(10) || 'undefined8 ' || name || '(void)' || chr(10) || chr(10) || '{' AS head,
         '}' || chr(10) AS tail
  FROM dec)"""

# Code types of each side, and both sides deduplicated.
_FUNCTIONS = """
types AS (SELECT * FROM (VALUES ('c'), ('cpp')) t(code_type)),
sfun AS (
  SELECT s.*, t.code_type, stem || '::' || name AS function_id FROM src s JOIN types t
  ON t.code_type = 'cpp' OR s.path LIKE '%.c'),
dfun AS (SELECT d.*, t.code_type, stem || '::' || name AS function_id FROM dec d CROSS JOIN types t),
sd AS (
  SELECT artifact, code_type, function_id, last(body ORDER BY path, pos) AS body,
         first(path ORDER BY path, pos) AS seq_path, first(pos ORDER BY path, pos) AS seq_pos
  FROM sfun GROUP BY ALL),
dd AS (
  SELECT artifact, code_type, function_id, last(body ORDER BY path, pos) AS body,
         first(path ORDER BY path, pos) AS seq_path, first(pos ORDER BY path, pos) AS seq_pos
  FROM dfun GROUP BY ALL)"""

_EXAMPLES = """
pairs AS (
  SELECT artifact, code_type, function_id AS ident, sd.body AS source, dd.body AS decompiled,
         dd.seq_path, dd.seq_pos
  FROM sd JOIN dd USING (artifact, code_type, function_id)),
ex_all AS (SELECT * FROM pairs WHERE (trim(source) = '') = (trim(decompiled) = '')),
ex AS (SELECT * FROM ex_all WHERE code_type = 'cpp')"""

_NATURAL = "artifact, code_type, seq_path, seq_pos, ident"
_EXAMPLE_COLUMNS = "artifact, code_type, ident, source, decompiled, seq_path, seq_pos"
_BLANK = "(trim({0}) = '')"

_MARKED = r"""chr(10) || head || body || tail"""

_CLASSIFIED = """
docs AS (
  SELECT doc_id, n_chars, text, source AS artifact,
         source || '/d' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '/f'
           || lpad(CAST((doc_id // 20) % 25 AS VARCHAR), 2, '0') AS fstem
  FROM documents),
classified AS (
  SELECT artifact, fstem || suffix AS path, code_type, 'source' AS side, suffix
  FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' ELSE '.cc' END AS suffix FROM docs),
       (VALUES ('c'), ('cpp')) t(code_type)
  WHERE code_type = 'cpp' OR suffix = '.c'
  UNION ALL
  SELECT artifact, fstem || '.o.c', code_type, 'decompiled', '.o.c' FROM docs, (VALUES ('c'), ('cpp')) t(code_type))"""

_NEW_IDS = """
fun AS (
  SELECT artifact, code_type, 'source' AS side, function_id, path, pos FROM sfun
  UNION ALL SELECT artifact, code_type, 'decompiled', function_id, path, pos FROM dfun),
firsts AS (
  SELECT artifact, code_type, side, function_id, first(path ORDER BY path, pos) AS path FROM fun GROUP BY ALL),
new_ids AS (
  SELECT f.artifact, f.code_type, f.side, f.path, coalesce(n, 0) AS new_ids
  FROM (SELECT DISTINCT artifact, code_type, side, path FROM fun) f
  LEFT JOIN (SELECT artifact, code_type, side, path, count(*) AS n FROM firsts GROUP BY ALL) x
  USING (artifact, code_type, side, path))"""

_EDGES = """
edges AS (
  SELECT DISTINCT a, b FROM (
    SELECT doc_id AS a, doc_id // 3 AS b FROM documents
    UNION ALL
    SELECT doc_id, (7 * doc_id + 3) % (SELECT count(*) FROM documents) FROM documents WHERE n_chars % 10 = 0)),
closure(root, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT c.root, e.b FROM closure c JOIN edges e ON e.a = c.node)"""

_INCLUDES = """
inc AS (
  SELECT doc_id AS a, 0 AS pos, doc_id // 3 AS b, 'src' || ((doc_id // 3) % 20) || '/h' || (doc_id // 3) || '.h' AS target,
         false AS is_system FROM documents
  UNION ALL
  SELECT doc_id, 1, doc_id // 2, './h' || (doc_id // 2) || '.h', false FROM documents
  UNION ALL
  SELECT doc_id, 2, (7 * doc_id + 3) % (SELECT count(*) FROM documents),
         'h' || ((7 * doc_id + 3) % (SELECT count(*) FROM documents)) || '.h', true
  FROM documents WHERE n_chars % 10 = 0),
inc2 AS (
  SELECT 'tree/src' || (a % 20) || '/h' || a || '.h' AS path, pos, target, is_system,
         'tree/src' || (b % 20) || '/h' || b || '.h' AS real_path, a, b FROM inc)"""

_LEDGER = """
led AS (
  SELECT CAST(user_id AS VARCHAR) AS package, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status, ts
  FROM events),
latest AS (SELECT package, last(status ORDER BY ts, status) AS status FROM led GROUP BY ALL)"""

_VOCAB = r"""
toks AS (
  SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ A-Za-z0-9_]')) AS token
  FROM {table}),
vocab AS (
  SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id
  FROM (SELECT token, count(*) AS n FROM toks GROUP BY token ORDER BY n DESC, token LIMIT {size}))"""


def _ids(table: str, key: str, text: str, out: str) -> str:
    return rf"""
{out}_t AS (
  SELECT {key}, unnest(l) AS token, generate_subscripts(l, 1) AS p FROM (
    SELECT {key}, regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ A-Za-z0-9_]')[1:510] AS l FROM {table})),
{out} AS (
  SELECT {', '.join('k.' + c.strip() for c in key.split(','))},
         list_concat(list_concat([1], coalesce(l, [])), [2]) AS ids
  FROM {table} k LEFT JOIN (
    SELECT {key}, list(coalesce(id, 3) ORDER BY p) AS l FROM {out}_t LEFT JOIN vocab USING (token) GROUP BY {key}) x
  USING ({key}))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",".join(parts) + "\n"


def _corpus(select: str, *more: str) -> str:
    return _with(_LINES, _FUNCTIONS, _EXAMPLES, *more) + select


def _csv(ids: str) -> str:
    return f"array_to_string({ids}, ',')"


def _pad(ids: str, length: str) -> str:
    return f"list_concat({ids}, list_transform(range({length} - len({ids})), lambda x: 0))"


def _mask(ids: str, length: str) -> str:
    return (f"list_concat(list_transform({ids}, lambda x: 1), "
            f"list_transform(range({length} - len({ids})), lambda x: 0))")


def _rendered(source: str) -> str:
    return f"""SELECT idx, '  ' || idx || ': ' || ident || ' (' || CASE code_type WHEN 'c' THEN 'C' ELSE 'C/C++' END || ')'
    || chr(10) || '    source:' || chr(10) || '      ' || replace(source, chr(10), chr(10) || '      ') || chr(10)
    || '    decompiled:' || chr(10) || '      ' || replace(decompiled, chr(10), chr(10) || '      ') AS rendered
    FROM {source}"""


_PLAN = """
tree AS (
  SELECT fstem || CASE doc_id % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' ELSE '.cc' END AS rel_path, 'source' AS kind, doc_id
  FROM docs
  UNION ALL SELECT fstem || '.o.c', 'marked', doc_id FROM docs
  UNION ALL SELECT fstem || '.o', 'object', doc_id FROM docs
  UNION ALL SELECT 'html/p' || page_id || '.html', 'page', page_id FROM pages),
plan AS (
  SELECT rel_path, kind, doc_id,
         CASE kind WHEN 'marked' THEN left(rel_path, length(rel_path) - 4) || '.c'
                   WHEN 'object' THEN left(rel_path, length(rel_path) - 2) || '.c' ELSE rel_path END AS out_path,
         CASE kind WHEN 'object' THEN 'unsupported'
                   WHEN 'marked' THEN CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY rel_path) <= {count}
                                           THEN 'transform' ELSE 'copy_over_count' END
                   ELSE 'copy' END AS action,
         CASE WHEN kind IN ('marked', 'object') THEN {code_type} END AS code_type
  FROM tree)"""

# Full text of each generated file.
_RENDERED_FILES = """
filetext AS (
  SELECT path AS rel_path, string_agg(
    CASE WHEN n % 11 = 0 THEN '// ' || line || chr(10) ELSE '' END || 'int ' || name || '(void) {' || body || '}',
    chr(10) ORDER BY pos) AS content FROM src GROUP BY path
  UNION ALL
  SELECT path, '/* doc ' || doc_id || ' */' || chr(10) || string_agg(
    '// FUNCTION ' || name || template || chr(10) || head || body || tail, '' ORDER BY pos)
  FROM dtext GROUP BY path, doc_id)"""

_ORDERED = "row_number() OVER (ORDER BY " + _NATURAL + ")"

_ACCURACY = """
SELECT round(avg(a), 9) AS accuracy, round(sum(r) / sum(n), 9) AS micro_accuracy, count(*) AS examples
FROM (SELECT CAST(sum(CASE WHEN pred_id = label_id THEN 1 ELSE 0 END) AS DOUBLE) AS r, CAST(count(*) AS DOUBLE) AS n,
             r / n AS a FROM p {where} GROUP BY ident)"""

_PREDICTIONS = """
p AS (SELECT l_orderkey AS ident, CAST(l_partkey % 3 AS INTEGER) AS pred_id,
             CAST(CAST(l_quantity AS BIGINT) % 3 AS INTEGER) AS label_id FROM lineitem)"""

_PART = "replace(p_name, ' ', '-') || p_partkey"

_PAGE_PATHS = "SELECT page_id, regexp_replace(url, '^https?://', '') AS rel_path FROM pages"

_OBJECTS = """
objects AS (SELECT doc_id, fstem || '.o' AS path FROM docs)"""


def _sides_missing(select: str) -> str:
    return _corpus(select, """
missing AS (
  SELECT artifact, code_type, function_id,
         CASE WHEN sd.body IS NULL THEN 'source' ELSE 'decompiled' END AS side
  FROM (SELECT * FROM sd WHERE code_type = 'cpp') sd
  FULL JOIN (SELECT * FROM dd WHERE code_type = 'cpp') dd USING (artifact, code_type, function_id)
  WHERE sd.body IS NULL OR dd.body IS NULL)""")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["paired_examples"] = _corpus(f"SELECT {_EXAMPLE_COLUMNS} FROM ex")

    cpp_blank = f"code_type = 'cpp' AND {_BLANK.format('source')} <> {_BLANK.format('decompiled')}"
    q["build_with_rejects"] = _corpus(f"""
SELECT 'example' AS kind, seq_path AS path, seq_pos AS pos, ident AS detail FROM ex
UNION ALL SELECT 'extraction', path, NULL, 'unbalanced_braces' FROM (SELECT DISTINCT path FROM src WHERE doc_id % 10 = 7)
UNION ALL SELECT 'no_body', path, CAST(count(*) AS INTEGER), 'nobody' FROM dec WHERE doc_id % 10 = 3 GROUP BY path
UNION ALL SELECT CASE WHEN {_BLANK.format('source')} THEN 'blank_source' ELSE 'blank_decompiled' END, seq_path, seq_pos,
  ident FROM pairs WHERE {cpp_blank}""")
    q["build_with_budget"] = _with(_LINES, _FUNCTIONS, """
f AS (SELECT artifact, 'source' AS side, function_id, path, pos, body FROM sfun WHERE code_type = 'cpp'
      UNION ALL SELECT artifact, 'decompiled', function_id, path, pos, body FROM dfun WHERE code_type = 'cpp'),
seen AS (SELECT artifact, side, function_id, min(path) AS path FROM f GROUP BY ALL),
counts AS (
  SELECT p.artifact, p.side, p.path, count(s.function_id) AS n
  FROM (SELECT DISTINCT artifact, side, path FROM f) p LEFT JOIN seen s USING (artifact, side, path) GROUP BY ALL),
few AS (
  SELECT artifact, side, path FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY artifact, side ORDER BY path
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts)
  WHERE before < 150),
g AS (
  SELECT artifact, side, function_id, last(body ORDER BY path, pos) AS body, first(path ORDER BY path, pos) AS seq_path,
         first(pos ORDER BY path, pos) AS seq_pos FROM f JOIN few USING (artifact, side, path) GROUP BY ALL),
two AS (
  SELECT s.artifact, 'cpp' AS code_type, s.function_id AS ident, s.body AS source, d.body AS decompiled, d.seq_path, d.seq_pos
  FROM g s JOIN g d ON s.artifact = d.artifact AND s.function_id = d.function_id AND s.side = 'source'
    AND d.side = 'decompiled' WHERE (trim(s.body) = '') = (trim(d.body) = '')),
cut AS (
  SELECT artifact FROM (
    SELECT artifact, coalesce(sum(n) OVER (ORDER BY artifact ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT artifact, count(*) AS n FROM two GROUP BY artifact)) WHERE before <= 150)""") + f"""
SELECT {_EXAMPLE_COLUMNS} FROM two JOIN cut USING (artifact)"""
    q["build_with_imports"] = _with(_LINES, _FUNCTIONS, """
more AS (
  SELECT artifact, stem || '::' || name AS function_id, path, false AS imported, pos, body FROM src
  UNION ALL
  SELECT artifact, stem || '::' || nm, fstem || CASE doc_id % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' ELSE '.cc' END, true,
         pos, ' imported(); ' FROM ln WHERE n % 7 = 0),
ms AS (SELECT artifact, function_id, last(body ORDER BY path, imported, pos) AS body FROM more GROUP BY ALL)""") + """
SELECT artifact, code_type, function_id AS ident, ms.body AS source, dd.body AS decompiled, seq_path, seq_pos
FROM ms JOIN dd USING (artifact, function_id)
WHERE code_type = 'cpp' AND (trim(ms.body) = '') = (trim(dd.body) = '')"""
    q["extract_own_type"] = _with(_LINES, """
rendered AS (
  SELECT path, string_agg(CASE WHEN n % 11 = 0 THEN '// ' || line || chr(10) ELSE '' END || 'int ' || name || '(void) {'
    || body || '}', chr(10) ORDER BY pos) AS content FROM src GROUP BY path),
rl AS (SELECT path, [x for x in string_split(content, chr(10)) if x <> ''] AS l FROM rendered)""") + """
SELECT path, 'notes' AS code_type, CAST(i AS INTEGER) AS pos, split_part(l[i + 1], ' ', 1) AS name,
       CAST(length(l[i + 1]) AS INTEGER) AS length FROM rl, unnest(range(len(l))) AS u(i)"""
    calls = """
calls AS (
  SELECT path, q, CAST(row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS INTEGER) AS pos FROM dec WHERE n % 17 <> 0),
cut AS (SELECT path, pos, left(q, 12) AS name, 'emit(' AS head, substr(q, 6, length(q) - 7) AS body, ');' AS tail FROM calls)"""
    q["own_type_functions"] = _with(_LINES, calls) + "SELECT path, 'calls' AS code_type, pos, name, head, body, tail FROM cut"
    q["own_type_tree"] = _with(_LINES, calls) + """
SELECT left(p.path, length(p.path) - 4) || '.c' AS rel_path, 0 AS part, coalesce(content, '') AS content
FROM (SELECT DISTINCT path FROM dec) p LEFT JOIN (
  SELECT path, string_agg(head || chr(10) || chr(10) || replace(body, ' ', '_') || chr(10) || chr(10) || tail,
                          chr(10) || chr(10) ORDER BY pos) AS content FROM cut GROUP BY path) USING (path)"""

    # Scans, sources, sinks.
    q["scan_files"] = """
SELECT 'docs' AS repo, 'source=' || source AS artifact, CAST(sum(length(text) + 1) AS BIGINT) AS chars,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS newlines,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY source"""
    tree = _with(_LINES, _RENDERED_FILES, """
whole AS (SELECT rel_path, content FROM filetext UNION ALL SELECT 'html/p' || page_id || '.html', html FROM pages)""")
    q["tree_scan"] = tree + """
SELECT 'docs' AS repo, split_part(rel_path, '/', 1) AS artifact, rel_path,
       CAST(len(string_split(rel_path, '/')) AS INTEGER) AS depth, octet_length(encode(content)) AS length
FROM whole WHERE regexp_matches(rel_path, '[.](cpp|cc|html)$') AND octet_length(encode(content)) > 2000"""
    q["tree_sink"] = tree + "SELECT rel_path, octet_length(encode(content)) AS length, content AS text FROM whole"
    q["scan_files_depth"] = f"SELECT * FROM ({_PAGE_PATHS}) WHERE len(string_split(rel_path, '/')) <= 3"
    q["derive_artifact"] = (f"SELECT page_id, rel_path, split_part(rel_path, '/', 1) AS artifact FROM ({_PAGE_PATHS}) "
                            "WHERE contains(rel_path, '/')")
    q["classify_files"] = _with(_CLASSIFIED) + "SELECT path, code_type, side, suffix FROM classified"
    q["skip_empty_files"] = _with(_CLASSIFIED) + """
SELECT fstem || '.o.c' AS path, octet_length(encode(text)) AS length FROM docs WHERE n_chars % 10 <> 0 AND text <> ''"""
    q["decode_lossy"] = "SELECT doc_id, text || source AS text FROM documents"
    q["write_examples"] = _corpus("""
SELECT code_type, count(*) AS n, CAST(sum(greatest(length(source), length(decompiled))) AS BIGINT) AS sum_len,
       CAST(sum(length(source) + length(decompiled)) AS BIGINT) AS chars FROM ex_all GROUP BY code_type""")
    q["read_examples"] = q["paired_examples"]
    q["build_marked_files"] = _with(_LINES) + r"""
SELECT path, 0 AS part, string_agg(
  '// FUNCTION ' || name || template || chr(10) || head
  || CASE WHEN n % 17 = 0 THEN '' ELSE chr(10)
     || CASE WHEN n % 19 = 0 THEN '  /* Truncating control flow here */' || chr(10) ELSE '' END
     || '  if (ok) {' || chr(10) || '    ' || q || chr(10) || '  }' || chr(10) END
  || tail, '' ORDER BY pos) AS content
FROM dtext GROUP BY path"""
    reassembled = """
SELECT CAST(conv_id AS VARCHAR) AS rel_path, 0 AS part, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content
FROM conversations GROUP BY conv_id"""
    q["write_tree"] = reassembled
    q["union_repos"] = """
SELECT 'apt' AS repo, p_partkey AS line_no, p_name AS package FROM part
UNION ALL SELECT 'vcpkg', s_suppkey, s_name FROM supplier
UNION ALL SELECT 'conan', c_custkey, c_name FROM customer"""

    # Projections and scalars.
    q["split_marked_functions"] = _with(_LINES) + f"""
SELECT path, pos, name || template AS name, {_MARKED} AS text FROM dtext"""
    q["split_function"] = _with(_LINES) + "SELECT path, pos, chr(10) || head AS head, body, tail FROM dtext"
    q["has_body"] = """
SELECT 'page' AS kind, page_id AS id, contains(html, '{') AS has_body FROM pages
UNION ALL SELECT 'document', doc_id, contains(text, '{') FROM documents"""
    q["function_id"] = _with(_LINES) + "SELECT doc_id, pos, stem || '::' || name AS function_id FROM dec"
    q["is_blank"] = _with(_LINES) + """
SELECT doc_id, pos, CASE WHEN n % 17 = 0 THEN true WHEN n % 19 = 0 THEN false
       ELSE NOT regexp_matches(line, '[^\\s]') END AS blank FROM ln""".replace("\\\\", "\\")
    q["drop_truncated"] = _with(_LINES) + """
SELECT path, pos, name || template AS name,
       CASE WHEN n % 19 = 0 AND n % 17 <> 0 THEN 'truncated' ELSE 'kept' END AS reason FROM dec"""
    q["output_path"] = _with(_CLASSIFIED) + """
SELECT path, code_type, regexp_replace(path, '\\.o\\.c$', '.c') AS out_path FROM classified
WHERE side = 'decompiled'""".replace("\\\\", "\\")
    q["decompiled_path"] = _with(_CLASSIFIED) + "SELECT doc_id, fstem || '.o.c' AS path FROM docs"
    q["render_examples"] = _corpus(_rendered(f"(SELECT *, {_ORDERED} - 1 AS idx FROM ex)"))
    q["render_repeats"] = _corpus(_rendered(
        f"(SELECT *, {_ORDERED} - 1 AS idx FROM (SELECT * FROM ex UNION ALL SELECT * FROM ex))"))

    # Extraction.
    q["extract_functions"] = _with(_LINES) + """
SELECT path, pos, name, 'int ' || name || '(void) {' || body || '}' AS text FROM src"""
    q["multi_capture_functions"] = _with(_LINES) + """
SELECT path, pos, name, text FROM (
  SELECT fstem || '.o.c' AS path, pos, line AS name, (pos = 0 OR n % 3 = 0) AS is_fn,
         last_value(CASE WHEN pos = 0 OR n % 3 = 0 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos)
           AS text FROM ln) WHERE NOT is_fn"""
    q["extract_includes"] = _with(_INCLUDES) + "SELECT path, pos, target, is_system FROM inc2"
    libraries = ", ".join(f"({i}, '{d}')" for i, d in enumerate(LIBRARY_DIRS))
    resolved = """
SELECT path, pos, target, is_system, {0} AS resolved_path FROM inc2"""
    library = f"""(SELECT min_by(l.d || '/' || h.f, l.i) FROM (VALUES {libraries}) l(i, d)
   JOIN (SELECT 'h' || doc_id || '.h' AS f, 'tree/src' || (doc_id % 20) AS dir FROM documents) h ON h.dir = l.d
   WHERE h.f = replace(inc2.target, './', ''))"""
    q["resolve_includes"] = _with(_INCLUDES) + resolved.format(
        f"CASE pos WHEN 0 THEN real_path WHEN 1 THEN CASE WHEN b % 20 = a % 20 THEN real_path ELSE {library} END "
        f"ELSE {library} END")
    q["resolve_includes_children"] = _with(_INCLUDES) + resolved.format(
        f"CASE WHEN pos < 2 THEN real_path ELSE {library} END")
    q["include_closure"] = _with(_EDGES, recursive=True) + "SELECT 'd' || root AS root, 'd' || node AS path FROM closure"
    q["include_closure_hops"] = _with(_EDGES, """
near(root, node, hops) AS (
  SELECT doc_id, doc_id, 0 FROM documents
  UNION
  SELECT c.root, e.b, c.hops + 1 FROM near c JOIN edges e ON e.a = c.node WHERE c.hops < 2)""", recursive=True) + """
SELECT DISTINCT 'd' || root AS root, 'd' || node AS path FROM near"""
    q["functions_with_imports"] = _with(_EDGES, _LINES, recursive=True) + """
SELECT 'd' || root AS path, 'd' || node AS def_path, pos, root <> node AS imported,
       'd' || root || '::' || name AS function_id
FROM closure JOIN dec ON dec.doc_id = closure.node"""

    # Joins and set operations.
    side = "SELECT artifact, code_type, function_id, body, seq_path, seq_pos FROM {0} WHERE code_type = 'cpp'"
    q["dedupe_source"] = _corpus(side.format("sd"))
    q["dedupe_decompiled"] = _corpus(side.format("dd"))
    q["pair_examples"] = _corpus(f"SELECT {_EXAMPLE_COLUMNS} FROM pairs WHERE code_type = 'cpp'")
    repos = """
rs AS (SELECT *, 'r' || (pos % 2) AS repo FROM sfun WHERE code_type = 'cpp'),
rd AS (SELECT *, 'r' || (pos % 2) AS repo FROM dfun WHERE code_type = 'cpp')"""
    q["pair_examples_repos"] = _with(_LINES, _FUNCTIONS, repos) + """
SELECT repo, artifact, code_type, function_id AS ident, s.body AS source, d.body AS decompiled
FROM (SELECT repo, artifact, code_type, function_id, last(body ORDER BY path, pos) AS body FROM rs GROUP BY ALL) s
JOIN (SELECT repo, artifact, code_type, function_id, last(body ORDER BY path, pos) AS body FROM rd GROUP BY ALL) d
USING (repo, artifact, code_type, function_id)"""
    q["examples_per_artifact_repos"] = _with(_LINES, _FUNCTIONS, repos) + """
SELECT repo, artifact, code_type, count(*) AS n
FROM (SELECT DISTINCT repo, artifact, code_type, function_id FROM rs)
JOIN (SELECT DISTINCT repo, artifact, code_type, function_id FROM rd) USING (repo, artifact, code_type, function_id)
GROUP BY ROLLUP (repo, artifact, code_type)"""
    loose = """
ns AS (SELECT CASE WHEN pos % 4 <> 0 THEN artifact END AS a, code_type, function_id, last(body ORDER BY path, pos) AS body
       FROM sfun WHERE code_type = 'cpp' GROUP BY ALL),
nd AS (SELECT CASE WHEN pos % 4 <> 0 THEN artifact END AS a, code_type, function_id, last(body ORDER BY path, pos) AS body
       FROM dfun WHERE code_type = 'cpp' GROUP BY ALL),
both_sides AS (
  SELECT coalesce(s.a, d.a) AS artifact, 'cpp' AS code_type, coalesce(s.function_id, d.function_id) AS ident,
         s.body AS source, d.body AS decompiled
  FROM ns s FULL JOIN nd d ON s.a IS NOT DISTINCT FROM d.a AND s.function_id = d.function_id)"""
    q["pair_examples_nulls"] = _with(_LINES, _FUNCTIONS, loose) + """
SELECT * FROM both_sides WHERE source IS NOT NULL AND decompiled IS NOT NULL"""
    q["missing_report_nulls"] = _with(_LINES, _FUNCTIONS, loose) + """
SELECT artifact, code_type, CASE WHEN source IS NULL THEN 'source' ELSE 'decompiled' END AS side, count(*) AS n,
       array_to_string(list(ident ORDER BY ident)[1:100], ' ') AS sample
FROM both_sides WHERE source IS NULL OR decompiled IS NULL GROUP BY ALL"""
    q["missing_sources"] = _sides_missing("SELECT artifact, code_type, function_id FROM missing WHERE side = 'source'")
    q["missing_decompileds"] = _sides_missing(
        "SELECT artifact, code_type, function_id FROM missing WHERE side = 'decompiled'")
    q["missing_report"] = _sides_missing("""
SELECT artifact, code_type, side, count(*) AS n,
       array_to_string(list(function_id ORDER BY function_id)[1:100], ' ') AS sample
FROM missing GROUP BY artifact, code_type, side""")
    q["drop_half_blank"] = q["paired_examples"]
    q["half_blank_report"] = _corpus(f"""
SELECT artifact, seq_path AS path, seq_pos AS pos,
       CASE WHEN {_BLANK.format('source')} THEN 'blank_source' ELSE 'blank_decompiled' END AS reason, ident AS detail
FROM pairs WHERE code_type = 'cpp' AND {_BLANK.format('source')} <> {_BLANK.format('decompiled')}""")
    q["union_code_types"] = _corpus(f"SELECT {_EXAMPLE_COLUMNS} FROM ex_all")
    q["distinct_artifacts"] = "SELECT DISTINCT source AS artifact FROM documents"

    # Filters, slices, sorts, splits.
    q["limit_code_types"] = _corpus(f"SELECT {_EXAMPLE_COLUMNS} FROM ex_all WHERE code_type = 'c'")
    some = "SELECT artifact, code_type, ident FROM ex ORDER BY " + _NATURAL + " LIMIT {0} OFFSET {1}"
    q["limit_count"] = _corpus(some.format(300, 100))
    q["limit_count_large"] = _corpus(some.format(3000, 1500))
    q["soft_cap_files"] = _corpus("""
SELECT artifact, code_type, side, path, new_ids FROM (
  SELECT *, coalesce(sum(new_ids) OVER (PARTITION BY artifact, side ORDER BY path, code_type
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM new_ids)
WHERE before < 150""", _NEW_IDS)
    holes = """
holes AS (
  SELECT CASE WHEN n_chars % 3 = 0 THEN NULL ELSE source END AS artifact,
         CASE WHEN n_chars % 5 = 0 THEN NULL ELSE lang END AS code_type, doc_id AS ident FROM documents),
placed AS (SELECT *, row_number() OVER (
  ORDER BY artifact NULLS FIRST, code_type NULLS FIRST, ident) AS r, count(*) OVER () AS n FROM holes)"""
    q["limit_count_nulls"] = _with(holes) + "SELECT artifact, code_type, ident FROM placed WHERE r > 20 AND r <= 120"
    q["split_off_end_nulls"] = _with(holes) + """
SELECT artifact, code_type, ident, CASE WHEN r <= floor(n * CAST(0.3 AS DOUBLE)) THEN 'left' ELSE 'right' END AS part
FROM placed"""
    ties = """
ties AS (SELECT l_returnflag AS artifact, l_linestatus AS code_type, l_linenumber AS ident FROM lineitem)"""
    q["limit_count_ties"] = _with(ties) + "SELECT * FROM ties ORDER BY artifact, code_type, ident LIMIT 2000 OFFSET 777"
    q["split_off_end_ties"] = _with(ties) + """
SELECT artifact, code_type, ident, CASE WHEN row_number() OVER (ORDER BY artifact, code_type, ident)
  <= floor((SELECT count(*) FROM ties) * CAST(0.37 AS DOUBLE)) THEN 'left' ELSE 'right' END AS part FROM ties"""
    q["artifact_cutoff"] = _corpus("""
SELECT artifact, code_type, ident FROM ex JOIN (
  SELECT artifact, coalesce(sum(n) OVER (ORDER BY artifact ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT artifact, count(*) AS n FROM ex GROUP BY artifact)) USING (artifact) WHERE before <= 1000""")
    key = "md5({0} || ':' || artifact || ':' || code_type || ':' || ident)"
    q["seeded_shuffle"] = _corpus(f"""
SELECT row_number() OVER (ORDER BY shuffle_key, {_NATURAL}) - 1 AS idx, artifact, ident, shuffle_key
FROM (SELECT *, {key.format(7)} AS shuffle_key FROM ex)""")
    q["permuted_positions"] = "SELECT unnest(range(count(*))) AS place, true AS back FROM documents"
    q["shuffled_slices"] = "SELECT doc_id AS ident, true AS inside FROM documents"
    q["split_off_end"] = _corpus(f"""
SELECT artifact, code_type, ident, CASE WHEN {_ORDERED} <= floor((SELECT count(*) FROM ex) * CAST(0.7 AS DOUBLE))
       THEN 'left' ELSE 'right' END AS part FROM ex""")
    q["train_eval_split"] = _corpus(f"""
SELECT artifact, code_type, ident, CASE WHEN r <= floor((SELECT least(count(*), 2500) FROM ex) * CAST(0.8 AS DOUBLE))
       THEN 'train' ELSE 'eval' END AS part
FROM (SELECT *, {_ORDERED} AS r FROM ex) WHERE r <= 2500""")
    q["sort_by_length"] = _corpus(f"""
SELECT row_number() OVER (ORDER BY sort_len, {_NATURAL}) - 1 AS idx, artifact, ident, sort_len
FROM (SELECT *, CAST(greatest(length(source), length(decompiled)) AS INTEGER) AS sort_len FROM ex)""")
    q["inspect_examples"] = _corpus(_rendered(f"""(
  SELECT *, row_number() OVER (ORDER BY shuffle_key) - 1 AS idx FROM (
    SELECT *, {key.format(42)} AS shuffle_key FROM ex_all ORDER BY shuffle_key LIMIT 50 OFFSET 10))"""))

    # Aggregations.
    q["repo_profile"] = _with(_CLASSIFIED) + """
SELECT count(DISTINCT artifact) AS artifacts, count(*) FILTER (WHERE side = 'source') AS source_files,
       count(*) FILTER (WHERE side = 'decompiled') AS decompiled_files FROM classified"""
    q["new_ids_per_file"] = _corpus("SELECT artifact, code_type, side, path, new_ids FROM new_ids", _NEW_IDS)
    q["examples_per_artifact"] = _corpus(
        "SELECT artifact, code_type, count(*) AS n FROM ex_all GROUP BY ROLLUP (artifact, code_type)")
    q["worklist_progress"] = """
SELECT 'import' AS phase, count(*) FILTER (WHERE l.doc_id IS NULL) AS todo, count(l.doc_id) AS skipped
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
UNION ALL
SELECT 'decompile', count(*) FILTER (WHERE l.doc_id IS NULL), count(l.doc_id)
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)"""
    pkgs = """
pk AS (SELECT c_custkey AS line_no, CAST(c_custkey AS VARCHAR) AS package FROM customer)"""
    q["ledger_success_count"] = _with(_LEDGER, pkgs) + """
SELECT 'main' AS repo, count(*) FILTER (WHERE status = 'success') AS num_success
FROM pk LEFT JOIN latest USING (package)"""
    q["ledger_success_running"] = _with(_LEDGER, pkgs) + """
SELECT 'main' AS repo, line_no, package, status,
       count(*) FILTER (WHERE status = 'success') OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS num_success
FROM pk LEFT JOIN latest USING (package)"""
    q["token_accuracy"] = _with(_PREDICTIONS) + _ACCURACY.format(where="")
    q["token_accuracy_masked"] = _with(_PREDICTIONS) + _ACCURACY.format(where="WHERE label_id <> 0")
    q["token_accuracy_logits"] = _with("""
p AS (SELECT vec_id % 50 AS ident, list_position(embedding, list_max(embedding)) - 1 AS pred_id, label AS label_id
      FROM embeddings)""") + _ACCURACY.format(where="")

    # Worklists.
    q["list_packages"] = f"""
SELECT 'listing' AS repo, p_partkey AS line_no, {_PART} AS package FROM part ORDER BY p_partkey LIMIT 500"""
    q["list_packages_drop_last"] = f"""
SELECT 'listing' AS repo, p_partkey AS line_no, {_PART} AS package FROM part
WHERE p_partkey < (SELECT max(p_partkey) FROM part)"""
    q["latest_per_package"] = """
SELECT 'listing' AS repo, max(p_partkey) AS line_no, p_name AS package, CAST(max(p_partkey) AS VARCHAR) AS version
FROM part WHERE p_partkey >= 2 + (SELECT min(p_partkey) FROM part) GROUP BY p_name ORDER BY line_no LIMIT 50"""
    q["list_packages_repos"] = f"""
SELECT repo, line_no, package FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY line_no) AS r, max(line_no) OVER (PARTITION BY repo) AS m FROM (
    SELECT p_type AS repo, p_partkey AS line_no, {_PART} AS package FROM part)) WHERE line_no < m AND r <= 40"""
    q["latest_per_package_repos"] = """
SELECT p_type AS repo, max(p_partkey) AS line_no, p_name AS package, CAST(max(p_partkey) AS VARCHAR) AS version
FROM part JOIN (SELECT p_type, min(p_partkey) AS low FROM part GROUP BY p_type) USING (p_type)
WHERE p_partkey >= low + 2 GROUP BY p_type, p_name
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY max(p_partkey)) <= 20"""
    q["cap_per_repo"] = """
SELECT p_type AS repo, p_partkey AS line_no, p_name AS package FROM part
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= 30"""
    q["resume_worklist"] = _with(_LEDGER, pkgs) + """
SELECT 'main' AS repo, line_no, package FROM pk WHERE package NOT IN (SELECT package FROM led)"""
    work = """
SELECT 'main' AS repo, package, '{0}' AS mode FROM pk LEFT JOIN latest USING (package) WHERE {1}"""
    q["artifact_worklist"] = _with(_LEDGER, pkgs) + " UNION ALL ".join([
        work.format("default", "status IS DISTINCT FROM 'success'"),
        work.format("skip_failures", "status IS NULL"),
        work.format("redo", "true")])
    q["file_worklist"] = _with(_CLASSIFIED, _OBJECTS) + """
SELECT doc_id, path FROM objects WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    q["classify_outcome"] = """
SELECT o_orderpriority AS repo, CAST(o_orderkey AS VARCHAR) AS package,
       CASE WHEN code > 127 THEN NULL WHEN code <> 0 THEN 'failed' ELSE 'success' END AS status, code > 127 AS abort
FROM (SELECT *, greatest(o_custkey % 200 - 50, 0) AS code FROM orders)"""

    # Encoding.
    docs = """
texts AS (SELECT doc_id AS ident, text FROM documents)"""
    doc_vocab = _VOCAB.format(key="ident", text="text", table="texts", size=VOCAB_SIZE)
    doc_ids = _ids("texts", "ident", "text", "ids")
    q["build_vocab"] = _with(docs, doc_vocab) + "SELECT token, id FROM vocab"
    q["tokenize"] = _with(docs, doc_vocab, doc_ids) + f"SELECT ident, {_csv('ids')} AS input_ids FROM ids"
    padded = "SELECT '{0}' AS mode, ident, {1} AS input_ids, {2} AS attention_mask FROM (SELECT *, {3} AS m FROM ids)"
    q["pad_longest"] = _with(docs, doc_vocab, doc_ids) + " UNION ALL ".join(
        padded.format(mode, _csv(_pad("ids", "m")), _csv(_mask("ids", "m")), length)
        for mode, length in (("longest", "(SELECT max(len(ids)) FROM ids)"),
                             ("bucket", "CAST(ceil(len(ids) / 64) * 64 AS BIGINT)")))
    both = """
alltext AS (SELECT ident, source AS text FROM ex UNION ALL SELECT ident, decompiled FROM ex)"""
    ex_vocab = _VOCAB.format(key="ident", text="text", table="alltext", size=VOCAB_SIZE)
    ex_key = "artifact, code_type, ident"
    q["encode_dataset"] = _corpus(f"""
SELECT artifact, code_type, ident, {_csv(_pad('i', 'mi'))} AS input_ids, {_csv(_mask('i', 'mi'))} AS attention_mask,
       {_csv(_pad('l', 'ml'))} AS labels
FROM (SELECT a.artifact, a.code_type, a.ident, a.ids AS i, b.ids AS l, (SELECT max(len(ids)) FROM inp) AS mi,
             (SELECT max(len(ids)) FROM lab) AS ml
      FROM inp a JOIN lab b ON a.artifact = b.artifact AND a.code_type = b.code_type AND a.ident = b.ident)""",
        both, ex_vocab, _ids("ex", ex_key, "decompiled", "inp"), _ids("ex", ex_key, "source", "lab"))
    q["decode_tokens"] = _with(docs, doc_vocab, doc_ids) + """
SELECT ident, coalesce(text, '') AS text FROM ids LEFT JOIN (
  SELECT ident, string_agg(token, ' ' ORDER BY p) AS text
  FROM (SELECT ident, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM ids) JOIN vocab USING (id)
  GROUP BY ident) USING (ident)"""

    q["encode_by_join"], q["tokenize_by_join"], q["decode_by_join"] = (
        q["encode_dataset"], q["tokenize"], q["decode_tokens"])
    q["tokenize_with"] = """
SELECT doc_id AS ident, array_to_string(list_transform(
  [x for x in string_split(text, ' ') if x <> ''][1:64], lambda x: length(x)), ',') AS input_ids FROM documents"""
    q["decode_with"] = """
SELECT doc_id AS ident, array_to_string(list_transform(
  [x for x in string_split(text, ' ') if x <> ''][1:64], lambda x: repeat('x', length(x))), ' ') AS text FROM documents"""

    # Batch transformation.
    seg = """
seg AS (
  SELECT path AS rel_path, pos * 3 AS pos, 1 AS kind, ltrim(head, chr(10)) AS text FROM dtext
  UNION ALL SELECT path, pos * 3 + 1, 0, body FROM dtext
  UNION ALL SELECT path, pos * 3 + 2, 1, '}' FROM dtext)"""
    q["segment_files"] = _with(_LINES, seg) + "SELECT rel_path, pos, kind, text FROM seg"
    q["apply_model"] = """
SELECT CAST(conv_id AS VARCHAR) AS rel_path, CAST(turn AS INTEGER) AS pos,
       CASE WHEN role = 'system' THEN 1 ELSE 0 END AS kind,
       CASE WHEN role = 'system' THEN text ELSE replace(text, ' ', '_') END AS text FROM conversations"""
    q["reassemble"] = reassembled
    q["plan_tree"] = _with(_CLASSIFIED, _PLAN.format(code_type="'c'", count=150)) + """
SELECT rel_path, out_path, action, code_type FROM plan"""
    q["transform_raw"] = _with(_LINES, _RENDERED_FILES) + """
SELECT out_path AS rel_path, 0 AS part, content FROM (
  SELECT rel_path, CASE WHEN marked THEN left(rel_path, length(rel_path) - 4) || '.c' ELSE rel_path END AS out_path,
         CASE WHEN marked THEN replace(content, ' ', '_') ELSE content END AS content
  FROM (SELECT *, rel_path LIKE '%.o.c' AS marked FROM filetext))
QUALIFY row_number() OVER (PARTITION BY out_path ORDER BY rel_path DESC) = 1"""
    q["transform_tree"] = _with(_CLASSIFIED, _PLAN.format(code_type="'cpp'", count="9e15"), _LINES, _RENDERED_FILES, seg) + """
SELECT out_path AS rel_path, 0 AS part, content FROM (
  SELECT rel_path, out_path, CASE WHEN action = 'transform' THEN t.content WHEN kind = 'page' THEN html
                                  ELSE f.content END AS content
  FROM plan LEFT JOIN filetext f USING (rel_path)
  LEFT JOIN pages ON kind = 'page' AND page_id = plan.doc_id
  LEFT JOIN (SELECT rel_path, string_agg(CASE WHEN kind = 0 THEN replace(text, ' ', '_') ELSE text END,
                                         chr(10) || chr(10) ORDER BY pos) AS content FROM seg GROUP BY rel_path) t
  USING (rel_path)
  WHERE action <> 'unsupported')
QUALIFY row_number() OVER (PARTITION BY out_path ORDER BY rel_path DESC) = 1"""

    header = """
headers AS (
  SELECT artifact || '/' || split_part(fstem, '/', 2) || '/h.h' AS rel_path, '/* header */' || chr(10) || string_agg(
    CASE WHEN n % 7 = 0 THEN 'int ' || nm || '(void) { imported(); }' || chr(10) ELSE '' END, '' ORDER BY pos) AS content
  FROM ln GROUP BY artifact, fstem),
everything AS (
  SELECT rel_path, CASE WHEN rel_path LIKE '%.o.c' THEN content ELSE '#include "h.h"' || chr(10) || content END AS content
  FROM filetext UNION ALL SELECT * FROM headers)"""
    q["transform_tree_gaps"] = _with(_LINES, _RENDERED_FILES, header, """
named AS (
  SELECT *, CASE WHEN rel_path LIKE '%.o.c' THEN left(rel_path, length(rel_path) - 4) || '.c' ELSE rel_path END AS out_path
  FROM everything)""") + """
SELECT out_path AS rel_path, 0 AS part, content FROM named
QUALIFY row_number() OVER (PARTITION BY out_path ORDER BY named.rel_path DESC) = 1"""
    q["model_store"] = q["apply_model"]
    regular = "SELECT DISTINCT text FROM conversations WHERE role <> 'system'"
    q["model_store_calls"] = f"""
SELECT 1 AS run, count(*) AS calls FROM ({regular} AND conv_id % 2 = 0)
UNION ALL SELECT 2, count(*) FROM ({regular}) WHERE text NOT IN ({regular} AND conv_id % 2 = 0)"""

    # Streaming.
    q["watch_ledger"] = _with(_LEDGER) + "SELECT DISTINCT 'main' AS repo, package FROM led WHERE status = 'success'"
    q["watch_build"] = _corpus("""
SELECT batches, artifact, code_type, ident, source, decompiled FROM ex, (VALUES (1), (8)) b(batches)
WHERE artifact IN (SELECT 'src' || (user_id % 40) FROM events WHERE event_type <> 'error' AND (user_id % 40) % 6 <> 5)""")
    q["ledger_snapshot"] = _with(_LEDGER) + "SELECT 'main' AS repo, package, status FROM latest"
    q["marker_ledger"] = _with(_LEDGER) + "SELECT DISTINCT 'main' AS repo, package, status FROM led"
    return q
