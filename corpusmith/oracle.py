"""The registered queries in SQL, for checking results with another engine."""

from __future__ import annotations

from . import catalog as C
from .functions import language, mime
from .settings import (
    DEFAULT_MIME, ERROR_PREFIX, NO_INDEX_MESSAGE, SOURCES_HEADER, SUCCESS_PREFIX, SUCCESS_SUFFIX,
    WEB_CHUNK_OVERLAP, WEB_CHUNK_SIZE,
)

BLANKS = r"[ \t\r\n\f\x0B]+"
NL = "chr(10)"


def text(value: str) -> str:
    """A string literal; line ends as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + f" || {NL} || ".join(parts) + ")"


def values(rows: list[tuple]) -> str:
    cell = lambda v: text(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


# --- building blocks ---------------------------------------------------------------

VEC = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
DOT = "list_dot_product({a}, {b})"
SQUARED = "list_sum(list_transform(generate_series(1, len({a})), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def neighbours(key: str, value: str, out: str) -> str:
    return f"""
    WITH e AS ({VEC}),
    d AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, {key} AS k FROM e q CROSS JOIN e x),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(k, 9), vec_id) AS rank FROM d)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round({value}, 9) AS {out}
    FROM r WHERE rank <= 5"""


COSINE = (
    f"{DOT.format(a='q.v', b='x.v')} / (sqrt({DOT.format(a='q.v', b='q.v')})"
    f" * sqrt({DOT.format(a='x.v', b='x.v')}))"
)


def n_tokens(column: str) -> str:
    return f"len(list_filter(regexp_split_to_array({column}, '{BLANKS}'), lambda x: x <> ''))"


def chunks(docs: str, size: int, overlap: int) -> str:
    """CTEs ending in `chunk`; docs is a query for doc_id (text) and content."""
    end = "greatest({s}, len(list_filter(cs, lambda x: x <= {base} + %d)))" % size
    base = "(CASE WHEN {s} = 1 THEN 0 ELSE cs[{s} - 1] END)"

    def last(s: str) -> str:
        return end.format(s=s, base=base.format(s=s))

    rest = f"(cs[e] - {overlap})"
    following = (
        f"greatest(s + 1, 1 + (CASE WHEN {rest} > 0 THEN 1 ELSE 0 END)"
        f" + len(list_filter(cs, lambda x: x < {rest})))"
    )
    return f"""
    src AS ({docs}),
    parts AS (SELECT doc_id, str_split(content, {NL}) AS ls FROM src),
    line AS (
        SELECT doc_id, line_no, CAST(greatest(1, {n_tokens('l')}) AS BIGINT) AS t FROM (
            SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS line_no FROM parts)),
    run AS (
        SELECT doc_id, line_no, t,
            CAST(sum(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS c FROM line),
    sums AS (SELECT doc_id, list(c ORDER BY line_no) AS cs FROM run GROUP BY doc_id),
    walk AS (
        SELECT doc_id, cs, 0 AS chunk_no, CAST(1 AS BIGINT) AS s,
            CAST({last('1')} AS BIGINT) AS e FROM sums
        UNION ALL
        SELECT doc_id, cs, chunk_no, s, CAST({last('s')} AS BIGINT) AS e FROM (
            SELECT doc_id, cs, chunk_no + 1 AS chunk_no, CAST({following} AS BIGINT) AS s
            FROM walk WHERE e < len(cs))),
    chunk AS (
        SELECT walk.doc_id, sha256(walk.doc_id || ':' || chunk_no) AS chunk_id, chunk_no,
            s AS start_line, e AS end_line,
            cs[e] - {base.format(s='s')} AS n_tokens,
            array_to_string(ls[s:e], {NL}) AS content
        FROM walk JOIN parts USING (doc_id))"""


def embed(name: str, source: str, id_column: str, content: str = "content") -> str:
    """CTEs `name` (id, pos, v) and `name`_len (id, sq) of all entries that are not zero."""
    d = C.DIM
    return f"""
    {name}_tok AS (
        SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS hv FROM (
            SELECT {id_column} AS id, unnest(regexp_split_to_array(lower({content}), '[^a-z0-9_]+')) AS tok
            FROM {source}) WHERE tok <> ''),
    {name}_sum AS (
        SELECT id, hv % {d} AS pos, CAST(sum(CASE WHEN (hv // {d}) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS s
        FROM {name}_tok GROUP BY ALL),
    {name} AS (
        SELECT id, pos, ((s / sqrt(sum(s * s) OVER (PARTITION BY id)))::FLOAT)::DOUBLE AS v
        FROM {name}_sum WHERE s <> 0),
    {name}_len AS (
        SELECT {id_column} AS id, coalesce(max(sq), 0) AS sq FROM {source}
        LEFT JOIN (SELECT id AS i, sum(v * v) AS sq FROM {name} GROUP BY id) ON i = {id_column}
        GROUP BY 1)"""


def top(q: str, x: str, k: int = 5) -> str:
    """CTE `hit` (query_id, rank, id, d) from two embeddings."""
    return f"""
    prod AS (SELECT a.id AS query_id, b.id AS id, sum(a.v * b.v) AS p
        FROM {q} a JOIN {x} b USING (pos) GROUP BY ALL),
    dist AS (SELECT a.id AS query_id, b.id AS id,
        greatest(0, a.sq + b.sq - 2 * coalesce(p, 0)) AS d
        FROM {q}_len a CROSS JOIN {x}_len b
        LEFT JOIN prod ON prod.query_id = a.id AND prod.id = b.id),
    hit AS (SELECT * FROM (
        SELECT query_id, id, d,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS INTEGER) AS rank
        FROM dist) WHERE rank <= {k})"""


ENDING = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in C.EXTENSIONS.items()
) + " ELSE '' END"
FILES = f"""
    file AS (SELECT doc_id, lang, source, text AS content, n_chars AS size,
        source || '/' || lang || '/' || doc_id || {ENDING} AS rel_path,
        source || '/' || lang AS dir, doc_id || {ENDING} AS name, {ENDING} AS ext
        FROM documents)"""
SMALL_CHUNKS = chunks(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents",
    C.SMALL.chunk_size, C.SMALL.chunk_overlap,
)
# Questions against the chunks of the whole collection; `ctx` has one row per hit.
SEARCH = f"""WITH RECURSIVE {SMALL_CHUNKS}, {FILES},
    question AS (SELECT item_id AS query_id, text AS query FROM benchmark),
    {embed('q', 'question', 'query_id', 'query')}, {embed('x', 'chunk', 'chunk_id')},
    {top('q', 'x')},
    ctx AS (SELECT query_id, rank, d, c.chunk_id, c.doc_id, c.start_line, c.end_line, c.content,
        '{C.ROOT}/' || rel_path AS path, file.content AS document, {n_tokens('c.content')} AS nt
        FROM hit JOIN chunk c ON c.chunk_id = hit.id
        JOIN file ON CAST(file.doc_id AS VARCHAR) = c.doc_id)"""


def packs(name: str, source: str, budget: int) -> str:
    """CTE `name` (query_id, rank, pack_no): greedy packs of consecutive ranks."""
    return f"""
    {name} AS (
        SELECT query_id, rank, 0 AS pack_no, nt AS used FROM {source} WHERE rank = {{first}}
        UNION ALL
        SELECT n.query_id, n.rank,
            CASE WHEN p.used + n.nt <= {budget} THEN p.pack_no ELSE p.pack_no + 1 END,
            CASE WHEN p.used + n.nt <= {budget} THEN p.used + n.nt ELSE n.nt END
        FROM {name} p JOIN {source} n ON n.query_id = p.query_id AND n.rank = p.rank + 1)"""


PACK1 = packs("pack1", "ctx", C.PACK_BUDGET).format(first=1)
LISTING = f"""{text(SOURCES_HEADER)} || string_agg({NL} || rank || '. ' || path, '' ORDER BY rank)"""
STORED = f"""
    SELECT c.chunk_id, c.doc_id, CAST(chunk_no AS INTEGER) AS chunk_no,
        CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line,
        md5(c.content) AS content_md5, d.lang,
        round(coalesce((SELECT sum(v * (pos + 1)) FROM x WHERE x.id = c.chunk_id), 0), 6) AS vector_check
    FROM chunk c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.doc_id"""
NEW_STATE = """SELECT doc_id, CASE WHEN lang = 'fr' THEN lower(text) ELSE text END AS text
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
GLOBS = values([(p,) for p in C.IGNORE])
PAGES = """page AS (SELECT page_id, regexp_extract(
        regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', 0) AS name FROM pages)"""
SUFFIX = r"regexp_extract(name, '^.+(\.[^.]+)$', 1)"
LAST_EXT = r"'^\.*[^.].*?(\.[^.]*)$'"
BLOCK = (
    f"'// Source: {C.ROOT}/' || rel_path || {NL} || '// Relative path: ' || rel_path"
    f" || {NL} || content || {NL}"
)
BUNDLE = f"""WITH {FILES},
    total AS (SELECT source, CAST(sum(size) AS BIGINT) AS bytes FROM file GROUP BY source),
    block AS (SELECT source AS dir, rel_path, {BLOCK} AS block, bytes FROM file JOIN total USING (source)),
    cut AS (SELECT *, CASE WHEN bytes > {C.PART_BYTES} THEN CAST(sum(strlen(block)) OVER (
            PARTITION BY dir ORDER BY rel_path) - strlen(block) AS BIGINT) // {C.PART_BYTES}
            ELSE 0 END AS cut FROM block),
    placed AS (SELECT *, dense_rank() OVER (PARTITION BY dir ORDER BY cut) - 1 AS part_no FROM cut),
    bundle AS (SELECT dir, part_no, count(*) AS n_files,
        string_agg(block, {NL} ORDER BY rel_path) AS text FROM placed GROUP BY dir, part_no)"""


def follow_up(asked: str) -> str:
    """conversations plus a question and an answer each; asked: conv_id, ask_no, query, response."""
    return f"""
    WITH asked AS ({asked}),
    last AS (SELECT conv_id, max(turn) AS l FROM conversations GROUP BY conv_id),
    numbered AS (SELECT a.*, coalesce(l + 1, 0)
        + 2 * (row_number() OVER (PARTITION BY a.conv_id ORDER BY ask_no) - 1) AS f
        FROM asked a LEFT JOIN last ON last.conv_id = a.conv_id)
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT conv_id, f, 'user', query FROM numbered
    UNION ALL SELECT conv_id, f + 1, 'assistant', response FROM numbered"""


def oracle_sql() -> dict[str, str]:
    squared = SQUARED.format(a="q.v", b="x.v")
    dot = DOT.format(a="q.v", b="x.v")
    types = values(mime.mime_rows())
    shorts = values([(a, b[: b.index(".", 1)]) for a, b in mime.compound_rows()])
    packed = ", ".join(text(e) for e in mime.encodings())
    # The other engine's patterns never go back, so possessive runs are plain ones there.
    rules = values([(n.lower(), p.replace("++", "+").replace("*+", "*"), w) for n, _, p, w in language.RULES])
    excluded = values([(p,) for p in C.EXCLUDED])
    included = ", ".join(text(e) for e in C.INCLUDED)
    return {
        "knn_l2_top5": neighbours(squared, "k", "distance"),
        "similarity_cosine": neighbours(f"-({COSINE})", "-k", "score"),
        "similarity_dot": neighbours(f"-({dot})", "-k", "score"),
        "similarity_euclidean": neighbours(f"sqrt({squared})", "0 - k", "score"),
        "pair_similarity": f"""
    WITH e AS ({VEC}), f AS (SELECT label, arg_min(v, vec_id) AS v FROM e GROUP BY label)
    SELECT q.vec_id, round({COSINE}, 6) AS cosine, round({dot}, 6) AS dot,
        round(0 - sqrt({squared}), 6) AS euclidean, round({squared}, 6) AS squared_l2
    FROM e q JOIN f x USING (label)""",
        "similar_pairs": f"""
    WITH e AS ({VEC})
    SELECT q.vec_id AS left_id, x.vec_id AS right_id, round({COSINE}, 6) AS score
    FROM e q JOIN e x ON q.vec_id < x.vec_id
    WHERE {DOT.format(a='q.v', b='q.v')} > 0 AND {DOT.format(a='x.v', b='x.v')} > 0 AND {COSINE} >= {C.PAIR_COSINE}""",
        "normalize_vectors": f"""
    WITH e AS ({VEC}),
    u AS (SELECT vec_id, sqrt({DOT.format(a='v', b='v')}) AS n, v FROM e)
    SELECT vec_id, round(n, 6) AS norm,
        round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS unit_norm,
        round(v[1] / n, 6) AS first, len(v) AS dim FROM u""",
        "knn_single_query": f"""
    WITH e AS ({VEC}), q AS (SELECT v FROM e ORDER BY vec_id LIMIT 1),
    d AS (SELECT x.vec_id, {squared} AS k FROM q CROSS JOIN e x)
    SELECT vec_id, round(k, 9) AS distance FROM d ORDER BY round(k, 9), vec_id LIMIT 10""",
        "vector_info": """
    SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim
    FROM embeddings""",
        "chunk_lines": f"""
    WITH RECURSIVE {chunks("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents", 60, 15)}
    SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_no,
        CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line,
        CAST(n_tokens AS BIGINT) AS n_tokens, md5(content) AS content_md5 FROM chunk""",
        "chunk_windows": f"""
    WITH t AS (SELECT doc_id,
        list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda x: x <> '') AS ts FROM documents),
    k AS (SELECT doc_id, ts, unnest(generate_series(0, CAST(greatest(1,
        ceil(greatest(0, len(ts) - 16) / 48.0)) AS BIGINT) - 1)) AS chunk_no FROM t)
    SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no,
        md5(coalesce(array_to_string(ts[chunk_no * 48 + 1 : chunk_no * 48 + 64], ' '), '')) AS content_md5
    FROM k""",
        "chunk_links": f"""
    WITH RECURSIVE {chunks("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents",
                           WEB_CHUNK_SIZE, WEB_CHUNK_OVERLAP)}
    SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk_id,
        lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id
    FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)""",
        "line_tokens": f"""
    WITH l AS (SELECT doc_id, unnest(str_split(text, {NL})) AS line,
        generate_subscripts(str_split(text, {NL}), 1) AS line_no FROM documents),
    t AS (SELECT doc_id, line_no, greatest(1, {n_tokens('line')}) AS n FROM l)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(n AS BIGINT) AS n_tokens,
        CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS running_tokens FROM t""",
        "hash_embed": f"""
    WITH {embed('x', 'documents', 'doc_id', 'text')}
    SELECT id AS doc_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM x""",
        "similar_passages": f"""
    WITH {embed('q', 'benchmark', 'item_id', 'text')}, {embed('x', 'documents', 'doc_id', 'text')},
    {top('q', 'x')}
    SELECT query_id, rank, id AS doc_id, round(d, 9) AS distance FROM hit""",
        "similar_code": f"""{SEARCH}
    SELECT query_id, rank, chunk_id, CAST(start_line AS INTEGER) AS start_line,
        CAST(end_line AS INTEGER) AS end_line, md5(document) AS document_md5,
        round(d, 9) AS score FROM ctx""",
        "ask_sources": f"""{SEARCH}
    SELECT query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS sources, count(*) AS n_sources
    FROM ctx GROUP BY query_id""",
        "ask_answers": f"""{SEARCH}
    SELECT query_id, 'ok' AS status,
        md5(string_agg(content, {NL} || {NL} ORDER BY rank) || {LISTING}) AS response_md5,
        count(*) AS n_sources, CAST(0 AS DOUBLE) AS confidence
    FROM ctx GROUP BY query_id""",
        "context_pack": f"""{SEARCH}, {PACK1}
    SELECT query_id, rank, CAST(pack_no AS INTEGER) AS pack_no, CAST(nt AS BIGINT) AS n_tokens
    FROM pack1 JOIN ctx USING (query_id, rank)""",
        # The digests of at most five packs have one token each: they fit one more pack.
        "summary_tree": f"""{SEARCH}, {PACK1},
    one AS (SELECT query_id, pack_no,
        md5(string_agg(content, {NL} || {NL} ORDER BY rank)) AS said
        FROM pack1 JOIN ctx USING (query_id, rank) GROUP BY query_id, pack_no)
    SELECT query_id, CASE WHEN count(*) = 1 THEN max(said)
        ELSE md5(string_agg(said, {NL} || {NL} ORDER BY pack_no)) END AS response
    FROM one GROUP BY query_id""",
        "ask_failures": f"""{SEARCH}, {PACK1},
    one AS (SELECT query_id, pack_no,
        md5(string_agg(content, {NL} || {NL} ORDER BY rank)) AS said
        FROM pack1 JOIN ctx USING (query_id, rank) GROUP BY query_id, pack_no),
    told AS (SELECT query_id, CASE WHEN count(*) = 1 THEN max(said)
        ELSE md5(string_agg(said, {NL} || {NL} ORDER BY pack_no)) END AS response
        FROM one GROUP BY query_id)
    SELECT query_id, CASE WHEN length(b.text) % 2 = 1 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN length(b.text) % 2 = 1 THEN {text(ERROR_PREFIX)} || 'refused ' || query_id
        ELSE response END AS response
    FROM told JOIN benchmark b ON b.item_id = query_id""",
        "source_listing": f"""{SEARCH}
    SELECT query_id, {LISTING} AS listing FROM ctx GROUP BY query_id""",
        "save_load_roundtrip": f"""
    WITH RECURSIVE {SMALL_CHUNKS}, {embed('x', 'chunk', 'chunk_id')} {STORED}""",
        "index_manifest": f"""
    WITH RECURSIVE {SMALL_CHUNKS}
    SELECT 'hash-{C.DIM}' AS model_name, {C.DIM} AS embedding_dimension, true AS is_initialized,
        {C.SMALL.chunk_size} AS chunk_size, {C.SMALL.chunk_overlap} AS chunk_overlap,
        (SELECT count(*) FROM documents) AS n_documents, count(*) AS n_chunks FROM chunk""",
        "refresh_plan": f"""
    WITH o AS (SELECT doc_id, text FROM documents WHERE lang <> 'es'), n AS ({NEW_STATE})
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
        CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
            WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS state
    FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id""",
        "refresh_index": f"""
    WITH RECURSIVE n AS ({NEW_STATE}),
    {chunks("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM n",
            C.SMALL.chunk_size, C.SMALL.chunk_overlap)},
    {embed('x', 'chunk', 'chunk_id')} {STORED}""",
        "refresh_chain": f"""
    WITH RECURSIVE n AS ({NEW_STATE}),
    {chunks("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM n",
            C.SMALL.chunk_size, C.SMALL.chunk_overlap)},
    {embed('x', 'chunk', 'chunk_id')}, stored AS ({STORED})
    SELECT stored.*, s.stage FROM stored CROSS JOIN (VALUES ('delta'), ('compacted')) s(stage)""",
        "corpus_profile": """
    SELECT lang, source, CAST(CASE WHEN GROUPING(lang) = 1 THEN 3 WHEN GROUPING(source) = 1 THEN 1
        ELSE 0 END AS BIGINT) AS grouping,
        count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS size
    FROM documents GROUP BY ROLLUP (lang, source)""",
        "chunk_profile": f"""
    WITH RECURSIVE {SMALL_CHUNKS}, {FILES}
    SELECT f.lang, f.ext, CAST(CASE WHEN GROUPING(f.lang) = 1 THEN 3 WHEN GROUPING(f.ext) = 1 THEN 1
        ELSE 0 END AS BIGINT) AS grouping, count(DISTINCT f.doc_id) AS n_files,
        count(*) AS n_chunks, CAST(sum(c.n_tokens) AS BIGINT) AS n_tokens
    FROM chunk c JOIN file f ON CAST(f.doc_id AS VARCHAR) = c.doc_id GROUP BY ROLLUP (f.lang, f.ext)""",
        "load_status": f"""
    SELECT count(*) AS n_documents, 'ok' AS status,
        '{SUCCESS_PREFIX}' || count(*) || '{SUCCESS_SUFFIX}' AS message FROM documents""",
        "file_extensions": f"""
    WITH {PAGES}, {FILES}
    SELECT DISTINCT {SUFFIX} AS ext FROM (SELECT name FROM page UNION ALL SELECT name FROM file)""",
        "mime_types": f"""
    WITH {PAGES}, {FILES}, types(e, m) AS (VALUES {types}), shorts(s, k) AS (VALUES {shorts}),
    item AS (SELECT 'page' || page_id AS id, name FROM page
        UNION ALL SELECT 'doc' || doc_id, name FROM file),
    ends AS (SELECT id, name, regexp_extract(name, {LAST_EXT}, 1) AS last,
        regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), {LAST_EXT}, 1) AS inner_end FROM item)
    SELECT id, name, coalesce(m, '{DEFAULT_MIME}') AS mime
    FROM ends LEFT JOIN shorts ON s = lower(last)
    LEFT JOIN types ON e = coalesce(k, CASE WHEN last IN ({packed}) THEN lower(inner_end) ELSE lower(last) END)""",
        "language_labels": f"""
    WITH rules(lang, rx, w) AS (VALUES {rules}),
    item AS (SELECT 'page' || page_id AS id, html AS content FROM pages
        UNION ALL SELECT 'doc' || doc_id, text FROM documents),
    score AS (SELECT id, lang, sum(w) AS s FROM item, rules WHERE regexp_matches(content, rx)
        GROUP BY id, lang),
    best AS (SELECT id, lang, row_number() OVER (PARTITION BY id ORDER BY s DESC, lang) AS n FROM score)
    SELECT item.id, coalesce(lang, 'unknown') AS language
    FROM item LEFT JOIN best ON best.id = item.id AND n = 1""",
        "ignore_filter": f"""
    WITH {FILES}, rule(p) AS (VALUES {GLOBS})
    SELECT doc_id, rel_path FROM file WHERE NOT EXISTS (
        SELECT 1 FROM rule WHERE rel_path GLOB p OR (p LIKE '%/' AND rel_path || '/' GLOB p))""",
        "ignore_prune": f"""
    WITH {FILES}, rule(p) AS (VALUES {GLOBS}),
    step AS (SELECT doc_id, array_to_string(str_split(rel_path, '/')[1:i], '/') AS part
        FROM file, unnest(generate_series(1, len(str_split(rel_path, '/')))) AS g(i)),
    hit AS (SELECT DISTINCT doc_id FROM step, rule
        WHERE part GLOB p OR (p LIKE '%/' AND part || '/' GLOB p))
    SELECT doc_id, rel_path FROM file WHERE doc_id NOT IN (SELECT doc_id FROM hit)""",
        "project_filter": f"""
    WITH {FILES}, rule(p) AS (VALUES {excluded}),
    part AS (SELECT doc_id, unnest(str_split(rel_path, '/')) AS c FROM file),
    hit AS (SELECT DISTINCT doc_id FROM part, rule WHERE c GLOB p)
    SELECT doc_id, rel_path, size FROM file
    WHERE ext IN ({included}) AND size <= {C.MAX_SIZE} AND doc_id NOT IN (SELECT doc_id FROM hit)""",
        "files_per_folder": f"WITH {FILES} SELECT dir, count(*) AS n_files FROM file GROUP BY dir",
        "bundle_by_directory": f"""{BUNDLE}
    SELECT dir, part_no, n_files, md5(text) AS text_md5 FROM bundle""",
        "scan_tree": f"""
    WITH {FILES} SELECT rel_path, dir, name, ext, strlen(content) AS size, sha256(content) AS content_sha FROM file""",
        "tree_names": f"""
    WITH {FILES} SELECT rel_path, dir, name, ext, strlen(content) AS size FROM file""",
        "written_bundles": f"""{BUNDLE}
    SELECT 'concated/' || dir || '/' || dir || '_concatenated'
        || CASE WHEN part_no > 0 THEN '.part' || lpad(CAST(part_no AS VARCHAR), 5, '0') ELSE '' END
        || '.py' AS rel_path, n_files,
        md5(CASE WHEN part_no > 0 THEN {NL} ELSE '' END || text) AS text_md5 FROM bundle""",
        "history_append": follow_up(
            f"SELECT item_id AS conv_id, 0 AS ask_no, text AS query, {text(NO_INDEX_MESSAGE)} AS response FROM benchmark"
        ),
        "history_replay": follow_up(
            "SELECT conv_id, turn AS ask_no, text AS query, text AS response FROM conversations WHERE role = 'user'"
        ),
        "history_clear": """
    SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (
        SELECT conv_id FROM conversations WHERE role = 'system')""",
    }
