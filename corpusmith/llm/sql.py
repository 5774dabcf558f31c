"""The same results in SQL for another engine, where SQL can express them.

Left to brute-force tests: op1 (Markov models), op5 (expectation-maximisation), op6 and op7
(hash thresholds and a binary search).
"""

from __future__ import annotations

from .chat import END, PART_TURNS, SYSTEM
from .decontam import WINDOW as ITEM_WINDOW
from .lines import BLOCK, HIDDEN, MIN_PAGES, RATIO, TAG
from .phrases import WINDOW as PHRASE_WINDOW
from .quality import (
    CLASSES, COMMON, MIN_CHARS, MIN_COMPARED_WORDS, MIN_WORDS, MOST_CHAR_DISTANCE, MOST_REPEATED,
    MOST_WORD_DISTANCE, SYMBOLS, WINDOW as REPEAT_WINDOW,
)
from .words import WORD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _words(text: str, pattern: str = WORD) -> str:
    return f"coalesce(regexp_extract_all({text}, {_lit(pattern)}), []::VARCHAR[])"


def _runs(words: str, size: str) -> str:
    """Every run of `size` words as one text, in order."""
    return f"list_transform(range(1, len({words}) - {size} + 2), lambda i: array_to_string({words}[i:i + {size} - 1], ' '))"


def _chat() -> str:
    def safe(text: str) -> str:
        return f"replace({text}, '<|', '< |')"

    return rf"""
    WITH turns AS (
        SELECT conv_id, role, turn, {safe("coalesce(text, '')")} AS text,
            coalesce(floor(turn / {PART_TURNS})::BIGINT, -1) AS part
        FROM conversations
    ), people AS (
        SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> '{SYSTEM}' AND role <> ''
    ), headed AS (
        SELECT t.*, p.perspective,
            CASE WHEN role = '{SYSTEM}' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>'
                WHEN coalesce(role, '') = '' THEN '<|user|>'
                ELSE '<|user name=' || {safe("role")} || '|>' END || chr(10) AS head
        FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
    ), pieces AS (
        SELECT *, head || text || {_lit(END.strip())} || chr(10) AS piece,
            row_number() OVER (PARTITION BY conv_id, perspective, part
                ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS n
        FROM headed
    ), placed AS (
        SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY n) AS past FROM pieces
    )
    SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY n) AS rendered,
        coalesce(list((past - length(piece) + length(head))::INT ORDER BY n) FILTER (role = perspective), []) AS mask_starts,
        coalesce(list(past::INT ORDER BY n) FILTER (role = perspective), []) AS mask_ends
    FROM placed GROUP BY conv_id, perspective, part
    """


def _phrases() -> str:
    return f"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents
    ), windows AS (
        SELECT r, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT r, {_runs("w", str(PHRASE_WINDOW))} AS h FROM texts)
    ), repeated AS (
        SELECT h FROM windows GROUP BY h HAVING count(*) > 1
    ), gone AS (
        SELECT DISTINCT r, i + k AS p
        FROM windows JOIN repeated USING (h) CROSS JOIN (SELECT unnest(range({PHRASE_WINDOW})) AS k)
    ), kept AS (
        SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
        FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts) ANTI JOIN gone USING (r, p)
        GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed,
        sha256(coalesce(text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (r)
    """


def _jaccard() -> str:
    return f"""
    WITH RECURSIVE texts AS (
        SELECT row_number() OVER () AS r, doc_id, {_words(_lowered("text"))} AS w FROM documents
    ), sets AS MATERIALIZED (
        SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
            WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_runs("w", "5")} END)) AS s
        FROM texts
    ), kinds AS MATERIALIZED (
        SELECT min(r) AS k, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
    ), items AS MATERIALIZED (
        SELECT k, n, unnest(s) AS g FROM kinds
    ), links AS MATERIALIZED (
        SELECT a.k, b.k AS other FROM items a JOIN items b ON a.g = b.g AND a.k <> b.k
            AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reach(k, other) AS (
        SELECT k, k FROM kinds
        UNION
        SELECT reach.k, links.other FROM reach JOIN links ON links.k = reach.other
    ), least_id AS (
        SELECT reach.k, min(sets.doc_id) AS component_id
        FROM reach JOIN kinds ON kinds.k = reach.other JOIN sets USING (s) GROUP BY reach.k
    )
    SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM sets LEFT JOIN kinds ON sets.s = kinds.s LEFT JOIN least_id ON kinds.k = least_id.k
    """


def _site_lines() -> str:
    text = "coalesce(html, '')"
    for pattern, by in ((HIDDEN, "chr(10)"), (BLOCK, "chr(10)"), (TAG, "''")):
        text = f"regexp_replace({text}, {_lit(pattern)}, {by}, 'g')"
    return rf"""
    WITH read AS (
        SELECT row_number() OVER () AS r, page_id,
            nullif({_lowered(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
            list_filter(list_transform(regexp_split_to_array({text}, '[\r\n]+'),
                lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'))), lambda s: s <> '') AS lines
        FROM pages
    ), totals AS (
        SELECT host, count(*) AS pages FROM read WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= {MIN_PAGES}
    ), common AS (
        SELECT host, line
        FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM read) JOIN totals USING (host)
        GROUP BY host, line, pages HAVING count(*) > {RATIO} * pages
    ), kept AS (
        SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text
        FROM (SELECT r, host, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM read)
            ANTI JOIN common USING (host, line)
        GROUP BY r
    )
    SELECT page_id, host, len(lines)::BIGINT AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped,
        coalesce(text, '') AS kept_text
    FROM read LEFT JOIN kept USING (r)
    """


def _overlap() -> str:
    words = _words(_lowered("text"), NORMAL_WORD)
    return f"""
    WITH items AS (
        SELECT item, w, least({ITEM_WINDOW}, len(w)) AS size
        FROM (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark) WHERE len(w) > 0
    ), wanted AS (
        SELECT DISTINCT item, size, unnest({_runs("w", "size")}) AS h FROM items
    ), texts AS (
        SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
    ), windows AS (
        SELECT r, size, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT r, size, {_runs("w", "size")} AS h
            FROM texts CROSS JOIN (SELECT DISTINCT size FROM items) WHERE len(w) >= size)
    ), found AS (
        SELECT r, size, i, item FROM windows JOIN wanted USING (size, h)
    ), hit AS (
        SELECT r, count(DISTINCT p) AS n
        FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r
    ), of_text AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
    FROM texts LEFT JOIN hit USING (r) LEFT JOIN of_text USING (r)
    """


def _quality() -> str:
    known = "CASE lang " + " ".join(
        f"WHEN '{code}' THEN [{', '.join(map(_lit, listed))}]" for code, listed in COMMON.items()
    ) + " END"
    rests = ["t"]
    for pattern in CLASSES:
        rests.append(f"regexp_replace({rests[-1]}, {_lit(pattern)}, '', 'g')")
    lengths = [f"length({r})" for r in rests]
    classes = ", ".join([f"{a} - {b}" for a, b in zip(lengths, lengths[1:])] + [lengths[-1]])
    most = max(map(len, COMMON.values()))

    def distance(p: str, q: str) -> str:
        def term(a: str) -> str:
            return f"if({a} > 0, {a} * log2({a} / ((z[1] + z[2]) / 2)), 0)"

        shares = [f"list_transform({x}, lambda x: x / list_sum({x}))" for x in (p, q)]
        total = f"list_sum(list_transform(list_zip({shares[0]}, {shares[1]}), lambda z: ({term('z[1]')} + {term('z[2]')}) / 2))"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({total}, 0)) END"

    def means(name: str, n: int) -> str:
        return "[" + ", ".join(f"coalesce(avg({name}[{i}] / list_sum({name})), 0)" for i in range(1, n + 1)) + "]"

    return rf"""
    WITH texts AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_words("text")} AS w, {known} AS known
        FROM documents
    ), windows AS (
        SELECT r, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT r, {_runs("w", str(REPEAT_WINDOW))} AS h FROM texts)
    ), repeats AS (
        SELECT r, count(DISTINCT i + k) AS n
        FROM windows JOIN (SELECT r, h FROM windows GROUP BY r, h HAVING count(*) > 1) USING (r, h)
            CROSS JOIN (SELECT unnest(range({REPEAT_WINDOW})) AS k)
        GROUP BY r
    ), measured AS MATERIALIZED (
        SELECT r, doc_id, lang, len(w)::BIGINT AS n_words,
            length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
            len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            coalesce(n, 0) AS n_repeat_words,
            CASE WHEN length(t) >= {MIN_CHARS} THEN [{classes}]::DOUBLE[] END AS chars,
            CASE WHEN len(w) >= {MIN_COMPARED_WORDS} AND known IS NOT NULL THEN list_append(
                list_transform(range(1, {most + 1}), lambda k: len(list_filter(found, lambda x: x = known[k]))),
                len(w) - len(found))::DOUBLE[] END AS words
        FROM (
            SELECT *, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
                list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains(known, x)) AS found
            FROM texts
        ) LEFT JOIN repeats USING (r)
    ), refs AS (
        SELECT lang, {means("chars", len(CLASSES) + 1)} AS r_chars, {means("words", most + 1)} AS r_words
        FROM measured GROUP BY lang
    ), judged AS (
        SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
            {distance("chars", "r_chars")} AS char_distance, {distance("words", "r_words")} AS word_distance
        FROM measured m LEFT JOIN refs ON m.lang IS NOT DISTINCT FROM refs.lang
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND coalesce(char_distance <= {MOST_CHAR_DISTANCE}, true)
            AND coalesce(word_distance <= {MOST_WORD_DISTANCE}, true) AS kept,
        char_distance, word_distance
    FROM judged
    """


SQL: dict[str, str] = {
    "op2_chat_rotation": _chat(),
    "op3_repeated_phrases": _phrases(),
    "op4_ngram_jaccard": _jaccard(),
    "op8_site_lines": _site_lines(),
    "op9_benchmark_overlap": _overlap(),
    "op10_quality_rules": _quality(),
}
