"""DuckDB SQL for the whole result of operator 4, written from its definition: statements, cosines, weighing, inheritance."""

from __future__ import annotations

from fathomline.llm.licenses import BLANK, FILE_SHARE, MIN_COSINE, NAME, SIGN, SPDX, TELLING, TEMPLATES

#: White space of Java's regular expressions; a private-use character that stands where texts are cut.
_SPACE, _CUT = r"[ \t\n\x0B\f\r]", "chr(1114109)"
#: The pattern of the Spark side without its possessive sign, which changes no match.
_BLANK = BLANK.replace("++", "+")
_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
_VALUES = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
_TAGS = ", ".join(f"('{name.lower()}', '{name}')" for name in sorted({name for name, _ in TEMPLATES}))


def _words(column: str) -> str:
    return f"len(regexp_split_to_array(trim({column}, ' '), '{_SPACE}+'))"


def _folder(column: str) -> str:
    return f"array_to_string(list_filter(string_split(regexp_replace({column}, '/?[^/]*$', ''), '/'), lambda p: p <> ''), '/')"


def _part(column: str) -> str:
    return f"replace(coalesce({column}, 'unknown'), '/', '_')"


SQL = f"""
    WITH base AS MATERIALIZED (
        SELECT doc_id AS file_id, coalesce(text, '') AS text,
               {_part("source")} || '/' || {_part("lang")} || '/' || coalesce(trunc(doc_id / 64)::BIGINT, 0) || '/' || coalesce(doc_id::VARCHAR, 'unnamed') AS path
        FROM documents),
    telling AS MATERIALIZED (SELECT file_id, path, {_words("text")} AS words, text FROM base WHERE regexp_matches(text, '{TELLING}')),
    lines AS (
        SELECT file_id, path, words, 0 AS kind, unnest(string_split(regexp_replace(text, '([.!?;:])(\\n+|{_SPACE}+)|\\n+', '\\1' || {_CUT}, 'g'), {_CUT})) AS statement
        FROM telling),
    paragraphs AS (SELECT file_id, path, words, unnest(string_split(regexp_replace(text, '{_BLANK}', {_CUT}, 'g'), {_CUT})) AS p FROM telling),
    said AS (
        SELECT file_id, path, words, string_split(regexp_replace(regexp_replace(p, '{_SPACE}*\\r?\\n{SIGN}', ' ', 'g'), '([.!?;]){_SPACE}+', '\\1' || {_CUT}, 'g'), {_CUT}) AS s
        FROM paragraphs),
    places AS (SELECT *, unnest(range(1, greatest(len(s) - n + 1, 1) + 1)) AS i FROM said, (VALUES (1), (2), (3)) w(n)),
    hits AS MATERIALIZED (
        SELECT * FROM (
            SELECT * FROM lines
            UNION ALL SELECT file_id, path, words, least(n, 2) AS kind, array_to_string(s[i : i + n - 1], ' ') AS statement FROM places)
        WHERE regexp_matches(statement, '{TELLING}')),
    statements AS MATERIALIZED (SELECT DISTINCT statement AS text FROM hits),
    templates(t, license, text) AS (VALUES {_VALUES}),
    counted AS MATERIALIZED (SELECT text AS s, term, count(*) AS tf FROM (SELECT text, unnest({_TERMS}) AS term FROM statements) GROUP BY ALL),
    template_terms AS MATERIALIZED (SELECT t, term, count(*) AS tf FROM (SELECT t, unnest({_TERMS}) AS term FROM templates) GROUP BY ALL),
    total AS (SELECT (SELECT count(*) FROM statements) + (SELECT count(*) FROM templates) AS n),
    frequency AS MATERIALIZED (
        SELECT term, count(s) + 1 AS df FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN counted USING (term) GROUP BY term),
    statement_raw AS (SELECT s, term, tf * (ln((total.n + 1.0::DOUBLE) / (coalesce(df, 1) + 1)) + 1) AS w FROM counted LEFT JOIN frequency USING (term), total),
    template_raw AS (SELECT t, term, tf * (ln((total.n + 1.0::DOUBLE) / (df + 1)) + 1) AS w FROM template_terms JOIN frequency USING (term), total),
    statement_norm AS (SELECT s, sqrt(sum(w * w)) AS norm FROM statement_raw GROUP BY s),
    template_norm AS (SELECT t, sqrt(sum(w * w)) AS norm FROM template_raw GROUP BY t),
    dots AS (SELECT a.s, b.t, sum(a.w * b.w) AS dot FROM statement_raw a JOIN template_raw b USING (term) GROUP BY ALL),
    cosines AS (SELECT s, t, round(dot / (x.norm * y.norm), 9) AS cosine FROM dots JOIN statement_norm x USING (s) JOIN template_norm y USING (t)),
    found AS MATERIALIZED (SELECT s, license, max(cosine) AS cosine FROM cosines JOIN templates USING (t) WHERE cosine >= {MIN_COSINE} GROUP BY ALL),
    tags(tag, license) AS (VALUES {_TAGS}),
    spdx AS (
        SELECT file_id, path, words, regexp_replace(unnest(regexp_split_to_array(lower(raw), '(?:{_SPACE}|[()])+')), '(\\+|-only|-or-later)?\\.?$', '') AS tag
        FROM (SELECT file_id, path, words, unnest(regexp_extract_all(text, '{SPDX}', 1)) AS raw FROM telling)),
    matched AS MATERIALIZED (
        SELECT DISTINCT file_id, path, words, kind, statement, license, cosine, {_words("statement")} AS said FROM hits JOIN found ON statement = s
        UNION SELECT file_id, path, words, 0, 'SPDX-License-Identifier: ' || tag, license, 1.0::DOUBLE, 2 FROM spdx JOIN tags USING (tag)),
    weighed AS (SELECT file_id, path, words, license, -round(sum(cosine), 9) AS m, max(cosine) AS cosine FROM matched GROUP BY file_id, path, words, license),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY file_id, path, words ORDER BY m, license) AS among_row, row_number() OVER (PARTITION BY file_id, path ORDER BY m, license, cosine) AS among_file
        FROM weighed),
    spoken AS (
        SELECT file_id, path, words, greatest(coalesce(sum(said) FILTER (kind = 0), 0), coalesce(sum(said) FILTER (kind = 1), 0)) AS said
        FROM (SELECT DISTINCT file_id, path, words, kind, statement, said FROM matched WHERE kind < 2) GROUP BY ALL),
    mostly AS (
        SELECT r.file_id, r.path, bool_or(coalesce(k.said, 0) > {FILE_SHARE} * r.words) AS mostly
        FROM ranked r LEFT JOIN spoken k ON r.file_id IS NOT DISTINCT FROM k.file_id AND r.path = k.path AND r.words = k.words
        WHERE among_row = 1 GROUP BY ALL),
    own AS MATERIALIZED (
        SELECT r.file_id, r.path, license, cosine, mostly
        FROM ranked r JOIN mostly k ON r.file_id IS NOT DISTINCT FROM k.file_id AND r.path = k.path WHERE among_file = 1),
    folders AS (
        SELECT dir AS ancestor, license AS near_license, cosine AS near_cosine
        FROM (SELECT {_folder("path")} AS dir, license, cosine, file_id FROM own WHERE mostly OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{NAME}'))
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY -cosine, file_id NULLS FIRST, license) = 1),
    dirs AS (SELECT DISTINCT {_folder("path")} AS dir FROM base),
    climbs AS (SELECT dir, unnest(range(0, len(list_filter(string_split(dir, '/'), lambda p: p <> '')) + 1)) AS depth FROM dirs),
    near AS (
        SELECT dir, near_license, near_cosine
        FROM (SELECT dir, depth, array_to_string(string_split(dir, '/')[1 : depth], '/') AS ancestor FROM climbs) JOIN folders USING (ancestor)
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
    SELECT b.file_id AS doc_id, b.path, coalesce(o.license, near_license) AS license, round(coalesce(o.cosine, near_cosine), 6) AS cosine,
           CASE WHEN o.license IS NOT NULL THEN 'own' WHEN near_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
    FROM base b LEFT JOIN near ON near.dir = {_folder("b.path")}
    LEFT JOIN own o ON b.file_id IS NOT DISTINCT FROM o.file_id AND b.path = o.path"""
