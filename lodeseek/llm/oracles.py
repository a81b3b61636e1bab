"""DuckDB SQL for the opN queries that SQL can express."""

from lodeseek.llm.licences import _SUBJECT, _VERB, COMMENT, NAMES, RULES, SENTENCES, SPDX, SPDX_MORE, SPDX_NAMES, TRIGGER, _known, _tags
from lodeseek.llm.queries import SPAM

ORACLES: dict[str, str] = {}

ORACLES["op2_line_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs
), worded AS (
  SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER o AS last, line AS l1, lead(line) OVER o AS l2, lead(line, 2) OVER o AS l3
  FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, first, last, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, first) AS turn FROM w WHERE last IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM ranked WHERE turn > 1
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text, count(*) AS n
  FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, (len(d.lines) - coalesce(k.n, 0))::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _licence_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in _known().items())
    # Marks: chr(1) where a sentence may end, chr(2) where it does. Doubled, so that neighbours don't share one.
    either = lambda texts: "|".join(sorted(texts, key=len, reverse=True)).replace(".", r"\.").replace("+", r"\+")
    said = f"(?:{_SUBJECT[1:]})?(?:{either([*SENTENCES, *_tags()])}|(?:{_VERB[1:]}|under )(?:{either(NAMES)})(?: the licen[sc]e)?)"
    said = said.replace("(the", "(?:the").replace("(this", "(?:this").replace("(work", "(?:work").replace("(is", "(?:is").replace("(terms", "(?:terms").replace("(licensed", "(?:licensed")
    said = said.replace(" ", r"(?: |\x01\x01)")
    cut = "coalesce(text, '')"
    for old, new in (
        (COMMENT, ""), *[(SPDX_MORE, r"\1\2\x02\1")] * (SPDX_NAMES - 1), (SPDX, r"\x02\1\2\x02"), (r"([.!?])[ \t\r\n]+", r"\1\x02"),
        (r"\n[ \t\r]*\n", r"\x02\n"), (r"[;:][ \t\r\n]+", r"\x01"), (r"\n([ \t\r]*[A-Z0-9])", r"\x01\1"),
    ):
        new = "'" + new.replace(r"\x01", "' || chr(1) || '").replace(r"\x02", "' || chr(2) || '").replace(r"\n", "' || chr(10) || '") + "'"
        cut = f"regexp_replace({cut}, '{old}', {new}, 'g')"
    sql = rf"""
WITH cut AS (
  SELECT doc_id, chr(2) || regexp_replace(lower({cut}), '[^a-z0-9.+\x01\x02]+', ' ', 'g') || chr(2) AS s
  FROM documents WHERE regexp_matches(text, '{TRIGGER}')
), plain AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(s, '\.([ \x01\x02])', '\1', 'g'), '[ \x01]*\x02[ \x01]*', chr(2), 'g'), ' *\x01[ \x01]*', chr(1), 'g') AS s FROM cut
), found AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(s, '([\x01\x02])', '\1\1', 'g'), '[\x01\x02]({said})[\x01\x02]', 1) AS parts FROM plain
), s AS (
  SELECT doc_id, replace(unnest(parts), chr(1) || chr(1), ' ') AS s, unnest(range(len(parts))) AS i FROM found
), stated AS (
  SELECT doc_id, i, s, regexp_replace(regexp_replace(regexp_replace(s, '{_SUBJECT}', ''), '{_VERB}', 'under '), ' the licen[sc]e$', '') AS t FROM s
), known(s, name) AS (VALUES {known}), named AS (
  SELECT doc_id, i, coalesce(a.name, b.name) AS name FROM stated LEFT JOIN known a USING (s) LEFT JOIN known b ON stated.t = b.s
), ids AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY i) AS ids, '|' || string_agg(name, '||' ORDER BY i) || '|' AS seq
  FROM named WHERE name IS NOT NULL GROUP BY doc_id
), r0 AS (SELECT doc_id, n, ids, seq, []::VARCHAR[] AS found FROM ids)"""
    for k, (seq, licence) in enumerate(RULES):
        pattern = "|" + "||".join(seq) + "|"
        sql += f""", r{k + 1} AS (
  SELECT doc_id, n, ids, replace(seq, '{pattern}', '||') AS seq,
    CASE WHEN contains(seq, '{pattern}') AND NOT list_contains(found, '{licence}') THEN list_append(found, '{licence}') ELSE found END AS found FROM r{k})"""
    return sql + f"""
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licences
FROM documents d LEFT JOIN r{len(RULES)} USING (doc_id)
"""


ORACLES["op3_licences"] = _licence_sql()


def _url_sql() -> str:
    rows = ", ".join(
        f"('spam', 'd:{name}.example.{zone}', 'block', TIMESTAMP '{day}', '{action}')"
        for name, since, until in SPAM for zone in ("com", "net", "org")
        for day, action in ((since, "add"), (until, "remove")) if day
    )
    return rf"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id % 366)::INT) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host
  FROM pages
), h AS (
  SELECT host, ('0x' || substr(md5(host), 1, 6))::INT AS n FROM (SELECT DISTINCT host FROM p WHERE host <> '')
), entries(list, key, verdict, since, action) AS (
  SELECT * FROM (VALUES {rows})
  UNION ALL SELECT 'hosts', 'd:' || host, 'block', TIMESTAMP '2024-01-01' + to_days(n % 180), 'add' FROM h WHERE n % 7 = 0
  UNION ALL SELECT 'hosts', 'd:' || host, 'block', TIMESTAMP '2024-01-01' + to_days(n % 180 + 90), 'remove' FROM h WHERE n % 7 = 0
  UNION ALL SELECT 'allowed', 'd:' || host, 'allow', TIMESTAMP '2024-01-01' + to_days(182), 'add' FROM h WHERE n % 7 <> 0 AND n % 3 = 0
), spans AS (
  SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS until FROM entries) WHERE action = 'add'
), labels AS (
  SELECT page_id, fetched, string_split(host, '.') AS parts FROM p WHERE host <> ''
), looked AS (
  SELECT page_id, fetched, 'd:' || array_to_string(parts[k:], '.') AS key FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM labels)
), active AS (
  SELECT page_id, key, verdict, row_number() OVER (PARTITION BY page_id ORDER BY -length(key), verdict, list, key) AS turn,
         count(*) OVER (PARTITION BY page_id) AS n
  FROM looked JOIN spans USING (key) WHERE since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT p.page_id, p.url, coalesce(a.n, 0)::BIGINT AS n_active, a.key AS matched, coalesce(a.verdict = 'block', FALSE) AS blocked
FROM p LEFT JOIN active a ON p.page_id = a.page_id AND a.turn = 1
"""


ORACLES["op8_url_filter"] = _url_sql()

ORACLES["op5_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

ORACLES["op6_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS fullest
  FROM by_source
), steps AS (
  SELECT *,
         sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(fullest) OVER w, 0) AS remains,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights_left
  FROM weighted
  WINDOW w AS (ORDER BY fullest / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT remains, weights_left FROM steps WHERE fullest * weights_left > remains * weight ORDER BY fullest / weight LIMIT 1
), targets AS (
  SELECT source, source_size, least(fullest, coalesce((SELECT remains FROM level) * weight / (SELECT weights_left FROM level), fullest)) AS target
  FROM steps
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
