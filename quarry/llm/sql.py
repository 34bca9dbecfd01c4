"""The queries that DuckDB can say too. Written from the definitions, by plainer ways: whole lists of
turns are compared, all shingles are joined, the model's sums are unrolled."""

from __future__ import annotations

import string

from quarry.llm import chat_format, decontaminate, url_filter

WORD = r"'[^\x20\x09-\x0D]+'"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {WORD}) AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD})) AS ls FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT r, i, word, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM u
      WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM t WHERE c IS NOT NULL)
          WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             coalesce(list_sum(list_transform(ls, lambda x: strlen(x))), 0)
               - coalesce(list_sum(list_transform(list_distinct(ls), lambda x: strlen(x))), 0) AS dup_bytes,
             strlen(text) AS bytes,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bare,
             len(regexp_extract_all(text, '[A-Z]')) AS upper_, len(regexp_extract_all(text, '[A-Za-z]')) AS letters
      FROM w LEFT JOIN covered ON covered.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * dup_bytes > 30 * bytes
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * bare > 20 * n_words OR 100 * upper_ > 40 * letters) AS kept
FROM b
"""

OP5 = f"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                                     coalesce(text, '')) AS p
           FROM conversations),
c AS (SELECT conv_id, list([role, text] ORDER BY p) AS turns, count(*) AS n FROM t GROUP BY conv_id),
k AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n),
m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > k.n AND c.turns[1:k.n] = k.turns))
SELECT t.conv_id, ((t.p - 1) // {chat_format.TURNS_PER_ROW})::BIGINT AS part, any_value(m.n)::BIGINT AS n_turns,
       any_value(m.copies)::BIGINT AS copies,
       string_agg('{chat_format.OPEN}' || role || chr(10) || text || '{chat_format.CLOSE}' || chr(10), '' ORDER BY p) AS text
FROM t JOIN m ON m.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id, part
"""

OP10 = rf"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark),
j AS (SELECT row_number() OVER () AS item, item_id, ws, least(len(ws), {decontaminate.SHINGLE}) AS k FROM i WHERE len(ws) > 0),
s AS (SELECT DISTINCT item, item_id, k, array_to_string(ws[x:x + k - 1], ' ') AS shingle
      FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS x FROM j)),
n AS (SELECT item, count(*) AS n FROM s GROUP BY item),
d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws
      FROM (SELECT DISTINCT doc_id, text FROM documents)),
e AS (SELECT doc, doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS x FROM d, (SELECT DISTINCT k FROM s) AS kinds),
f AS (SELECT DISTINCT doc, doc_id, array_to_string(ws[x:x + k - 1], ' ') AS shingle FROM e),
found AS (SELECT doc, doc_id, item, item_id, count(*) AS n_found FROM f JOIN s USING (shingle) GROUP BY ALL),
good AS (SELECT doc_id, item_id, n, n_found FROM found JOIN n USING (item)
         WHERE n_found >= ceil(n * {decontaminate.CONTAINMENT} - 1e-9))
SELECT doc_id, item_id, arg_max(n, [n_found, n])::BIGINT AS n_shingles, max(n_found)::BIGINT AS n_found
FROM good GROUP BY doc_id, item_id
"""


def _url_sql() -> str:
    order, strength = url_filter.ORDER, url_filter.STRENGTH
    rule, said = "NULL", "NULL"
    for name, text in sorted(url_filter.RULES, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"
        rule, said = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{name}' ELSE {said} END"
    tables, joins = [], []
    p = {"a": f"{1 / url_filter.ALPHABET!r}", "r": f"{1 / url_filter.ALPHABET!r}"}
    for k in range(order + 1):
        for kind, size in (("x", k), ("c", k + 1)):
            part = f"substr(gram, {order + 1 - k}, {size})" if size else "''"
            tables.append(f"{kind}{k} AS (SELECT {part} AS part, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1)")
            joins.append(f"LEFT JOIN {kind}{k} ON {kind}{k}.part = {part.replace('gram', 'o.gram')}")
        for side in "ar":
            p[side] = (f"((coalesce(c{k}.{side}, 0)::DOUBLE + {strength} * {p[side]})"
                       f" / (coalesce(x{k}.{side}, 0)::DOUBLE + {strength}))")
    unseen = ", ".join(f"'{x}'" for x in url_filter.UNSEEN)
    grams = (f"unnest(list_transform(range(1, length(text) + 2), lambda i: substr(repeat(chr(2), {order}) || text || chr(3),"
             f" i, {order + 1})))")
    return f"""
WITH q AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
rows_ AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said, host || path AS text,
                 substr(md5(host || path), 1, 1) IN ({unseen}) AS unseen FROM h),
both_ AS (SELECT count(*) FILTER (said = 'allow') > 0 AND count(*) FILTER (said = 'block') > 0 AS enough
          FROM rows_ WHERE said IS NOT NULL AND NOT unseen),
g AS (SELECT gram, sum((said = 'allow')::INT) AS a, sum((said = 'block')::INT) AS r
      FROM (SELECT said, {grams} AS gram FROM rows_ WHERE said IS NOT NULL AND NOT unseen AND text <> '') GROUP BY gram),
{", ".join(tables)},
o AS (SELECT text, gram, count(*) AS n FROM (SELECT text, {grams} AS gram FROM
      (SELECT DISTINCT text FROM rows_ WHERE text <> '' AND (said IS NULL OR unseen))) GROUP BY ALL),
llr AS (SELECT o.gram, ln({p["a"]}) - ln({p["r"]}) AS llr FROM (SELECT DISTINCT gram FROM o) AS o {" ".join(joins)}),
score AS (SELECT text, CASE WHEN (SELECT enough FROM both_) THEN sum(n * llr) / sum(n) ELSE 0 END AS score
          FROM o JOIN llr USING (gram) GROUP BY text),
held AS (SELECT floor(greatest(least(coalesce(score, 0), {url_filter.LIMIT}), -{url_filter.LIMIT}) / {url_filter.STEP}) AS place,
                count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r
         FROM rows_ LEFT JOIN score USING (text) WHERE said IS NOT NULL AND unseen GROUP BY 1),
gain AS (SELECT place, place + coalesce(lag(place) OVER (ORDER BY place) + 1, place) AS twice,
                coalesce(sum(r) OVER w, 0) / nullif(sum(r) OVER (), 0)
                     - coalesce(sum(a) OVER w, 0) / nullif(sum(a) OVER (), 0) AS gain
         FROM held WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT twice * {url_filter.STEP / 2} FROM gain WHERE gain IS NOT NULL
                         ORDER BY round(gain, 9) DESC, abs(twice), place LIMIT 1), 0) AS least_)
SELECT page_id, host, path, rule,
       CASE WHEN said IS NOT NULL THEN said WHEN coalesce(score, 0) >= (SELECT least_ FROM cut) THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN said IS NULL THEN round(coalesce(score, 0), 5) END AS score
FROM rows_ LEFT JOIN score USING (text)
"""


OP12 = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
                  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
u AS (SELECT doc_id, text, list_transform(parts[1:len(parts) - 1], lambda x: x || chr(10))
             || CASE WHEN parts[len(parts)] = '' THEN [] ELSE [parts[len(parts)]] END AS units,
             list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(code, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, text, units, len(units) AS n, h[1] % (len(units) + 1) AS x, h[2] % (len(units) + 1) AS y,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                  WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(x, y)], '') AS a,
             array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
             array_to_string(units[greatest(x, y) + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(a || m || z) AS restored_sha256
FROM p
"""

TWINS = {"op3_url_filter": _url_sql(), "op4_quality_rules": OP4, "op5_chat_format": OP5, "op10_decontaminate": OP10,
         "op12_exact_dedup": OP12, "op13_fill_in_middle": OP13}
