"""The same queries as SQL for DuckDB, written on their own: joins without pruning, lists and windows.

``ROUNDED((x), n)`` stands for a rounding by the double's exact value, and is written out at the end.
"""

from __future__ import annotations

from .cases import CASES

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '[0-9]+', ' 0 ', 'g')), ' '), lambda x: x <> '')"
_GRAMS = "list_distinct(list_transform(CASE WHEN length({0}) >= 3 THEN range(1, length({0}) - 1) ELSE [] END, lambda i: substr({0}, i, 3)))"


_HEADED = r"""CASE WHEN doc_id % 3 = 0 THEN '## head' || chr(10) || ' ## inner' || chr(10) ELSE '' END || text || CASE WHEN doc_id % 10 = 0 THEN chr(10) || '"name": "x"' ELSE '' END"""


def _lines(split: str, keep: str, ends: str = r"\r\n|[\n\r]", of: str = _HEADED) -> str:
    return f"""
WITH a AS (SELECT doc_id, string_split_regex({of}, '{ends}') AS parts FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS number FROM a),
c AS (SELECT doc_id, raw, number, {_STRIP.format('raw')} AS text FROM b),
d AS (SELECT doc_id, number, text, row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1 AS line FROM c WHERE text <> '' AND {keep})
SELECT {split} FROM d"""


#: Sentences with their words and trigrams: ``pages`` and ``poems`` of the queries.
_SENTENCES = f"""
sp AS (SELECT doc_id AS page, list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
sl AS (SELECT page, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line FROM sp),
sw AS (SELECT *, {_WORDS.format('text')} AS words FROM sl),
q0 AS (SELECT *, {_GRAMS.format("array_to_string(words, '_')")} AS grams FROM sw),
q AS (SELECT * FROM q0 WHERE len(grams) > 0),
rp AS (SELECT item_id AS poem_id, list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM benchmark WHERE text IS NOT NULL),
rl AS (SELECT poem_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS verse FROM rp),
rw AS (SELECT *, {_WORDS.format('text')} AS words FROM rl),
r0 AS (SELECT *, {_GRAMS.format("array_to_string(words, '_')")} AS grams FROM rw),
r AS (SELECT * FROM r0 WHERE len(grams) > 0)"""
#: Every third line of a page with every third letter of its words gone.
_READ = "sl AS (SELECT page, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line FROM sp)"
_FADED = r"sf AS (SELECT page, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line FROM sp), sl AS (SELECT page, CASE WHEN line % 3 = 1 THEN regexp_replace(text, '([a-z]{2})[a-z]', '\1', 'g') ELSE text END AS text, line FROM sf)"
assert _READ in _SENTENCES
_HOT = """
df AS (SELECT gram, count(*) AS df FROM post GROUP BY gram),
hot AS (SELECT gram FROM df WHERE df > 3000),"""
_COLD = " WHERE gram NOT IN (SELECT gram FROM hot)"
_CAPPED_MATCH = f"""{_SENTENCES},
post AS (SELECT poem_id, verse, len(grams) AS n_r, unnest(grams) AS gram FROM r),{_HOT}
qg AS (SELECT page, line, unnest(grams) AS gram FROM q),
qc AS (SELECT * FROM qg{_COLD}),
qn AS (SELECT page, line, count(*) AS n_q FROM qc GROUP BY ALL),
ov AS (SELECT page, line, poem_id, verse, n_r, count(*) AS o FROM qc JOIN post USING (gram) GROUP BY ALL),
sc AS (SELECT page, line, poem_id, verse, o / (n_q + n_r - o) AS score FROM ov JOIN qn USING (page, line))"""
_CAPPED_BEST = f"""{_CAPPED_MATCH},
best AS (SELECT * FROM sc WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY score DESC, poem_id, verse) = 1)"""
#: The same where every trigram counts.
_MATCH, _BEST = (x.replace(_HOT, "").replace(_COLD, "") for x in (_CAPPED_MATCH, _CAPPED_BEST))
assert "hot" not in _MATCH.removeprefix(_SENTENCES)
_LIS = "len(list_reduce({0}, lambda t, x: list_concat(list_filter(t, lambda y: y < x), [x], t[len(list_filter(t, lambda y: y < x)) + 2:]), []::BIGINT[]))"


#: DuckDB's levenshtein goes by bytes, so each character of the two becomes one byte (up to 95 different ones).
_BYTES = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr((31 + list_position(list_distinct(string_split(h || f, '')), c))::INT)), '')"


def _records(best: str = "best", name: str = "rec") -> str:
    return f"""
{name}_p AS (SELECT page, poem_id, line, verse, ROUNDED((score), 4) AS jaccard FROM {best} WHERE ROUNDED((score), 4) >= 0.55),
{name}_t AS (SELECT p.*, array_to_string(q.words, ' ') AS h, array_to_string(r.words, ' ') AS f FROM {name}_p p JOIN q USING (page, line) JOIN r USING (poem_id, verse)),
{name}_g AS (SELECT page, poem_id, list(verse ORDER BY line, verse)::BIGINT[] AS vs, count(*) AS matched_lines, count(DISTINCT verse) AS distinct_verses, sum(jaccard) AS sj,
  max(line) - min(line) + 1 AS hs, max(verse) - min(verse) + 1 AS rs, string_agg(h, ' ' ORDER BY line, verse) AS h, string_agg(f, ' ' ORDER BY line, verse) AS f FROM {name}_t GROUP BY page, poem_id),
{name}_l AS (SELECT *, {_LIS.format('vs')} AS lis FROM {name}_g),
{name} AS (SELECT *, CASE WHEN distinct_verses >= 4 AND lis / matched_lines >= 0.8 THEN 'gold' ELSE 'review' END AS tier FROM {name}_l WHERE distinct_verses >= 2)"""


_PR = "lis / hs", "lis / rs"
_DAMAGED = r"regexp_replace(text, '([a-z]{5})[a-z]', '\1', 'g')"
#: Lines with a word, numbered anew; ``bad`` are the words of the damaged text. Damage only deletes letters from words, so the distance of joined
#: texts is the difference of their lengths, whatever DuckDB's own (byte-wise) levenshtein would say.
_NUMBERED = f"""
sp AS (SELECT doc_id AS page, list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
sl AS (SELECT page, unnest(p) AS text, generate_subscripts(p, 1) AS number FROM sp),
en AS (SELECT *, {_WORDS.format('text')} AS words, {_WORDS.format(_DAMAGED)} AS bad, {_DAMAGED} AS bad_text FROM sl),
l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY number) - 1 AS line FROM en WHERE len(words) > 0)"""
_CODED = "array_to_string(list_transform({0}, lambda w: chr((32 + list_position(list_distinct(list_concat(words, bad)), w))::INT)), '')"
_RHYMES = f"""
sp AS (SELECT doc_id AS gid, list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
sl AS (SELECT gid, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line FROM sp),
st AS (SELECT gid, line, CASE WHEN line % 2 = 1 THEN text || ' of ' || CASE WHEN gid % 5 = 0 THEN 'the ' ELSE '' END || (gid % 7) ELSE text END AS text FROM sl),
wl AS (SELECT gid, line, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM st),
odd AS (SELECT gid, count(*) AS n, count(DISTINCT w[-1]) AS d1, count(DISTINCT w[-2:]) AS d2, count(DISTINCT w[-3:]) AS d3, min(len(w)) AS least, any_value(w) AS w FROM wl WHERE line % 2 = 1 AND len(w) > 0 GROUP BY gid),
rad AS (SELECT gid, CASE WHEN n < 2 THEN [] WHEN d3 = 1 AND least >= 3 THEN w[-3:] WHEN d2 = 1 AND least >= 2 THEN w[-2:] WHEN d1 = 1 THEN w[-1:] ELSE [] END AS radif FROM odd),
allp AS (SELECT DISTINCT gid, gid % 11 AS poet FROM wl),
poem AS (SELECT gid, poet, coalesce(radif, []) AS radif FROM allp LEFT JOIN rad USING (gid))"""
_VISIBLE = r"""replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'),
  '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', chr(10), 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
_HTML = f"""v AS (SELECT page_id, list_filter(list_transform(string_split({_VISIBLE}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM pages)"""
_PATHS = r"""paths AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda x: regexp_replace(regexp_replace(x, '[?#].*$', ''), '^https?://[^/]*', ''))) AS link FROM pages),
links AS (SELECT DISTINCT page_id, link FROM paths WHERE regexp_matches(link, '^/[A-Za-z]+$'))"""
_LISTED = "listed AS (SELECT doc_id % 6 AS cat_id, doc_id AS id, lang FROM documents), files AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 4 THEN [' '] ELSE string_split(text, chr(10)) END AS verses FROM documents WHERE doc_id % 9 <> 2)"
_STATE = """st AS (SELECT 'p' || doc_id AS page, CASE doc_id % 10 WHEN 0 THEN CASE WHEN text = '' THEN 'failed' ELSE 'complete' END WHEN 1 THEN CASE WHEN trim(text) = 'other' THEN 'complete' ELSE 'edited' END
  WHEN 2 THEN 'unrecorded' WHEN 3 THEN 'partial' WHEN 4 THEN 'failed' WHEN 6 THEN 'corrupt' WHEN 7 THEN 'corrupt' ELSE 'pending' END AS state FROM documents)"""

ORACLE_SQL = {
    "scan_verse": _lines("doc_id, line, text", "NOT starts_with(text, '##')"),
    "scan_prose": _lines("doc_id, line, text", "NOT starts_with(raw, '##')"),
    "scan_pairs": _lines("doc_id, line, text", "true"),
    "page_images": "SELECT '/scans/p' || doc_id || '.txt' AS path, CASE doc_id % 4 WHEN 0 THEN '/scans/p' || doc_id || '.jpg' WHEN 1 THEN '/scans/p' || doc_id || '.jpeg' WHEN 2 THEN '/scans/p' || doc_id || '.png' END AS image FROM documents",
    "first_sources": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 2 = 0 THEN 'b' ELSE 'c' END AS source FROM documents",
    "held_out": f"""WITH {_CAPPED_BEST}, v AS (SELECT page, poem_id, round(sum(score), 6) AS votes FROM best GROUP BY ALL), truth AS (SELECT page, poem_id FROM v QUALIFY row_number() OVER (PARTITION BY page ORDER BY votes DESC, poem_id) = 1),
other AS (SELECT * FROM sc ANTI JOIN truth USING (page, poem_id) WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY score DESC, poem_id, verse) = 1), w AS (SELECT page, poem_id, round(sum(score), 6) AS votes FROM other GROUP BY ALL),
n AS (SELECT page, count(*) AS n FROM q GROUP BY page) SELECT page, round(coalesce((SELECT max(votes) FROM v WHERE v.page = n.page) / n, 0), 9) AS present, round(coalesce((SELECT max(votes) FROM w WHERE w.page = n.page) / n, 0), 9) AS absent FROM n""",
    "scan_dictionary": _lines("doc_id, line, number, text, doc_id % 10 = 0 AS corrupt", r"NOT regexp_matches(text, '^\s*\d+\s*$')", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"),
    "poem_files": f"WITH a AS (SELECT 'w' || doc_id || '-' || lang || '-poet-ghazals-' || (doc_id % 3) AS gid, lang || '-poet' AS poet, len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: {_STRIP.format('x')} <> '')) AS n_lines FROM documents) SELECT * FROM a WHERE n_lines >= 4",
    "file_status": f"WITH a AS (SELECT len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: {_STRIP.format('x')} <> '')) AS n FROM documents) SELECT count(*) FILTER (n >= 2) AS usable, count(*) FILTER (n < 2) AS bad FROM a",
    "normalised": f"WITH a AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) SELECT item_id, array_to_string(w, ' ') AS folded, array_to_string(w, '') AS spaceless, len({_GRAMS.format(chr(39).join(['array_to_string(w, ', '_', ')']))}) AS n_grams FROM a",
    "line_lengths": _lines("doc_id, line, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(1, length(text)) AS share, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 4 AND length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(1, length(text)) >= 0.5 AND length(text) <= 200 AS is_verse, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 8 AND length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(1, length(text)) >= 0.45 AS is_prose", "NOT starts_with(text, '##')", of="text"),
    "word_frequencies": f"WITH {_SENTENCES}, w AS (SELECT DISTINCT poem_id, unnest(words) AS token FROM r) SELECT token, count(*) AS df FROM w GROUP BY token",
    "gram_frequencies": f"WITH {_SENTENCES}, g AS (SELECT unnest(grams) AS gram FROM r) SELECT gram, count(*) AS df, count(*) > 60 AS is_hot FROM g GROUP BY gram",
    "match_lines": f"WITH {_BEST} SELECT page, line, poem_id, verse, score FROM best",
    "align": f"""WITH {_BEST}, {_records()}
SELECT page, poem_id, tier, matched_lines, distinct_verses, ROUNDED((lis / matched_lines), 3) AS monotone_ratio, ROUNDED((sj / matched_lines), 4) AS mean_jaccard,
  ROUNDED((levenshtein({_BYTES.format('h')}, {_BYTES.format('f')}) / greatest(length(h), length(f))), 4) AS cer_matched_span, lis AS aligned_lines, hs AS hypothesis_span_lines, ROUNDED((lis / hs), 4) AS hypothesis_span_precision,
  rs AS reference_span_lines, ROUNDED((lis / rs), 4) AS reference_span_recall, ROUNDED((2 * (lis / hs) * (lis / rs) / (lis / hs + lis / rs)), 4) AS span_f1 FROM rec""",
    "align_totals": f"""WITH {_BEST}, {_records()}, s AS (SELECT coalesce(sum(matched_lines), 0) AS matched_lines, coalesce(sum(lis), 0) AS aligned_lines, coalesce(sum(hs), 0) AS hypothesis_span_lines, coalesce(sum(rs), 0) AS reference_span_lines FROM rec WHERE tier = 'gold'),
t AS (SELECT *, aligned_lines / greatest(1, hypothesis_span_lines) AS p, aligned_lines / greatest(1, reference_span_lines) AS r FROM s)
SELECT matched_lines, aligned_lines, hypothesis_span_lines, reference_span_lines, ROUNDED((p), 4) AS hypothesis_span_precision, ROUNDED((r), 4) AS reference_span_recall, ROUNDED((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 4) AS span_f1 FROM t""",
    "align_quantiles": f"WITH {_BEST}, {_records()}, v AS (SELECT coalesce(list_sort(list(ROUNDED((sj / matched_lines), 4))), []) AS v FROM rec WHERE tier = 'gold') SELECT len(v) AS n, v[len(v) // 4 + 1] AS q25, v[len(v) // 2 + 1] AS q50, v[3 * len(v) // 4 + 1] AS q75 FROM v",
    "align_pages": f"""WITH {_BEST}, {_records()} SELECT page, count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'review') AS review, sum(matched_lines) AS matched_lines, sum(lis) FILTER (tier = 'gold') AS aligned_lines,
ROUNDED((sum(lis) FILTER (tier = 'gold') / greatest(1, sum(hs) FILTER (tier = 'gold'))), 4) AS hypothesis_span_precision, ROUNDED((sum(lis) FILTER (tier = 'gold') / greatest(1, sum(rs) FILTER (tier = 'gold'))), 4) AS reference_span_recall FROM rec GROUP BY page""",
    "negative_control": f"""WITH {_BEST}, {_records()}, truth AS (SELECT DISTINCT page, poem_id FROM rec WHERE tier = 'gold'),
held AS (SELECT sc.* FROM sc ANTI JOIN truth USING (page, poem_id) WHERE page IN (SELECT page FROM truth) AND score >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY score DESC, poem_id, verse) = 1), {_records('held', 'neg')}
SELECT (SELECT count(DISTINCT page) FROM truth) AS pages, count(DISTINCT page) AS false_pages, count(*) AS false_records, coalesce(sum(matched_lines), 0) AS false_lines FROM neg WHERE tier = 'gold'""",
    "discover_gaps": f"""WITH {_BEST.replace(_READ, _FADED)}, {_records()}, anchors AS (SELECT page, poem_id, line, verse, lead(line) OVER w AS line2, lead(verse) OVER w AS verse2 FROM rec_p JOIN (SELECT page, poem_id FROM rec WHERE tier = 'gold') USING (page, poem_id) WINDOW w AS (PARTITION BY page, poem_id ORDER BY line)),
gap AS (SELECT page, poem_id, unnest(range(line + 1, line2)) AS line, verse - line AS shift FROM anchors WHERE line2 - line > 1 AND line2 - line = verse2 - verse), cand AS (SELECT page, poem_id, line, line + shift AS verse FROM gap),
asked AS MATERIALIZED (SELECT DISTINCT page, line FROM cand), ag AS MATERIALIZED (SELECT page, line, gram FROM qc JOIN asked USING (page, line)), an AS (SELECT page, line, count(*) AS n_q FROM ag GROUP BY ALL),
ao AS (SELECT page, line, poem_id, verse, n_r, count(*) AS o FROM ag JOIN post USING (gram) GROUP BY ALL), asc_ AS MATERIALIZED (SELECT page, line, poem_id, verse, o / (n_q + n_r - o) AS score FROM ao JOIN an USING (page, line)),
top AS (SELECT * FROM asc_ QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY score DESC, poem_id, verse) = 1), got AS (SELECT c.*, coalesce(s.score, 0) AS score, t.poem_id AS tp, t.verse AS tv FROM cand c LEFT JOIN asc_ s USING (page, line, poem_id, verse) LEFT JOIN top t USING (page, line))
SELECT page, poem_id, line, verse, ROUNDED((score), 4) AS jaccard, coalesce(tp = poem_id AND tv = verse, false) AS is_global_top, CASE WHEN score < 0.3 THEN 'below_discovery_floor' WHEN score < 0.55 THEN 'below_acceptance_threshold' ELSE 'not_excluded' END AS exclusion FROM got""",
    "line_votes": f"WITH {_BEST}, v AS (SELECT page, poem_id, sum(score) AS votes FROM best GROUP BY ALL) SELECT page, poem_id, round(votes, 6) AS votes, row_number() OVER (PARTITION BY page ORDER BY votes DESC, poem_id) AS rank FROM v QUALIFY rank <= 5",
    "restricted_votes": f"WITH {_MATCH}, w AS (SELECT DISTINCT poem_id, unnest(words) AS token FROM r), d AS (SELECT token, count(*) AS df FROM w GROUP BY token), k AS (SELECT DISTINCT page, unnest(words) AS token FROM q), allowed AS (SELECT DISTINCT page, poem_id FROM k JOIN w USING (token) JOIN d USING (token) WHERE df <= 25 AND length(token) >= 3), b AS (SELECT sc.* FROM sc SEMI JOIN allowed USING (page, poem_id) WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY score DESC, poem_id, verse) = 1) SELECT page, poem_id, round(sum(score), 6) AS votes FROM b GROUP BY ALL",
    "rare_words": f"WITH {_SENTENCES}, w AS (SELECT DISTINCT poem_id, unnest(words) AS token FROM r), d AS (SELECT token, count(*) AS df FROM w GROUP BY token), k AS (SELECT DISTINCT page, unnest(words) AS token FROM q), s AS (SELECT page, poem_id, count(*) AS shared FROM k JOIN w USING (token) JOIN d USING (token) WHERE df <= 25 AND length(token) >= 3 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY page ORDER BY shared DESC, poem_id) AS rank FROM s QUALIFY rank <= 5",
    "idf_overlap": f"WITH {_SENTENCES}, w AS (SELECT DISTINCT poem_id, unnest(words) AS token FROM r), d AS (SELECT token, count(*) AS df FROM w GROUP BY token), k AS (SELECT DISTINCT page, unnest(words) AS token FROM q) SELECT page, poem_id, round(sum(ln((SELECT count(DISTINCT poem_id) FROM r) / df)), 6) AS weight FROM k JOIN w USING (token) JOIN d USING (token) WHERE df <= 25 AND length(token) >= 3 GROUP BY ALL",
    "pair_rates": f"""WITH {_NUMBERED}, x AS (SELECT *, len(words) AS n, len(list_filter(range(1, len(words) + 1), lambda i: words[i] <> bad[i])) AS upper_d, len(words) - len(list_filter(list_distinct(words), lambda w: list_contains(bad, w))) AS other FROM l),
m AS (SELECT *, (SELECT coalesce(sum(least(c, coalesce(d, 0))), 0) FROM (SELECT w, count(*) AS c FROM unnest(words) AS t(w) GROUP BY w) LEFT JOIN (SELECT v, count(*) AS d FROM unnest(bad) AS t(v) GROUP BY v) ON w = v) AS common FROM x),
y AS (SELECT *, CASE WHEN n - common = upper_d THEN upper_d WHEN len(list_distinct(list_concat(words, bad))) <= 95 THEN levenshtein({_CODED.format('words')}, {_CODED.format('bad')}) END AS d FROM m),
g AS (SELECT page, count(*) AS lines, count(*) FILTER (words = bad) AS exact_lines, sum(d) AS word_edits, count(*) FILTER (d IS NULL) AS open, sum(len(bad)) AS ref_words, sum(length(array_to_string(words, ''))) AS a, sum(length(array_to_string(bad, ''))) AS b FROM y GROUP BY page)
SELECT page, lines, exact_lines, CASE WHEN open = 0 THEN word_edits END AS word_edits, ref_words, round(CASE WHEN open = 0 THEN word_edits END / greatest(1, ref_words), 9) AS wer, round((a - b) / greatest(a, b), 9) AS spaceless_cer FROM g""",
    "prose_rates": f"""WITH {_NUMBERED}, g AS (SELECT page, count(*) AS n, sum(len(words)) AS ht, sum(len(bad)) AS rt, sum(length(array_to_string(words, ''))) AS a, sum(length(array_to_string(bad, ''))) AS b, sum(length(text) - length(bad_text)) AS strict FROM l GROUP BY page)
SELECT page, n AS hyp_lines, n AS ref_lines, ht AS hyp_tokens, rt AS ref_tokens, a - b AS folded_character_distance, round((a - b) / greatest(1, b), 9) AS folded_character_error_rate, strict AS strict_character_distance FROM g""",
    "compare_sources": f"""WITH {_NUMBERED}, a AS (SELECT page, sum(length(array_to_string(words, ' '))) + count(*) - 1 AS t, sum(length(array_to_string(bad, ' '))) + count(*) - 1 AS u FROM l GROUP BY page),
c AS (SELECT (t - u) / greatest(t, u) AS cer FROM a) SELECT count(*) AS n, count(*) FILTER (cer = 0) AS identical, list_sort(list(cer))[count(*) // 2 + 1] AS median_cer, max(cer) AS max_cer, 0 AS line_mismatches FROM c""",
    "best_offset": f"""WITH {_NUMBERED}, h AS (SELECT page, line, array_to_string(words, ' ') AS h FROM l), r AS (SELECT page, line - 2 AS i, array_to_string(bad, ' ') AS f FROM l WHERE line >= 2), o AS (SELECT unnest(range(3)) AS "offset"),
c AS (SELECT r.page, "offset", h, f FROM r CROSS JOIN o JOIN h ON h.page = r.page AND h.line = r.i + "offset"), m AS (SELECT page, "offset", avg(CASE WHEN "offset" = 2 THEN length(h) - length(f) WHEN regexp_matches(h || f, '^[ -~]*$') THEN levenshtein(h, f) ELSE levenshtein({_BYTES.format('h')}, {_BYTES.format('f')}) END / greatest(length(h), length(f))) AS mean_cer FROM c GROUP BY ALL)
SELECT page, "offset", round(mean_cer, 9) AS mean_cer FROM m QUALIFY row_number() OVER (PARTITION BY page ORDER BY mean_cer, "offset") = 1""",
    "refrains": f"WITH {_RHYMES} SELECT gid, array_to_string(radif, ' ') AS radif FROM poem",
    "refrain_families": f"WITH {_RHYMES} SELECT array_to_string(radif, ' ') AS radif, count(*) AS members, count(DISTINCT poet) AS poets FROM poem WHERE len(radif) > 0 GROUP BY ALL",
    "family_sizes": f"WITH {_RHYMES}, f AS (SELECT radif, count(*) AS size FROM poem WHERE len(radif) > 0 GROUP BY radif) SELECT size, count(*) AS families FROM f GROUP BY size",
    "refrain_share": f"WITH {_RHYMES}, s AS (SELECT list_sort(list(len(radif) / len(w))) AS v FROM wl JOIN poem USING (gid) WHERE line % 2 = 1 AND len(radif) > 0 AND len(w) > len(radif)) SELECT len(v) AS n, v[len(v) // 2 + 1] AS median, v[floor(0.9 * len(v))::BIGINT + 1] AS p90 FROM s",
    "trial_pool": f"WITH {_RHYMES}, n AS (SELECT gid, count(*) AS n FROM wl GROUP BY gid), f AS (SELECT radif FROM poem WHERE len(radif) > 0 GROUP BY radif HAVING count(*) >= 2) SELECT gid FROM poem JOIN n USING (gid) WHERE n >= 8 AND radif IN (SELECT radif FROM f)",
    "threshold_sweep": """WITH s AS (SELECT round(-(length(regexp_replace(text, '[^#*$%&|<>!]', '', 'g')) / greatest(1, length(text))), 3) + 0.0 AS score, quality = 1 AS present FROM documents JOIN labels USING (doc_id)),
n AS (SELECT count(*) FILTER (present) AS n_p, count(*) FILTER (NOT present) AS n_a, list_sort(list(score) FILTER (present)) AS p, list_sort(list(score) FILTER (NOT present)) AS a FROM s),
c AS (SELECT DISTINCT score AS cut FROM s), k AS (SELECT cut, count(*) FILTER (present AND score >= cut) AS tp, count(*) FILTER (NOT present AND score >= cut) AS fp FROM c, s GROUP BY cut),
b AS (SELECT cut, (tp + n_a - fp) / (n_p + n_a) AS acc, tp / n_p AS recall, fp / n_a AS fpr FROM k, n ORDER BY acc DESC, cut LIMIT 1)
SELECT b.*, p[len(p) // 20 + 1] AS present_p05, p[len(p) // 2 + 1] AS present_med, a[len(a) // 2 + 1] AS absent_med, a[-1] AS absent_max, len(list_filter(a, lambda x: x >= p[len(p) // 20 + 1])) / len(a) AS absent_above_present_p05 FROM b, n""",
    "rising_steps": "WITH a AS (SELECT source AS book, doc_id AS page_no, CASE WHEN doc_id % 4 <> 1 THEN n_chars % 97 END AS number FROM documents), b AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY book ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a) SELECT book, page_no, number, CASE WHEN prev IS NULL OR number IS NULL THEN NULL WHEN number > prev THEN 'rising' ELSE 'falling' END AS step FROM b",
    "retrieval_report": f"""WITH {_CAPPED_BEST}, v AS (SELECT page, poem_id, round(sum(score), 6) AS votes FROM best GROUP BY ALL), t AS (SELECT page, min(poem_id) AS true_id FROM v GROUP BY page), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY votes DESC, poem_id) AS rank FROM v JOIN t USING (page)),
p AS (SELECT page, any_value(true_id) AS true_id, min(rank) FILTER (poem_id = true_id) AS rank, max(votes) FILTER (poem_id = true_id) AS own, arg_min(poem_id, rank) FILTER (poem_id <> true_id) AS decoy, arg_min(votes, rank) FILTER (poem_id <> true_id) AS other FROM k GROUP BY page),
m AS (SELECT list_sort(list((own - other) / own) FILTER (own > 0 AND other IS NOT NULL)) AS v FROM p)
SELECT count(*) AS trials, count(*) FILTER (rank = 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (own > 0 AND decoy IS NOT NULL) AS decided, (SELECT round(v[len(v) // 2 + 1], 6) FROM m) AS margin_median, count(*) FILTER (own > 0 AND true_id % 3 = decoy % 3) AS decoys_with_refrain FROM p""",
    "increasing_runs": f"WITH a AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x))::BIGINT[] AS v FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_LIS.format('v')} AS longest, len(v) AS n FROM a",
    "split_counts": "WITH a AS (SELECT ('0x' || substr(sha256('42:page-' || doc_id), 1, 8))::BIGINT / 4294967295.0 AS b FROM documents) SELECT CASE WHEN b < 0.1 THEN 'test' WHEN b < 0.2 THEN 'validation' ELSE 'train' END AS split, count(*) AS pages FROM a GROUP BY ALL",
    "build_manifest": "SELECT 'My-book-book_' || doc_id AS id, 'book_' || doc_id AS page, 'book_' || doc_id || '.jpg' AS image, 'book_' || doc_id || '.txt' AS text, sha256(source) AS image_sha256, sha256(text) AS text_sha256, 'candidate' AS status, 'verse' AS mode FROM documents WHERE text <> ''",
    "hash_mismatches": "SELECT doc_id FROM documents WHERE text IS NULL OR doc_id % 10 = 0",
    "page_alignment": "SELECT doc_id || '.txt' AS text_name, coalesce(quality::VARCHAR, 'whole book') AS alignment FROM documents LEFT JOIN labels USING (doc_id)",
    "page_states": f"WITH {_STATE} SELECT * FROM st",
    "state_counts": f"WITH {_STATE}, e AS (SELECT unnest(['complete', 'edited', 'unrecorded', 'partial', 'failed', 'corrupt', 'pending']) AS state) SELECT e.state, count(st.state) AS pages FROM e LEFT JOIN st USING (state) GROUP BY ALL",
    "last_attempts": "SELECT conv_id AS page, max(turn) AS last_id, max(turn) FILTER (turn % 5 <> 4 AND role = 'assistant' AND trim(coalesce(text, '')) <> '') AS published_id FROM conversations GROUP BY conv_id",
    "html_lines": f"WITH {_HTML} SELECT page_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line FROM v",
    "kept_html_lines": f"""WITH {_HTML}, l AS (SELECT page_id, unnest(p) AS text, generate_subscripts(p, 1) AS n FROM v), f AS (SELECT page_id, text, min(n) AS n FROM l GROUP BY ALL)
SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS line FROM f WHERE length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 6 AND length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) >= 0.5 AND length(text) <= 200 AND text NOT LIKE '%|%'""",
    "page_links": f"WITH {_PATHS} SELECT page_id, link FROM links",
    "links_to_fetch": f"WITH {_PATHS} SELECT DISTINCT link FROM links WHERE length(link) % 2 = 1",
    "url_parts": r"SELECT page_id, string_split(rtrim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), '/')[-1] AS slug, regexp_extract(url, '([^/]*)$', 1) AS base_name, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages",
    "reference_problems": f"WITH {_LISTED} SELECT cat_id, id, CASE WHEN verses IS NULL THEN 'missing' ELSE 'empty' END AS problem FROM listed LEFT JOIN files USING (id) WHERE verses IS NULL OR len(list_filter(verses, lambda x: {_STRIP.format('x')} <> '')) = 0",
    "cache_totals": f"WITH {_LISTED} SELECT lang AS poet, cat_id, count(*) AS listed, count(verses) AS files, coalesce(sum(len(verses)), 0) AS verses, count(*) FILTER (verses IS NULL) AS missing FROM listed LEFT JOIN files USING (id) GROUP BY ROLLUP (lang, cat_id)",
    "reference_verses": f"WITH {_LISTED} SELECT id AS poem_id, generate_subscripts(verses, 1) - 1 AS verse, length(unnest(verses)) AS n_chars FROM files",
    "persian_numbers": "SELECT * FROM (VALUES (1, 123), (2, 45), (3, NULL), (4, NULL)) AS t(id, number)",
    "reading_noise": f"WITH a AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) SELECT item_id, len(w) AS before, len(list_filter(range(len(w)), lambda i: ('0x' || substr(md5('0:drop:' || item_id || ':' || i), 1, 8))::BIGINT / 4294967296.0 > 0.3)) AS after FROM a",
    "normalisation_cases": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {str(merge).lower()}, {'true' if latest else 'NULL'})" for k, (_, _, _, merge, latest) in enumerate(CASES)) + ") AS t(id, merged, early_enough)",
    "dictionary_books": """SELECT * FROM (VALUES ('a-017-001', 'آپ آرٹ', 'op art', 'آپٹک آرٹ', 'cross_reference', 'english_term', 1), ('a-017-002', 'آپٹک آرٹ', 'optic art', '', 'definition', 'english_term', 2), ('b-275-001', 'ترکیب', 'composition', '', 'definition', 'english_term', 1),
('b-275-002', 'ترکیب بند', '', '', 'definition', 'ordered_heuristic', 2), ('b-275-003', 'ترکیبی زبانیں', 'organic languages', '', 'definition', 'english_term', 3), ('c-017-001', 'آزاد روپ', '', 'آزاد صرفیہ', 'cross_reference', 'direct_reference', 1)) AS t(id, headword, terms, targets, entry_type, rule, line)""",
    "dictionary_unresolved": "SELECT * FROM (VALUES ('c', 'no_boundary', 1), ('d', 'page_corruption', 0), ('d', 'no_boundary', 0)) AS t(book, rule, found_at)",
    "dictionary_recovery": "SELECT 'f-029-r001' AS id, 'اَبَتَث' AS headword, 'مفرد حروف کا مجموعہ۔' AS definition, 'ordered_recovery' AS rule, true AS needs_review",
    "dictionary_validation": """SELECT * FROM (VALUES (1, 'farhang-017-001', 'اول', NULL), (2, 'farhang-017-002', 'دوم', NULL), (3, 'farhang-018-001', 'سوم', NULL), (4, 'farhang-018-002', 'آتم کتھا', NULL), (5, 'farhang-018-003', 'چار', 'empty definition'), (6, 'farhang-019-001', 'پانچ', 'invalid pages'),
(7, 'farhang-017-003', ' ', 'invalid headword'), (8, 'farhang-017-004', 'چھ', 'invalid quality score')) AS t(sequence, id, headword, problem)""",
    "agreement_levels": "SELECT * FROM (VALUES ('كتاب', 'کتاب', 'encoding'), ('دیدۂ', 'دیدہ', 'orthographic'), ('دِل', 'دل', 'vocalisation'), ('در خور', 'درخور', 'segmentation'), ('گل', 'گل', 'identical'), ('گل', 'دل', NULL)) AS t(a, b, level)",
}


def _written_out(sql: str) -> str:
    """Each ROUNDED((x), n) as an expression: a tie at n places is one in which twice the scaled value is odd, and the product's error says to
    which side of it the value lies."""
    while (start := sql.rfind("ROUNDED((")) >= 0:  # the last one holds no other
        depth, end = 0, start + len("ROUNDED(")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        value, (places, rest) = sql[start + len("ROUNDED(") : end], sql[end + 2 :].split(")", 1)
        y = f"{2 * 10 ** int(places)}::DOUBLE"
        split = f"list_transform([{value}::DOUBLE], lambda v: {{'x': v, 't': v * {y}, 'h': v * 134217729::DOUBLE - (v * 134217729::DOUBLE - v)}})"
        off = f"list_transform({split}, lambda v: {{'x': v.x, 'w': floor(v.t + 0.5::DOUBLE), 'o': (v.t - floor(v.t + 0.5::DOUBLE)) + ((v.h * {y} - v.t) + (v.x - v.h) * {y})}})"
        tied = "CASE WHEN v.o > 0 THEN (v.w + 1) / 2 WHEN v.o < 0 THEN (v.w - 1) / 2 ELSE 2 * floor(v.w / 4 + 0.5::DOUBLE) END"
        scale = f"{10 ** int(places)}::DOUBLE"
        sql = f"{sql[:start]}list_transform({off}, lambda v: CASE WHEN v.w % 2 <> 0 AND abs(v.o) < 0.001 THEN {tied} ELSE floor(v.x * {scale} + 0.5::DOUBLE) END / {scale})[1]{rest}"
    return sql


ORACLE_SQL = {name: _written_out(sql) for name, sql in ORACLE_SQL.items()}
