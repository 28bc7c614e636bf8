"""The same results in SQL for DuckDB, where SQL can say them."""

from __future__ import annotations

from cantera.llm import canon
from cantera.llm.lookalike import LOOKALIKES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(column: str) -> str:
    """Look-alike folding of the kinds of characters met in the tables."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c) for c in range(0x21, 0x7F))
    before = "".join(LOOKALIKES) + wide + "K"
    after = "".join(LOOKALIKES.values()) + narrow + "K"
    blanks = r"[\t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    hidden = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}]"
    x = f"regexp_replace(regexp_replace({column}, '{blanks}', ' ', 'g'), '{hidden}', '', 'g')"
    x = f"replace(replace(replace({x}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"trim(nfc_normalize(translate({x}, {_quoted(before)}, {_quoted(after)})), ' ')"


_LONG = """
    SELECT row_id, 'title' AS field, title AS value FROM track_items WHERE title IS NOT NULL
    UNION ALL SELECT row_id, 'artist', artist FROM track_items WHERE artist IS NOT NULL"""

_FORMS = f"""
    forms AS (SELECT field, value, {_form("value")} AS form, count(*) AS n_rows, min(row_id) AS first_row
              FROM long GROUP BY field, value)"""

_TAG = r"regexp_replace(lower(x), '[\s\p{Z}\p{P}\x{85}\x0B]+', '', 'g')"

_RUNS = f"""
    SELECT row_id, min(row_id) OVER w AS row_a, count(*) OVER w AS n_copies FROM (
        SELECT row_id, title, artist, album,
               list_sort(list_transform(raw_tags, lambda x: coalesce('=' || {_TAG}, '~'))) AS bag
        FROM track_items WHERE len(raw_tags) > 0)
    WINDOW w AS (PARTITION BY title, artist, album, bag)"""

_TERMS = """
    SELECT tag, sum(n)::BIGINT AS n_occurrences, count(*) AS n_records,
           CASE WHEN count(*) <= 2 THEN 'rare'
                WHEN count(*) * 25 > (SELECT count(*) FROM track_items) THEN 'common' ELSE 'useful' END AS verdict
    FROM (SELECT row_id, tag, count(*) AS n FROM (SELECT row_id, unnest(raw_tags) AS tag FROM track_items)
          WHERE tag IS NOT NULL GROUP BY row_id, tag) GROUP BY tag"""

_PAIRS = """
    WITH items AS (
        SELECT DISTINCT row_id, item FROM (
            SELECT row_id, 'tag:' || unnest(raw_tags) AS item FROM track_items
            UNION ALL SELECT row_id, 'mood:' || unnest(current_moods) FROM track_items) WHERE item IS NOT NULL),
    counts AS (SELECT item, count(*) AS n FROM items GROUP BY item),
    total AS (SELECT count(*) AS n_total FROM track_items),
    often AS (SELECT items.* FROM items JOIN counts USING (item), total WHERE n * 250 >= n_total),
    pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab
              FROM often a JOIN often b ON a.row_id = b.row_id AND a.item < b.item GROUP BY ALL),
    named AS (SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, n_total
              FROM pairs JOIN counts a ON a.item = item_a JOIN counts b ON b.item = item_b, total
              WHERE n_ab * 250 >= n_total AND n_ab * n_total >= 3 * a.n * b.n)"""

_MEASURES = """round(n_ab::DOUBLE * n_total / (n_a::DOUBLE * n_b), 6) AS lift,
           round(2.0 * (g(n_ab, n_a * n_b, n_total) + g(n_a - n_ab, n_a * (n_total - n_b), n_total)
                + g(n_b - n_ab, (n_total - n_a) * n_b, n_total)
                + g(n_total - n_a - n_b + n_ab, (n_total - n_a) * (n_total - n_b), n_total)), 4) AS llr"""

_WORDS = r"""
    SELECT {key} AS id, word, row_number() OVER (PARTITION BY {key} ORDER BY nr) AS place FROM (
        SELECT {key}, unnest(words) AS word, generate_subscripts(words, 1) AS nr FROM (
            SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+') AS words FROM {table}))"""

_LEAKS = f"""
    WITH dw AS ({_WORDS.format(key="doc_id", table="documents")}),
    iw AS ({_WORDS.format(key="item_id", table="eval_items")}),
    dg AS (SELECT id, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS gram,
                  count(*) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM dw),
    ig AS (SELECT id, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS gram,
                  count(*) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM iw)
    SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (gram) WHERE dg.n = 10 AND ig.n = 10"""

#: Words and what lies between them, in turn; a word goes with a hit, what lies between two words with both.
_CLEANED = r"""
    WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{Nd}]+') AS words, regexp_extract_all(text, '[^\p{L}\p{Nd}]+') AS gaps,
                        regexp_matches(text, '^[^\p{L}\p{Nd}]') AS late FROM documents),
    dw AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM cut),
    dg AS (SELECT doc_id, i, string_agg(lower(word), ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS gram,
                  count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM dw),
    iw AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
           FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{Nd}]+') AS words FROM eval_items)),
    ig AS (SELECT string_agg(lower(word), ' ') OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS gram,
                  count(*) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM iw),
    hits AS (SELECT doc_id, i FROM dg WHERE n = 10 AND gram IN (SELECT gram FROM ig WHERE n = 10)),
    hit AS (SELECT DISTINCT doc_id, i + unnest(range(10)) AS i FROM hits),
    pieces AS (SELECT doc_id, 2 * i AS place, word AS piece, hit.i IS NOT NULL AS gone FROM dw LEFT JOIN hit USING (doc_id, i)
               UNION ALL
               SELECT g.doc_id, 2 * g.i + 1, g.gap, a.i IS NOT NULL AND b.i IS NOT NULL
               FROM (SELECT doc_id, unnest(gaps) AS gap, generate_subscripts(gaps, 1) - late::INT AS i FROM cut) g
               LEFT JOIN hit a ON a.doc_id = g.doc_id AND a.i = g.i LEFT JOIN hit b ON b.doc_id = g.doc_id AND b.i = g.i + 1),
    kept AS (SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY place) FILTER (NOT gone), '') AS kept,
                    coalesce(sum(length(piece)) FILTER (gone), 0)::BIGINT AS n_removed FROM pieces GROUP BY doc_id)
    SELECT doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE kept END AS text, coalesce(n_removed, 0) AS n_removed
    FROM documents LEFT JOIN kept USING (doc_id)"""

#: The mix with characters for tokens: running sums of each source in its shuffled order, then of all uses by finish time.
_MIX = """
    WITH targets AS (SELECT lower(source) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM source_targets
                     WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0 GROUP BY lower(source)),
    docs AS (SELECT doc_id, lower(source) AS source, length(text) AS n FROM documents WHERE length(text) > 0 AND lower(source) IN (SELECT source FROM targets)),
    rates AS (SELECT *, round(target_share / (SELECT sum(target_share) FROM targets WHERE source IN (SELECT source FROM docs)), 12) AS mix_share
              FROM targets JOIN (SELECT source, sum(n)::BIGINT AS total, count(*) AS n_docs FROM docs GROUP BY source) USING (source)),
    budget AS (SELECT min(floor(max_repeats * total / mix_share + 1e-6))::BIGINT AS most FROM rates),
    placed AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 17, source, doc_id, n)), doc_id)::BIGINT AS upto FROM docs),
    uses AS (SELECT *, ((use - 1) * total + upto) / mix_share AS finish
             FROM (SELECT placed.*, total, mix_share, unnest(range(1, max_repeats + 1)) AS use FROM placed JOIN rates USING (source))),
    ordered AS (SELECT *, sum(n) OVER (ORDER BY finish, source, doc_id, use, n) AS upto_all FROM uses, budget WHERE finish <= most * (1 + 1e-9)),
    mixture AS (SELECT doc_id, source, use::INT AS use, n FROM ordered WHERE upto_all <= most)"""

_STRETCHES = """
    WITH starts AS (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS i FROM documents WHERE length(text) >= 240),
    stretches AS (SELECT doc_id, i - 1 AS start, md5(substr(text, i, 240)) AS stretch FROM starts),
    several AS (SELECT stretch FROM stretches GROUP BY stretch HAVING min(doc_id) <> max(doc_id)),
    shared AS (SELECT * FROM stretches JOIN several USING (stretch))"""

_SPANS = f"""{_STRETCHES},
    places AS (SELECT DISTINCT doc_id, start FROM shared),
    fresh AS (SELECT doc_id, start, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) > 240, true)::INT AS f
              FROM places),
    numbered AS (SELECT doc_id, start, sum(f) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM fresh),
    spans AS (SELECT doc_id, min(start) AS start, max(start) - min(start) + 240 AS n_chars FROM numbered GROUP BY doc_id, span)"""

def _squash(column: str) -> str:
    before, after = canon._letters()
    return f"translate(regexp_replace(lower({column}), '\\p{{M}}', '', 'g'), {_quoted(before)}, {_quoted(after)})"


def _voiceless(x: str) -> str:
    return f"(left({x}, 1) || regexp_replace(substr({x}, 2), '[aeiou]', '', 'g'))"


_P = "generate_subscripts(p, 1)"

#: Every typed value against every form of every entry, by edit distance alone.
_MAPPED = f"""
    WITH occurrences AS (
        SELECT 'raw_tags' AS field, 'any' AS allowed, row_id AS rec_id, (generate_subscripts(raw_tags, 1) - 1)::INT AS pos, unnest(raw_tags) AS value
        FROM track_items
        UNION ALL SELECT 'mapped_mood', 'mood', result_id, 0, mapped_mood FROM processed_tracks),
    open AS (SELECT * FROM occurrences WHERE value IS NOT NULL AND value NOT IN (SELECT label FROM canon_entries)),
    parts AS (SELECT entry_id, kind, list_transform(list_filter(string_split_regex({_squash("label")}, '\\s+'), lambda x: x <> ''),
                     lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS p FROM canon_entries),
    places AS (SELECT entry_id, kind, p, {_P} AS i, unnest(p) AS part FROM parts),
    short AS (SELECT entry_id, kind, p, i, {_voiceless("part")} AS s FROM places
              UNION ALL SELECT entry_id, kind, p, i, left(part, unnest([3, 4, 5])) FROM places WHERE len(p) > 1),
    every AS (SELECT entry_id, kind, 0 AS rank, array_to_string(p, '') AS form FROM parts
              UNION ALL SELECT entry_id, kind, 1, p[-1] || array_to_string(p[1:-2], '') FROM parts WHERE len(p) > 1
              UNION ALL SELECT entry_id, kind, 2, array_to_string(list_transform(p, lambda x, j: CASE WHEN j = i THEN s ELSE x END), '') FROM short
              UNION ALL SELECT entry_id, kind, 2, array_to_string(list_transform(p, lambda x: {_voiceless("x")}), '') FROM parts),
    forms AS (SELECT entry_id, kind, form, min(rank) AS rank,
                     CASE WHEN min(rank) < 2 THEN least({canon.MOST_ERRORS}, (length(form) - 1) // 2) WHEN length(form) >= 7 THEN 1 ELSE 0 END AS k
              FROM every WHERE length(form) > CASE WHEN rank < 2 THEN 0 ELSE 2 END GROUP BY entry_id, kind, form),
    known AS (SELECT list(DISTINCT w) AS words FROM (SELECT unnest(string_split_regex({_squash("label")}, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM canon_entries)),
    clean AS (SELECT DISTINCT allowed, value, list_filter(string_split_regex({_squash("value")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words,
                     regexp_replace({_squash("value")}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS whole FROM open),
    longest AS (SELECT max(length(form)) AS most FROM forms),
    around AS (SELECT 'before' AS side, left(whole, length(whole) - length(form)) AS affix, entry_id FROM (SELECT DISTINCT whole FROM clean), forms
               WHERE rank = 0 AND length(whole) > length(form) AND ends_with(whole, form)
               UNION ALL SELECT 'after', substr(whole, length(form) + 1), entry_id FROM (SELECT DISTINCT whole FROM clean), forms
               WHERE rank = 0 AND length(whole) > length(form) AND starts_with(whole, form)),
    affixes AS (SELECT side, affix FROM around, longest WHERE length(affix) <= most GROUP BY side, affix
                HAVING count(DISTINCT entry_id) >= greatest({canon.LEAST_ENTRIES}, {canon.LEAST_SHARE} * (SELECT count(*) FROM forms WHERE rank = 0))),
    beheaded AS (SELECT allowed, value, words, 0 AS cut, whole AS t FROM clean WHERE whole <> ''
                 UNION ALL SELECT allowed, value, words, 1, substr(whole, length(affix) + 1) FROM clean, affixes
                 WHERE side = 'before' AND starts_with(whole, affix) AND length(whole) > length(affix)),
    typed AS (SELECT * FROM beheaded
              UNION ALL SELECT allowed, value, words, cut + 1, left(t, length(t) - length(affix)) FROM beheaded, affixes
              WHERE side = 'after' AND ends_with(t, affix) AND length(t) > length(affix)),
    near AS (SELECT t, entry_id, kind, rank, levenshtein(t, form) AS d FROM (SELECT DISTINCT t FROM typed WHERE length(t) <= 200), forms
             WHERE abs(length(t) - length(form)) <= k AND levenshtein(t, form) <= k),
    hits AS (SELECT allowed, value, entry_id, (d, cut, rank) AS cost FROM typed JOIN near USING (t), known
             WHERE (allowed = 'any' OR kind = allowed) AND (d = 0 OR NOT list_has_all(known.words, typed.words))),
    best AS (SELECT allowed, value, min(cost) AS cost FROM hits GROUP BY allowed, value),
    chosen AS (SELECT allowed, value, min(entry_id) AS entry_id FROM hits JOIN best USING (allowed, value, cost)
               GROUP BY allowed, value HAVING count(DISTINCT entry_id) = 1)
    SELECT field, rec_id, pos, coalesce(entry_id, -1) AS entry_id FROM open LEFT JOIN chosen USING (allowed, value)"""

ORACLE: dict[str, str] = {
    "p1_found": _MAPPED,
    "p2_found": f"""
    WITH long AS ({_LONG}), {_FORMS},
    lead AS (SELECT field, form, min(first_row) AS row_a, arg_min(value, first_row) AS kept FROM forms GROUP BY field, form)
    SELECT field, row_a, row_id AS row_b FROM long JOIN forms USING (field, value) JOIN lead USING (field, form)
    WHERE value <> kept""",
    "p2_forms": f"WITH long AS ({_LONG}), {_FORMS} SELECT field, value, form, n_rows FROM forms",
    "p4_terms": f"SELECT tag, n_occurrences, n_records, verdict FROM ({_TERMS})",
    "p4_found": f"SELECT tag, verdict FROM ({_TERMS}) WHERE verdict <> 'useful'",
    "p5_found": f"SELECT row_a, row_id AS row_b FROM ({_RUNS}) WHERE row_a <> row_id",
    "p5_records": f"SELECT row_id, n_copies FROM ({_RUNS}) WHERE row_a = row_id",
    "p6_found": f"{_PAIRS} SELECT item_a, item_b FROM named",
    "p6_pairs": f"{_PAIRS} SELECT item_a, item_b, n_ab, n_a, n_b, n_total, {_MEASURES} FROM named",
    "p6_significant": f"""{_PAIRS.replace("n * 250", "n * 100").replace("n_ab * 250", "n_ab * 100").replace("3 * a.n", "a.n")}
    SELECT * FROM (SELECT item_a, item_b, n_ab, n_a, n_b, n_total, {_MEASURES} FROM named) WHERE llr >= 10.83""",
    "p7_found": _LEAKS,
    "p7_cleaned": _CLEANED,
    "p8_mix_by_length": f"{_MIX} SELECT doc_id, source, use, n AS n_chars FROM mixture",
    "p8_shares_by_length": f"""{_MIX},
    got AS (SELECT source, count(*) AS n_uses, sum(n)::BIGINT AS n_chars FROM mixture GROUP BY source)
    SELECT source, round(t.target_share, 9) AS target_share, round(coalesce(mix_share, 0.0), 9) AS mix_share, coalesce(n_docs, 0) AS n_docs,
           coalesce(n_uses, 0) AS n_uses, coalesce(n_chars, 0) AS n_chars,
           round(coalesce(n_chars / (SELECT sum(n_chars) FROM got), 0.0), 9) AS reached_share
    FROM targets t LEFT JOIN rates USING (source) LEFT JOIN got USING (source)""",
    "p9_found": f"""{_STRETCHES}
    SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM shared a JOIN shared b USING (stretch) WHERE a.doc_id < b.doc_id""",
    "p9_spans": f"{_SPANS} SELECT doc_id, start, n_chars FROM spans",
    "p9_parts": f"""{_SPANS},
    found AS (SELECT doc_id, count(*) AS n_spans, sum(n_chars) AS n_shared FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n_spans, 0) AS n_spans,
           coalesce(n_shared, 0)::BIGINT AS n_shared,
           CASE WHEN length(text) > 0 THEN round(coalesce(n_shared, 0)::DOUBLE / length(text), 6) ELSE 0.0 END AS share
    FROM documents LEFT JOIN found USING (doc_id)""",
}


def _inline(sql: str) -> str:
    """Writes out g(k, e, n) = k * ln(k * n / e), 0 at k = 0."""
    while (at := sql.find("g(n_")) >= 0:
        depth, commas, end = 0, [], at + 1
        for end in range(at + 1, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                commas.append(end)
            if depth == 0:
                break
        k, e, n = sql[at + 2 : commas[0]], sql[commas[0] + 1 : commas[1]], sql[commas[1] + 1 : end]
        cell = f"CASE WHEN ({k}) > 0 THEN ({k}) * ln(({k})::DOUBLE * {n} / ({e})::DOUBLE) ELSE 0.0 END"
        sql = sql[:at] + cell + sql[end + 1 :]
    return sql


ORACLE = {name: _inline(sql) for name, sql in ORACLE.items()}
