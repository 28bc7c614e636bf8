"""Freely typed values mapped to a reference list, in SQL: a pigeonhole join.

Each entry of the list is written in the forms people type it in: whole, with its
last part first, with parts cut short or without vowels. What people put around a
value ("best ...", "...ish") is learned from the values themselves: a beginning or ending
that, taken off, leaves the labels of several entries. A form that may take k
errors is cut into k + 1 segments. Whatever is typed with at most k errors keeps
one segment whole, at a place moved by at most k, so typed values and forms meet
by equality on (length, k, segment, substring); built-in ``levenshtein`` verifies.
Values without a verified entry come out of an anti-join as entry -1.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.session import written

MOST_ERRORS = 3
#: An affix goes with at least so many entries, and with this share of them.
LEAST_ENTRIES, LEAST_SHARE = 3, 0.02


def _letters() -> tuple[str, str]:
    """Accented and wide letters and the plain lower-case letter each is based on, by rule:
    Latin, Greek and Cyrillic; letters of other scripts stand for themselves."""
    plain = {}
    for cp in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF10, 0xFF5B)):
        base = unicodedata.normalize("NFKD", chr(cp).lower())[:1]
        if base.isalnum() and base != chr(cp).lower():
            plain[chr(cp)] = base
    return "".join(plain), "".join(plain.values())


def _squash(column: str) -> str:
    before, after = _letters()
    return f"translate(regexp_replace(lower({column}), '\\\\pM', ''), '{before}', '{after}')"


_VOWELS = "concat(left({x}, 1), regexp_replace(substring({x}, 2), '[aeiou]', ''))"

PARTS_SQL = f"""
SELECT entry_id, kind,
       transform(filter(split({_squash("label")}, '\\\\s+'), x -> x <> ''), x -> regexp_replace(x, '[^\\\\p{{{{L}}}}\\\\p{{{{N}}}}]', '')) AS p
FROM {{entries}} WHERE label IS NOT NULL AND entry_id IS NOT NULL"""

SHORT_SQL = f"""
SELECT entry_id, kind, p, i, s FROM {{parts}}
LATERAL VIEW explode(sequence(0, size(p) - 1)) AS i
LATERAL VIEW explode(array_union(
    array({_VOWELS.format(x="p[i]")}),
    CASE WHEN size(p) > 1 THEN transform(array(3, 4, 5), n -> left(p[i], n)) ELSE array() END)) AS s
WHERE size(p) > 0"""

FORMS_SQL = f"""
SELECT entry_id, kind, form, length(form) AS len, min(rank) AS rank,
       CASE WHEN min(rank) < 2 THEN least({MOST_ERRORS}, (length(form) - 1) div 2)
            ELSE CASE WHEN length(form) >= 7 THEN 1 ELSE 0 END END AS k
FROM (SELECT entry_id, kind, 0 AS rank, array_join(p, '') AS form FROM {{parts}}
      UNION ALL SELECT entry_id, kind, 1, concat(element_at(p, -1), array_join(slice(p, 1, size(p) - 1), ''))
                FROM {{parts}} WHERE size(p) > 1
      UNION ALL SELECT entry_id, kind, 2, array_join(transform(p, (x, j) -> CASE WHEN j = i THEN s ELSE x END), '')
                FROM {{short}}
      UNION ALL SELECT entry_id, kind, 2, array_join(transform(p, x -> {_VOWELS.format(x="x")}), '') FROM {{parts}})
WHERE length(form) > CASE WHEN rank < 2 THEN 0 ELSE 2 END GROUP BY entry_id, kind, form"""

#: Positions count from 1; segment i of a form of length len.
SEGMENTS_SQL = """
SELECT f.*, i AS seg, (i * len) div (k + 1) + 1 AS at, ((i + 1) * len) div (k + 1) - (i * len) div (k + 1) AS size
FROM {forms} f LATERAL VIEW explode(sequence(0, k)) AS i"""

CLEAN_SQL = f"""
SELECT field, value, filter(split({_squash("value")}, '[^\\\\p{{{{L}}}}\\\\p{{{{N}}}}]+'), x -> x <> '') AS words,
       regexp_replace({_squash("value")}, '[^\\\\p{{{{L}}}}\\\\p{{{{N}}}}]', '') AS whole
FROM {{values}}"""

#: longest: the length of the longest form, the most that is tried as a label or an affix.
AFFIXES_SQL = f"""
SELECT side, affix FROM (
    SELECT side, CASE side WHEN 'before' THEN left(whole, length(whole) - n) ELSE substring(whole, n + 1) END AS affix,
           CASE side WHEN 'before' THEN right(whole, n) ELSE left(whole, n) END AS form
    FROM (SELECT DISTINCT whole FROM {{clean}} WHERE length(whole) BETWEEN 2 AND 2 * :longest)
    LATERAL VIEW explode(array('before', 'after')) AS side
    LATERAL VIEW explode(sequence(1, least(length(whole) - 1, :longest))) AS n
    WHERE length(whole) - n <= :longest) x
JOIN {{plain}} p ON x.form = p.form
GROUP BY side, affix
HAVING count(DISTINCT entry_id) >= greatest({LEAST_ENTRIES}, {LEAST_SHARE} * (SELECT count(DISTINCT entry_id) FROM {{plain}}))"""

BEHEADED_SQL = """
SELECT field, value, 0 AS cut, whole AS typed FROM {clean} WHERE whole <> ''
UNION ALL
SELECT field, value, 1 AS cut, substring(whole, n + 1) AS typed
FROM (SELECT field, value, whole, n, left(whole, n) AS affix FROM {clean}
      LATERAL VIEW explode(sequence(1, least(length(whole) - 1, :longest))) AS n WHERE length(whole) > 1) c
JOIN {affixes} a ON a.side = 'before' AND a.affix = c.affix"""

#: cut: how many affixes were taken off.
TYPED_SQL = """
SELECT field, value, cut, typed FROM {beheaded}
UNION ALL
SELECT field, value, cut + 1 AS cut, left(typed, length(typed) - n) AS typed
FROM (SELECT field, value, cut, typed, n, right(typed, n) AS affix FROM {beheaded}
      LATERAL VIEW explode(sequence(1, least(length(typed) - 1, :longest))) AS n WHERE length(typed) > 1) c
JOIN {affixes} a ON a.side = 'after' AND a.affix = c.affix"""

SPREAD_SQL = f"""
SELECT typed, length(typed) - d AS len, d FROM (SELECT DISTINCT typed FROM {{typed}})
LATERAL VIEW explode(sequence(-{MOST_ERRORS}, {MOST_ERRORS})) AS d"""

LAYOUT_SQL = "SELECT DISTINCT len, k, seg, at, size FROM {segments}"

#: d, the difference in length, and m, the move of a segment: the errors before the
#: segment make up m and those after it d - m, so |m| + |d - m| is at most k.
PIECES_SQL = """
SELECT typed, len, k, seg, substring(typed, at + m, size) AS piece
FROM (SELECT s.typed, s.len, s.d, l.k, l.seg, l.at, l.size FROM {spread} s JOIN {layout} l ON s.len = l.len
      WHERE abs(s.d) <= l.k)
LATERAL VIEW explode(sequence(-k, k)) AS m
WHERE abs(m) + abs(d - m) <= k AND at + m >= 1 AND at + m + size - 1 <= length(typed)"""

MATCH_SQL = """
SELECT typed, entry_id, kind, rank, d
FROM (SELECT *, levenshtein(typed, form, k) AS d FROM (
        SELECT DISTINCT p.typed, g.entry_id, g.kind, g.rank, g.form, g.k FROM {pieces} p JOIN {segments} g
        ON p.len = g.len AND p.k = g.k AND p.seg = g.seg AND p.piece = substring(g.form, g.at, g.size)))
WHERE d >= 0"""

KNOWN_SQL = f"""
SELECT DISTINCT w FROM {{entries}}
LATERAL VIEW explode(filter(split({_squash("label")}, '[^\\\\p{{{{L}}}}\\\\p{{{{N}}}}]+'), x -> x <> '')) AS w"""

#: Values with a word that is in no label.
ODD_SQL = """
SELECT DISTINCT field, value FROM (SELECT field, value, w FROM {clean} LATERAL VIEW explode(words) AS w) c
LEFT ANTI JOIN {known} k ON c.w = k.w"""

#: Words that are all in the list, put together as no entry is, name something else.
HITS_SQL = """
SELECT t.field, t.value, m.entry_id, struct(m.d, t.cut, m.rank) AS cost
FROM {typed} t JOIN {matches} m ON t.typed = m.typed LEFT JOIN {odd} o ON t.field = o.field AND t.value = o.value
WHERE (t.field = 'any' OR m.kind = t.field) AND (m.d = 0 OR o.value IS NOT NULL)"""

CHOICE_SQL = """
SELECT field, value, entries[0] AS entry_id
FROM (SELECT field, value, min_by(entries, cost) AS entries
      FROM (SELECT field, value, cost, collect_set(entry_id) AS entries FROM {hits} GROUP BY field, value, cost)
      GROUP BY field, value)
WHERE size(entries) = 1"""

ALL_SQL = """
SELECT field, value, entry_id FROM {chosen}
UNION ALL
SELECT v.field, v.value, -1 FROM {values} v LEFT ANTI JOIN {chosen} c ON v.field = c.field AND v.value = c.value"""


def map_values(values: DataFrame, entries: DataFrame, max_broadcast_segments: int = 200_000) -> DataFrame:
    """(field, value, entry_id) for distinct (field, value): the entry meant, or -1.

    ``field`` is ``any`` or the one ``kind`` of entries the value may mean; entries
    are (entry_id INT, kind, label). Letter case, accents, width, punctuation,
    spacing and the order of two parts make no difference, in any script, nor does one affix at
    either end that goes with several entries (see ``AFFIXES_SQL``); up to three
    errors are forgiven in long labels, none in labels of one or two letters. Fewer errors
    go before fewer affixes; of several entries equally near none is chosen. Null values
    are no values, empty ones and ones longer than any label are -1, entries with a null id
    or label are skipped, with an empty list every value is -1. The segments of the list are
    counted before they are broadcast; more of them are joined by shuffles.
    """
    spark = values.sparkSession
    entries = entries.select("entry_id", "kind", "label")
    values = values.select("field", "value").where("value is not null").distinct()
    parts = spark.sql(PARTS_SQL, entries=entries)
    forms = written(spark.sql(FORMS_SQL, parts=parts, short=spark.sql(SHORT_SQL, parts=parts)), "forms")
    segments = spark.sql(SEGMENTS_SQL, forms=forms)
    layout = spark.sql(LAYOUT_SQL, segments=segments)
    size = segments.agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest")).first()
    longest = {"longest": size.longest or 0}
    plain = forms.where("rank = 0").select("entry_id", "form")
    if size.n <= max_broadcast_segments:
        segments, layout, plain = segments.hint("broadcast"), layout.hint("broadcast"), plain.hint("broadcast")
    clean = written(spark.sql(CLEAN_SQL, values=values), "values")  # distinct values, read by several steps
    affixes = written(spark.sql(AFFIXES_SQL, longest, clean=clean, plain=plain), "affixes")
    beheaded = spark.sql(BEHEADED_SQL, longest, clean=clean, affixes=affixes)
    typed = written(spark.sql(TYPED_SQL, longest, beheaded=beheaded, affixes=affixes), "typed")
    pieces = spark.sql(PIECES_SQL, spread=spark.sql(SPREAD_SQL, typed=typed), layout=layout)
    matches = spark.sql(MATCH_SQL, pieces=pieces, segments=segments)
    odd = spark.sql(ODD_SQL, clean=clean, known=spark.sql(KNOWN_SQL, entries=entries))
    hits = spark.sql(HITS_SQL, typed=typed, matches=matches, odd=odd)
    chosen = spark.sql(CHOICE_SQL, hits=hits)
    return spark.sql(ALL_SQL, chosen=chosen, values=clean)


OCCURRENCES_SQL = """
SELECT 'raw_tags' AS field, 'any' AS allowed, row_id AS rec_id, pos, value
FROM {tracks} LATERAL VIEW posexplode(raw_tags) AS pos, value WHERE value IS NOT NULL
UNION ALL
SELECT 'mapped_mood', 'mood', result_id, 0, mapped_mood FROM {results} WHERE mapped_mood IS NOT NULL"""

UNLISTED_SQL = """
SELECT o.* FROM {occurrences} o LEFT ANTI JOIN {entries} e ON o.value = e.label"""

PLACED_SQL = """
SELECT o.field, o.rec_id, o.pos, m.entry_id
FROM {occurrences} o JOIN {mapped} m ON o.allowed = m.field AND o.value = m.value"""


def map_tags_and_moods(tracks: DataFrame, results: DataFrame, entries: DataFrame) -> DataFrame:
    """(field, rec_id, pos, entry_id) for every typed value that is not exactly a label.

    Null lists, elements and moods are no values; other columns are not read.
    """
    spark = tracks.sparkSession
    tracks, results = tracks.select("row_id", "raw_tags"), results.select("result_id", "mapped_mood")
    entries = entries.select("entry_id", "kind", "label")
    occurrences = spark.sql(OCCURRENCES_SQL, tracks=tracks, results=results)
    occurrences = spark.sql(UNLISTED_SQL, occurrences=occurrences, entries=entries)
    mapped = map_values(occurrences.selectExpr("allowed as field", "value"), entries)
    return spark.sql(PLACED_SQL, occurrences=occurrences, mapped=mapped)
