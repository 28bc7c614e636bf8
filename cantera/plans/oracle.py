"""The core queries in SQL for DuckDB, written as relations over rows of tags.

Where the engine works on a row's own array, this SQL explodes, joins and ranks, so the
two say the same thing in different ways.
"""

from __future__ import annotations

from cantera.operators.matcher import MOOD_TAGS, MOODS, PRIMARY, SUB, Vocabulary, target_rows
from cantera.operators.merge import FRAMES
from cantera.plans import library as lib
from cantera.plans import vocab as V
from cantera.plans.queries import EXCLUDING, PAYLOADS, RECORDINGS, TARGETS, TEMPI


def text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]::VARCHAR[]"


def norm(x: str) -> str:
    blank = r"[\s\p{Z}\x{85}\x0B\x1C-\x1F]+"
    return f"lower(regexp_replace({x}, '^{blank}|{blank}$', '', 'g'))"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(replace({x}, '-', ' '), '[\s\p{{Z}}]+'), lambda w: w <> '')"


def any_in(x: str, needles) -> str:
    return f"list_bool_or(list_transform({array(needles)}, lambda n: contains({x}, n)))"


def has(moods: str, values) -> str:
    return f"list_has_any(list_transform({moods}, lambda q: lower(q)), {array(values)})"


def without(moods: str, values) -> str:
    return f"list_filter({moods}, lambda q: NOT list_contains({array(values)}, lower(q)))"


def ordered_distinct(x: str, key: str = "v") -> str:
    """First of each value of a list, in order; ``key`` says what makes values the same."""
    return (
        f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda v: {key}), {key}) = i)"
    )


SPECIFIC = "list_filter(coalesce(raw_tags, []), lambda x: x IS NOT NULL)"

TEMPO = """SELECT rating_key, raw_bpm FROM (
    SELECT rating_key, raw_bpm, row_number() OVER (PARTITION BY rating_key ORDER BY read_at DESC, reading_id DESC) AS n
    FROM tempo_readings) WHERE n = 1"""
BPM = "CASE WHEN round_even(raw_bpm, 0) > 0 THEN round_even(raw_bpm, 0)::INT END"


def most_used(keys: str, relation: str) -> str:
    """(keys, tags): the ten tags most used."""
    return f"""SELECT {keys}, list(tag ORDER BY n DESC, tag) AS tags FROM (
        SELECT {keys}, tag, n, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, tag) AS r FROM (
            SELECT {keys}, tag, count(*) AS n FROM (SELECT {keys}, unnest(specific_tags) AS tag FROM {relation})
            WHERE tag <> '' GROUP BY {keys}, tag)) WHERE r <= 10 GROUP BY {keys}"""


LIBRARY = f"""
tracks AS (SELECT row_id, rating_key, title, artist, album, current_moods, {SPECIFIC} AS specific_tags,
                  {norm("artist")} AS _artist, {norm("album")} AS _album FROM track_items),
albums AS ({most_used("_artist, _album", "(SELECT * FROM tracks WHERE _album <> '')")}),
artists AS ({most_used("_artist", "tracks")}),
tempo AS ({TEMPO}),
united AS (SELECT tracks.*, list_concat(list_concat(specific_tags, coalesce(albums.tags, [])), coalesce(artists.tags, [])) AS every
           FROM tracks LEFT JOIN albums USING (_artist, _album) LEFT JOIN artists USING (_artist)),
kept AS (SELECT row_id, list(tag ORDER BY pos) AS all_tags FROM (
            SELECT row_id, tag, pos, row_number() OVER (PARTITION BY row_id, lower(tag) ORDER BY pos) AS n FROM (
                SELECT row_id, unnest(every) AS tag, generate_subscripts(every, 1) AS pos FROM united)) WHERE n = 1 GROUP BY row_id),
library AS (SELECT united.* EXCLUDE (every), coalesce(all_tags, []) AS all_tags, raw_bpm, {BPM} AS bpm
            FROM united LEFT JOIN kept USING (row_id) LEFT JOIN tempo USING (rating_key))"""

DRAWN = f"""
tempo AS ({TEMPO}),
plain AS (SELECT row_id, rating_key, artist, album, {SPECIFIC} AS tags FROM track_items),
drawn0 AS (SELECT row_id, rating_key, artist, album,
                  list_transform(tags, lambda t, i: ({array(lib.DRAWN)})[((length(t) * 31 + (i - 1) * 17 + row_id * 7) % {len(lib.DRAWN)} + 1)::INT]) AS all_tags
           FROM plain),
library AS (SELECT drawn0.*, list_filter(all_tags, lambda t, i: (i - 1) % 2 = 0) AS specific_tags, raw_bpm, {BPM} AS bpm
            FROM drawn0 LEFT JOIN tempo USING (rating_key))"""


def vocabulary(v: Vocabulary) -> str:
    rows = ", ".join(
        f"({r['ord']}, {text(r['target'])}, {text(r['clean'])}, {text(r['spaced'])}, {array(r['words'])}, {r['compound']}, "
        f"{array(r['stems'])}, {r['is_rock']}, {r['is_americana']}, {r['indie']})"
        for r in target_rows(v.targets)
    )
    return f"(VALUES {rows}) AS v(ord, target, vclean, spaced, vwords, compound, stems, is_rock, is_americana, indie)"


def matches(name: str, relation: str, tags: str, v: Vocabulary, k: int = 3) -> str:
    """CTEs ``{name}_hits`` (row_id, ord, target, raw, rank, score) and
    ``{name}`` (row_id, place, target, raw, score)."""
    styles = ", ".join(f"CASE WHEN {any_in('lower(f)', w)} THEN {text(s)} END" for s, w in V.INDIE_CONTEXT.items())
    clash = " OR ".join(
        f"(x = {text(a)} AND contains(acc, {text('|' + b + '|')})) OR (x = {text(b)} AND contains(acc, {text('|' + a + '|')}))"
        for a, b in v.exclusive
    ) or "false"
    gate = f"WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM {name}_hits h WHERE h.row_id = r.row_id AND h.rank < 3)" if v.consensus else ""
    return f"""
{name}_tags AS (SELECT row_id, unnest(({tags})[1:5]) AS raw, generate_subscripts(({tags})[1:5], 1) - 1 AS rank FROM {relation}),
{name}_styles AS (SELECT row_id, list_distinct(flatten(list([{styles}]))) AS styles
                  FROM (SELECT row_id, unnest(({tags})[1:3]) AS f FROM {relation}) GROUP BY row_id),
{name}_seen AS (SELECT DISTINCT raw, {norm("raw")} AS clean, {words(norm("raw"))} AS twords FROM {name}_tags),
{name}_pairs AS (
    SELECT raw, ord, target, (clean = vclean OR (length(clean) > 3 AND clean = spaced)) AS exact,
           ((NOT (compound AND list_contains({array(V.MODIFIERS)}, clean)) AND length(clean) >= 3
             AND (contains(vclean, clean) OR (len(twords) > 0 AND list_has_all(vwords, twords))))
            OR (NOT (is_rock AND (contains(clean, 'punk') OR contains(clean, 'metal')))
                AND coalesce(list_bool_or(list_transform(stems, lambda s: contains(clean, s))), false))) AS loose,
           (indie AND list_contains(twords, 'indie')) AS maybe,
           (is_americana AND list_contains({array(V.NATIONALITIES)}, clean)) AS veto
    FROM {name}_seen, {vocabulary(v)}),
{name}_scored AS (
    SELECT t.row_id, t.raw, t.rank, p.ord, p.target,
           CASE WHEN exact THEN 1.0::DOUBLE * (1.0::DOUBLE - rank * 0.04::DOUBLE)
                WHEN (loose OR (maybe AND list_contains(styles, target))) AND NOT veto
                THEN 0.95::DOUBLE * (1.0::DOUBLE - rank * 0.04::DOUBLE) END AS score
    FROM {name}_tags t JOIN {name}_pairs p USING (raw) JOIN {name}_styles USING (row_id) WHERE exact OR loose OR maybe),
{name}_hits AS (SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, ord ORDER BY score DESC, rank) AS n FROM {name}_scored WHERE score IS NOT NULL)
    WHERE n = 1),
{name}_walk AS (SELECT row_id, list_reduce(list_prepend('|', list(target ORDER BY score DESC, ord)),
                       lambda acc, x: CASE WHEN {clash} THEN acc ELSE acc || x || '|' END) AS survivors FROM {name}_hits GROUP BY row_id),
{name} AS (SELECT row_id, place - 1 AS place, target, raw, score FROM (
    SELECT row_id, target, raw, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, ord) AS place
    FROM (SELECT r.* FROM {name}_hits r JOIN {name}_walk w ON r.row_id = w.row_id AND contains(w.survivors, '|' || r.target || '|') {gate}))
    WHERE place <= {k})"""


def names_of(name: str, column: str) -> str:
    return f"{name}_list AS (SELECT row_id, list(target ORDER BY place) AS {column} FROM {name} GROUP BY row_id)"


GENRE_TAGS = f"list_filter({{t}}, lambda x: {any_in('lower(x)', V.GENRE_KEYWORDS)})"
STYLE_TAGS = f"list_filter({{t}}, lambda x: NOT list_contains({array(V.GENERIC_PRIMARY)}, {norm('x')}))"


def or_all(filtered: str, tags: str) -> str:
    x = filtered.replace("{t}", tags)
    return f"CASE WHEN len({x}) > 0 THEN {x} ELSE {tags} END"


GENRE = f"""
g_in AS (SELECT row_id, {or_all(GENRE_TAGS, "all_tags")} AS gtags FROM library),
{matches("g", "g_in", "gtags", PRIMARY)},
g_vote AS (SELECT row_id, target AS text_genre FROM (
    SELECT g.row_id, target, row_number() OVER (PARTITION BY g.row_id ORDER BY
               CASE WHEN {any_in(norm("raw"), V.CORE_KEYWORDS)} THEN 3 ELSE 1 END
               + CASE WHEN list_position(list_transform(gtags, lambda x: {norm("x")}), {norm("raw")}) BETWEEN 1 AND 3 THEN 5 ELSE 0 END DESC,
               place) AS n
    FROM g JOIN g_in USING (row_id)) WHERE n = 1)"""

SUBS = f"""
s_in AS (SELECT row_id, CASE WHEN len(specific_tags) > 0 THEN specific_tags ELSE all_tags END AS own, specific_tags, all_tags FROM library),
s1_in AS (SELECT row_id, {or_all(STYLE_TAGS, "own")} AS stags FROM s_in WHERE len(all_tags) > 0),
{matches("s1", "s1_in", "stags", SUB)}, {names_of("s1", "subs")},
s2_in AS (SELECT row_id, {or_all(STYLE_TAGS, "all_tags")} AS stags FROM s_in
          WHERE len(all_tags) > 0 AND len(specific_tags) > 0 AND row_id NOT IN (SELECT row_id FROM s1_list)),
{matches("s2", "s2_in", "stags", SUB)}, {names_of("s2", "subs")},
subs AS (SELECT library.row_id, coalesce(s1_list.subs, s2_list.subs, []) AS sub_genres
         FROM library LEFT JOIN s1_list USING (row_id) LEFT JOIN s2_list USING (row_id)),
styled AS (SELECT library.*, sub_genres, text_genre,
                  CASE WHEN text_genre = 'Rock' AND {has("sub_genres", V.PUNK_STYLES)} THEN 'Punk'
                       WHEN text_genre = 'Rock' AND {has("sub_genres", V.METAL_STYLES)} THEN 'Metal' ELSE text_genre END AS genre
           FROM library JOIN subs USING (row_id) LEFT JOIN g_vote USING (row_id))"""


def names_it(tag: str, name: str) -> str:
    n = norm(name)
    longer = rf"list_filter(string_split_regex({n}, '[\s\p{{Z}}]+'), lambda w: length(w) > 3)"
    return (
        f"(contains({tag}, {n}) OR contains({n}, {tag}) OR "
        f"coalesce(list_bool_or(list_transform({longer}, lambda w: contains({tag}, w))), false))"
    )


def reason(tag: str, artist: str, album: str) -> str:
    t = norm(tag)
    return f"""CASE WHEN {any_in(t, V.GENRE_KEYWORDS)} THEN 'genre'
        WHEN {names_it(t, f"coalesce({artist}, '')")} THEN 'artist'
        WHEN coalesce({album}, '') <> '' AND {names_it(t, album)} THEN 'album'
        WHEN regexp_matches({t}, '\\p{{N}}') THEN 'digit'
        WHEN NOT {any_in(t, V.MOOD_KEYWORDS)} THEN 'unknown'
        WHEN {any_in(t, V.BOILERPLATE)} THEN 'boilerplate' END"""


def gated(relation: str, tags: str, into: str) -> str:
    """(row_id, into): tags that pass the mood gate, in order."""
    return f"""SELECT row_id, list(tag ORDER BY pos) AS {into} FROM (
        SELECT row_id, artist, album, unnest({tags}) AS tag, generate_subscripts({tags}, 1) AS pos FROM {relation})
        WHERE {reason("tag", "artist", "album")} IS NULL GROUP BY row_id"""


_TOP = """SELECT key, list({label: label, score: score} ORDER BY rank) AS top FROM ranked GROUP BY key"""
MEANS = """
cells AS (SELECT (vec_id // 8)::INT AS key, generate_subscripts(embedding, 1) - 1 AS class,
                 round(abs(unnest(embedding)::DOUBLE) * 1e6)::BIGINT AS x FROM embeddings),
means AS (SELECT key, class, round(avg(x) / 1e6 * ((class % 10 + 1) / 10.0::DOUBLE), 10) AS score FROM cells GROUP BY key, class)"""
RANKED = f"""{MEANS},
ranked AS (SELECT key, rank, class, score, ({array(lib.LABELS)})[class + 1] AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, class DESC) AS rank FROM means) WHERE rank <= 10),
tops AS ({_TOP})"""

MAPPED = f"MAP({array(V.AUDIO_LABEL_MOODS)}, {array(V.AUDIO_LABEL_MOODS.values())})"
WANTED = [k for k, v in V.AUDIO_LABEL_MOODS.items() if v.lower() in V.CONFIGURED_MOODS]
_GATE = f"""(list_contains({array(WANTED)}, lower(p.label)) AND p.score >= 0.05)
    OR (CASE WHEN lower(p.label) IN ('love', 'melodic') THEN p.score >= 0.16 ELSE p.score >= 0.10 END)"""
SURE = f"""{RANKED},
marked AS (SELECT key, rank, label, score FROM ranked p WHERE NOT list_contains({array(V.AUDIO_GENERIC_LABELS)}, lower(label))),
firm AS (SELECT * FROM marked p WHERE {_GATE}),
sure AS (SELECT * FROM firm UNION ALL SELECT * FROM marked
         WHERE key NOT IN (SELECT key FROM firm) AND lower(label) <> 'melodic' AND score >= 0.08),
label_in AS (SELECT row_number() OVER (ORDER BY label) AS row_id, label, [label] AS tags FROM (SELECT DISTINCT label FROM sure)
             WHERE NOT map_contains({MAPPED}, lower(label))),
{matches("lm", "label_in", "tags", MOODS)},
said AS (SELECT key, rank, 0 AS place, {MAPPED}[lower(label)] AS mood, score FROM sure WHERE map_contains({MAPPED}, lower(label))
         UNION ALL SELECT key, rank, place, target, sure.score FROM sure JOIN label_in USING (label) JOIN lm USING (row_id)),
mapped AS (SELECT key, list(mood ORDER BY rank, place) AS moods FROM (
    SELECT key, mood, min(rank) AS rank, arg_min(place, rank) AS place FROM said GROUP BY key, mood) GROUP BY key),
heard0 AS (SELECT key, coalesce(moods, []) AS mapped FROM (SELECT DISTINCT key FROM means) LEFT JOIN mapped USING (key))"""


def tempo_valid(moods: str) -> str:
    return f"""CASE WHEN bpm IS NULL THEN {moods} ELSE list_filter({moods}, lambda q: NOT ((lower(q) = 'energetic' AND bpm < 130)
        OR (lower(q) = 'lively' AND bpm < 115) OR (lower(q) IN ('relaxed', 'calm', 'mellow') AND bpm > 120))) END"""


def supported(moods: str) -> str:
    return f"""CASE WHEN {has(moods, V.AUDIO_SUPPORT_MOODS)} OR (coalesce(bpm >= 130, false) AND {has(moods, ["energetic"])})
        OR (coalesce(bpm BETWEEN 110 AND 129, false) AND {has(moods, ["lively"])})
        THEN {moods} ELSE {without(moods, ["energetic", "lively"])} END"""


def heard(source: str) -> str:
    """CTE ``heard`` (key, bpm, moods, score, accepted) from (key, bpm)."""
    return f"""
h1 AS (SELECT k.key, k.bpm, {tempo_valid("mapped")} AS moods FROM {source} k JOIN heard0 USING (key)),
h2 AS (SELECT key, bpm, {supported("moods")} AS moods FROM h1),
h3 AS (SELECT h2.key, h2.bpm, h2.moods, coalesce(max(s.score), 0.0) AS score FROM h2 LEFT JOIN sure s
       ON s.key = h2.key AND map_contains({MAPPED}, lower(s.label)) AND list_contains(h2.moods, {MAPPED}[lower(s.label)])
       GROUP BY h2.key, h2.bpm, h2.moods),
h4 AS (SELECT h3.*, (SELECT max(score) FROM ranked r WHERE r.key = h3.key) AS best,
              (SELECT list(label) FROM ranked r WHERE r.key = h3.key) AS labels FROM h3),
h5 AS (SELECT key, bpm, CASE WHEN len(moods) > 0 THEN moods ELSE list_filter({array(V.CONFIGURED_MOODS)},
                 lambda m: list_bool_or(list_transform(labels, lambda l: contains(lower(l), m)))) END AS moods,
              CASE WHEN score = 0 AND len(moods) > 0 THEN best ELSE score END AS score FROM h4),
heard AS (SELECT *, CASE WHEN score >= 0.1 THEN moods ELSE []::VARCHAR[] END AS accepted FROM h5)"""


SEEDS = f"MAP({array(V.GENRE_MOOD_SEEDS)}, [{', '.join(array(v) for v in V.GENRE_MOOD_SEEDS.values())}])"
_SEEDED = f"flatten(list_transform(sub_genres, lambda s: coalesce({SEEDS}[s], [])))"

def mooded(base: str) -> str:
    return f"""{base}, {GENRE}, {SUBS},
tm_in AS ({gated("library", "specific_tags", "mtags")}),
{matches("tm", "tm_in", "mtags", MOODS)}, {names_of("tm", "moods")},
{SURE}, quiet AS (SELECT DISTINCT key, NULL::INT AS bpm FROM means), {heard("quiet")},
mooded AS (SELECT styled.*, coalesce(tm_list.moods, []) AS text, tops.top,
                  CASE WHEN row_id % 3 <> 0 THEN coalesce(heard.accepted, []) ELSE [] END AS audio,
                  coalesce({ordered_distinct("seeds0")}, []) AS seeds
           FROM (SELECT styled.*, {_SEEDED} AS seeds0 FROM styled) styled LEFT JOIN tm_list USING (row_id)
           LEFT JOIN tops ON tops.key = row_id % {RECORDINGS} LEFT JOIN heard ON heard.key = row_id % {RECORDINGS})"""


def predicted(label: str) -> str:
    return f"coalesce(list_filter(top, lambda p: lower(p.label) = '{label}')[-1].score, 0.0)"


ADMITTED = f"""
flags AS (SELECT *, ({predicted("energetic")} >= 0.15 OR {predicted("heavy")} >= 0.08 OR {predicted("aggressive")} >= 0.05
                     OR {predicted("dark")} >= 0.10 OR {has("audio", V.ROWDY_MOODS)} OR {has("sub_genres", V.ROWDY_STYLES)}) AS rowdy,
                 coalesce(bpm >= 125, false) AS fast,
                 (coalesce(bpm < 100, false) AND NOT ({predicted("heavy")} >= 0.08 OR {predicted("aggressive")} >= 0.05)) AS slow
          FROM mooded),
admitted AS (SELECT *, list_filter(seeds, lambda s: CASE WHEN lower(s) = 'chill hang' THEN NOT (fast OR rowdy)
                 WHEN lower(s) IN ('rowdy', 'aggressive', 'heavy')
                 THEN NOT slow AND (len(audio) = 0 OR list_contains(text, s) OR list_contains(audio, s))
                 ELSE len(audio) = 0 OR list_contains(text, s) OR list_contains(audio, s) END) AS kept FROM flags)"""


def tempo_checked(moods: str) -> str:
    renamed = f"list_transform({moods}, lambda q: CASE WHEN lower(q) = 'energetic' THEN 'Lively' ELSE q END)"
    return f"""CASE WHEN bpm IS NULL THEN {moods} WHEN bpm >= 130 THEN {without(moods, ["lively"])}
        WHEN bpm >= 110 THEN {ordered_distinct(renamed, "lower(v)")} ELSE {without(moods, ["energetic", "lively"])} END"""


def conflict_chain(source: str, moods: str, keep: str) -> tuple[str, str]:
    """CTEs for the six passes, and the name of the last."""
    out, at = [], source
    for i, (present, dropped) in enumerate(V.MOOD_CONFLICTS):
        out.append(f"c{i} AS (SELECT {keep}, CASE WHEN {has(moods, present)} THEN {without(moods, dropped)} ELSE {moods} END AS {moods} FROM {at})")
        at = f"c{i}"
    both = f"{has(moods, ['energetic'])} AND {has(moods, ['lively'])}"
    out.append(f"c9 AS (SELECT {keep}, CASE WHEN {both} THEN {without(moods, ['lively'])} ELSE {moods} END AS {moods} FROM {at})")
    return ", ".join(out), "c9"


def specific_first(moods: str) -> str:
    general = f"list_filter({moods}, lambda q: lower(q) IN ('energetic', 'lively'))"
    return f"list_concat({without(moods, ['energetic', 'lively'])}, {general})"


MOOD_LISTS = f"""
tempo AS ({TEMPO}),
m0 AS (SELECT row_id, rating_key, list_filter(list_concat(coalesce(current_moods, []), coalesce(raw_tags, [])), lambda x: x IS NOT NULL) AS names FROM track_items),
listed AS (SELECT row_id, {ordered_distinct("names")} AS moods, {BPM} AS bpm FROM m0 LEFT JOIN tempo USING (rating_key))"""

_CHAIN, _LAST = conflict_chain("listed", "moods", "row_id")
_FULL, _FULL_LAST = conflict_chain("checked", "moods", "row_id")

FLAG_MOODS = f"""
tm_in AS ({gated("library", "specific_tags", "mtags")}),
{matches("tm", "tm_in", "mtags", MOODS)}, {names_of("tm", "moods")},
mooded AS (SELECT styled.*, coalesce(tm_list.moods, []) AS text, []::STRUCT(label VARCHAR, score DOUBLE)[] AS top, []::VARCHAR[] AS audio,
                  coalesce({ordered_distinct("seeds0")}, []) AS seeds
           FROM (SELECT styled.*, {_SEEDED} AS seeds0 FROM styled) styled LEFT JOIN tm_list USING (row_id))"""

FINAL = f"""{ADMITTED},
joined0 AS (SELECT *, list_concat(list_concat(text, kept), audio) AS every_mood FROM admitted),
combined AS (SELECT *, {ordered_distinct("every_mood")} AS m0 FROM joined0),
checked AS (SELECT row_id, {tempo_checked("m0")} AS moods FROM combined),
{_FULL},
final AS (SELECT row_id, {specific_first("moods")} AS moods FROM {_FULL_LAST})"""

FLAGSHIP = f"""WITH {LIBRARY}, {GENRE}, {SUBS}, {FLAG_MOODS}, {FINAL},
enriched AS (SELECT styled.*, final.moods FROM styled JOIN final USING (row_id))"""


def bar(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def shown(x: str) -> str:
    return f"CASE WHEN coalesce(array_to_string({x}, ', '), '') = '' THEN '(None)' ELSE array_to_string({x}, ', ') END"


def matched(base: str, relation: str, tags: str, v: Vocabulary, k: int = 3) -> str:
    return f"""WITH {base}, {matches("x", relation, tags, v, k)}
    SELECT row_id, place::INT AS place, target, raw, round(score, 6) AS score FROM x"""


_LABELS = [lib.GENRE_LABELS[i % len(lib.GENRE_LABELS)] for i in range(len(lib.LABELS))]
_AUDIO_GENRES = f"""{RANKED},
al AS (SELECT key AS row_id, rank, ({array(_LABELS)})[class + 1] AS label FROM ranked WHERE score >= 0.10),
ap AS (SELECT row_id, list(genre ORDER BY rank) AS genres, list(style ORDER BY rank) AS styles FROM (
           SELECT row_id, rank, CASE WHEN contains(g, 'Folk') THEN 'Folk' WHEN contains(g, 'Hip Hop') THEN 'Hip-Hop' ELSE g END AS genre, style
           FROM (SELECT row_id, rank, trim(split_part(label, '---', 1)) AS g, trim(split_part(label, '---', 2)) AS style FROM al)) GROUP BY row_id),
{matches("ag", "ap", "genres", PRIMARY)}, {matches("ah", "ap", "styles", SUB)}, {names_of("ah", "subs")},
ak AS (SELECT k.key, ag.target AS first_genre, coalesce(ah_list.subs, []) AS sub_genres,
              list_transform(list_concat(coalesce(ah_list.subs, []), coalesce(ap.styles, [])), lambda x: lower(x)) AS said
       FROM (SELECT DISTINCT key FROM ranked) k LEFT JOIN ap ON ap.row_id = k.key LEFT JOIN ag ON ag.row_id = k.key AND ag.place = 0
       LEFT JOIN ah_list ON ah_list.row_id = k.key),
heard_genres AS (SELECT key, sub_genres, CASE WHEN len(sub_genres) = 0 THEN first_genre
                        WHEN list_bool_or(list_transform(said, lambda x: contains(x, 'punk'))) THEN 'Punk'
                        WHEN list_bool_or(list_transform(said, lambda x: contains(x, 'metal'))) THEN 'Metal' ELSE first_genre END AS genre FROM ak)"""


def letters(x: str) -> str:
    return f"list_transform({array(lib.LetterCounts.letters)}, lambda c: (length(lower({x})) - length(replace(lower({x}), c, '')))::DOUBLE)"


_VECTORS = f"""WITH {MOOD_LISTS}, {matches("x", "listed", "moods", MOODS)},
tv AS (SELECT ord, target, {letters("target || ' music'")} AS v FROM (SELECT unnest({array(MOODS.targets)}) AS target, generate_subscripts({array(MOODS.targets)}, 1) - 1 AS ord)),
rv AS (SELECT raw, {letters("raw")} AS v FROM (SELECT DISTINCT unnest(moods) AS raw FROM listed)),
sims AS (SELECT raw, ord, target, round(list_dot_product(rv.v, tv.v) / (greatest(sqrt(list_dot_product(rv.v, rv.v)), 1e-9)
                * greatest(sqrt(list_dot_product(tv.v, tv.v)), 1e-9)), 6) AS c FROM rv, tv),
tagged AS (SELECT row_id, unnest(moods) AS raw, generate_subscripts(moods, 1) - 1 AS rank FROM listed),
near AS (SELECT *, row_number() OVER (PARTITION BY row_id, ord ORDER BY c DESC, rank) AS n FROM tagged JOIN sims USING (raw)),
far AS (SELECT row_id, ord, target, raw, c * greatest(0.40::DOUBLE, 1.0::DOUBLE - rank * 0.05::DOUBLE) AS score FROM near
        WHERE n = 1 AND NOT list_contains({array(V.NEEDS_KEYWORD)}, target) AND NOT list_contains({array(V.GENERIC_FOR_VECTORS)}, {norm("raw")})),
every_hit AS (SELECT row_id, ord, target, raw, score FROM x_hits
              UNION ALL SELECT * FROM far WHERE score >= 0.8::DOUBLE * 0.80::DOUBLE
                        AND NOT EXISTS (SELECT 1 FROM x_hits h WHERE h.row_id = far.row_id AND h.ord = far.ord)),
placed AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, ord) AS n FROM every_hit)
SELECT row_id, (n - 1)::INT AS place, target, raw, round(score, 6) AS score FROM placed WHERE n <= 3"""

_EMPTY = "[]::VARCHAR[]"
_PLAIN = f"plain_rows AS (SELECT row_id, artist, album, {SPECIFIC} AS tags FROM track_items)"
_OLD = "coalesce(existing[{f}], [])"


def _merged(new: str, old: str) -> str:
    return f"CASE WHEN len({new}) > 0 AND (coalesce(overwrite_tags, false) OR len({old}) = 0) THEN {new} ELSE {old} END"


_FIELDS = {"genre": "coalesce(genres, [])", "mood": "coalesce(moods, [])", "bpm": f"CASE WHEN bpm IS NULL THEN {_EMPTY} ELSE [bpm::VARCHAR] END"}
_CHANGED = " OR ".join(
    f"(len({new}) > 0 AND (coalesce(overwrite_tags, false) OR len({_OLD.format(f=text(f))}) = 0))" for f, new in _FIELDS.items()
)
_EXT = r"regexp_extract(lower(coalesce(file_path, '')), '(\.[^./]*)$', 1)"


def _frames() -> str:
    parts = []
    for kind in (".mp3", ".flac", ".m4a"):
        ext = "('.m4a', '.mp4')" if kind == ".m4a" else f"('{kind}')"
        for field, frames in FRAMES[kind].items():
            for frame in frames:
                held = f"coalesce(existing[{text(field)}], [])" if frame == frames[0] else _EMPTY
                parts.append(
                    f"SELECT write_id, {text(frame)} AS frame, {bar(_FIELDS[field])} AS values FROM tag_writes WHERE {_EXT} IN {ext} "
                    f"AND len({_FIELDS[field]}) > 0 AND (coalesce(overwrite_tags, false) OR len({held}) = 0)"
                )
    return " UNION ALL ".join(parts)


_CENTRES = """
cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
sums AS (SELECT label, dim, sum(round(x * 1e6)::BIGINT)::DOUBLE AS s FROM cells GROUP BY label, dim),
order_of AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS target FROM (SELECT DISTINCT label FROM embeddings)),
lengths AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-9) AS a FROM cells GROUP BY vec_id),
widths AS (SELECT label, greatest(sqrt(sum(s * s)), 1e-9) AS b FROM sums GROUP BY label),
dots AS (SELECT vec_id, s.label, sum(x * s) AS d FROM cells c JOIN sums s USING (dim) GROUP BY vec_id, s.label),
sims AS (SELECT vec_id, target, d / (a * b) AS c FROM dots JOIN lengths USING (vec_id) JOIN widths USING (label) JOIN order_of USING (label))"""
_LISTS = f"""{_CENTRES},
lists AS (SELECT (vec_id // 8)::INT AS grp, vec_id, target, round(c, 6) AS c,
                 dense_rank() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS rank FROM sims)"""

ORACLE: dict[str, str] = {
    "flagship_enrich": f"""{FLAGSHIP}
    SELECT row_id, genre, {bar("sub_genres")} AS sub_genres, bpm, {bar("moods")} AS moods, moods[1] AS mapped_mood,
           CASE WHEN len(moods) > 0 THEN 1.0 ELSE 0.0 END AS confidence FROM enriched""",
    "run_summary": f"""{FLAGSHIP},
    f AS (SELECT *, (genre IS NOT NULL OR len(sub_genres) > 0 OR len(moods) > 0 OR bpm IS NOT NULL) AS e FROM enriched)
    SELECT count(*) AS n_tracks, count_if(e) AS n_enriched, count_if(NOT e) AS n_skipped, count(genre) AS n_genre,
           count_if(len(sub_genres) > 0) AS n_sub_genre, count_if(len(moods) > 0) AS n_mood, count(bpm) AS n_bpm FROM f""",
    "before_after_report": f"""{FLAGSHIP},
    f AS (SELECT *, CASE WHEN genre IS NULL THEN sub_genres ELSE list_prepend(genre, sub_genres) END AS genres FROM enriched)
    SELECT row_id::VARCHAR AS rating_key, '(None)' AS genres_before, {shown("genres")} AS genres_after,
           {shown("current_moods")} AS moods_before, {shown("moods")} AS moods_after, coalesce(bpm::VARCHAR, '(None)') AS bpm_after FROM f""",
    "tag_union_dedup": f"WITH {LIBRARY} SELECT row_id, {bar('all_tags')} AS tags FROM library",
    "api_top10_tags": f"""WITH tracks AS (SELECT {norm("artist")} AS artist_key, {SPECIFIC} AS specific_tags FROM track_items)
    SELECT artist_key, {bar("tags")} AS tags FROM ({most_used("artist_key", "tracks")})""",
    "api_ranked_tags": f"""SELECT row_id, {bar("list(tag ORDER BY pos)")} AS tags FROM (
        SELECT row_id, tag, pos, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS n FROM (
            SELECT row_id, unnest(raw_tags) AS tag, generate_subscripts(raw_tags, 1) AS pos FROM track_items) WHERE tag <> '')
    WHERE n <= 3 GROUP BY row_id""",
    "source_lookup": f"""WITH tracks AS (SELECT artist, {SPECIFIC} AS specific_tags FROM track_items),
    source AS ({most_used("artist", "tracks")}),
    keyed AS (SELECT {norm("artist")} AS k, min(tags) AS tags FROM source GROUP BY k)
    SELECT result_id, array_to_string(tags, '|') AS tags FROM processed_tracks LEFT JOIN keyed ON k = {norm("artist")}""",
    "source_fallback": f"""SELECT write_id,
        {bar("CASE WHEN NOT overwrite_tags AND len(genres) > 0 THEN genres ELSE moods END")} AS track_tags,
        {bar(f"CASE WHEN overwrite_tags THEN {_EMPTY} WHEN len(genres) > 0 THEN genres ELSE moods END")} AS artist_tags FROM tag_writes""",
    "html_tag_scrape": f"""WITH t AS (SELECT row_id, list_filter(list_transform({SPECIFIC},
            lambda x: regexp_replace(replace(x, '+', ' '), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS tags FROM track_items)
    SELECT row_id, {bar(ordered_distinct("tags", "lower(v)"))} AS tags FROM t""",
    "recording_json_tags": f"""WITH t AS (SELECT row_id, artist, list_filter({SPECIFIC}, lambda x: x <> '') AS own,
            list_filter(coalesce(current_moods, []), lambda x: x <> '') AS moods FROM track_items),
    u AS (SELECT row_id, list_concat(own, moods) AS tags FROM t)
    SELECT row_id, {bar(ordered_distinct("tags"))} AS tags FROM u""",
    "release_json_tags": f"""WITH u AS (SELECT write_id, list_concat(genres, moods) AS tags FROM tag_writes)
    SELECT write_id, {bar(ordered_distinct("tags"))} AS tags FROM u""",
    "lookup_requests": """WITH t AS (SELECT row_id, replace(url_encode(artist), '%20', '+') AS a, replace(url_encode(album), '%20', '+') AS b,
            replace(url_encode(title), '%20', '+') AS t, replace(artist, '"', '\\"') AS qa, replace(title, '"', '\\"') AS qt, artist, title FROM track_items)
    SELECT row_id, 'https://tags.example/' || a || '/+tags' AS artist_page, 'https://tags.example/' || a || '/' || b || '/+tags' AS album_page,
           'https://tags.example/' || a || '/_/' || t || '/+tags' AS track_page,
           'https://tags.example/recording?query=' || replace(url_encode('artist:"' || qa || '" AND (recording:"' || qt || '" OR track:"' || qt || '")'), '%2F', '/')
           || '&fmt=json' AS recording,
           'https://tags.example/search?q=' || replace(url_encode(artist || ' - ' || title), '%2F', '/') || '&type=release' AS release FROM t""",
    "awkward_payloads": "SELECT * FROM (VALUES " + ", ".join(f"({text(k)}, {n}, {text(t)})" for k, n, _, _, t in PAYLOADS) + ") AS v(kind, number, tags)",
    "catalog_export": f"""SELECT row_id::VARCHAR AS rating_key, title, artist, coalesce(album, '') AS album, coalesce(file_path, '') AS file_path,
        {bar("current_moods")} AS current_moods FROM track_items""",
    "genre_keyword_prefilter": f"WITH {_PLAIN} SELECT row_id, {bar(or_all(GENRE_TAGS, 'tags'))} AS tags FROM plain_rows",
    "subgenre_generic_filter": f"WITH {LIBRARY} SELECT row_id, {bar(or_all(STYLE_TAGS, 'all_tags'))} AS tags FROM library",
    "mood_tag_gate": f"""WITH {LIBRARY}, passed AS ({gated("library", "all_tags", "tags")})
    SELECT row_id, {bar("tags")} AS tags FROM library LEFT JOIN passed USING (row_id)""",
    "mood_gate_reason_counts": f"""WITH {_PLAIN}, t AS (SELECT artist, album, unnest(tags) AS tag FROM plain_rows)
    SELECT coalesce({reason("tag", "artist", "album")}, 'kept') AS reason, count(*) AS n_tags FROM t GROUP BY 1""",
    "artist_substring_filter": "SELECT row_id, artist FROM track_items WHERE contains(lower(artist), 'orchestra')",
    "artist_identity": f"""WITH p AS (SELECT row_id, result_id, {norm("t.artist")} AS e, {norm("p.artist")} AS c
        FROM track_items t JOIN processed_tracks p USING (rating_key))
    SELECT row_id, result_id, (e = '' OR c = '' OR e = c OR e = 'the ' || c OR c = 'the ' || e
        OR {" OR ".join(f"starts_with(c, e || {text(s)})" for s in V.ARTIST_SEPARATORS)}) AS same_artist FROM p""",
    "path_remap": """SELECT row_id, CASE WHEN starts_with(file_path, '/srv/tunes') THEN '/mnt/library' || substr(file_path, 11)
        ELSE file_path END AS path FROM track_items""",
    "existing_files": """SELECT row_id, coalesce(file_path <> '' AND file_path IN (SELECT file_path FROM tag_writes WHERE file_path IS NOT NULL), false)
        AS present FROM track_items""",
    "unprocessed_tracks": "SELECT row_id, rating_key FROM track_items WHERE rating_key NOT IN (SELECT rating_key FROM processed_tracks)",
    "limited_tracks": "SELECT row_id, title FROM track_items ORDER BY row_id LIMIT 100",
    "random_sample_limit": "SELECT row_id, title FROM track_items ORDER BY md5(concat_ws(':', 7, row_id)), row_id LIMIT 100",
    "lexical_match_scores": f"""WITH {LIBRARY}, {matches("x", "library", "all_tags", SUB)}
    SELECT row_id, target, raw, rank::INT AS rank, round(score, 6) AS score FROM x_hits""",
    "primary_genre_matches": matched(_PLAIN, "plain_rows", "tags", PRIMARY),
    "subgenre_matches": matched(LIBRARY, "library", "all_tags", SUB),
    "taxonomy_subgenre_matches": matched(DRAWN, "library", "all_tags", SUB),
    "style_exclusion": matched(DRAWN, "library", "all_tags", Vocabulary(SUB.targets, vectors=False), len(SUB.targets)),
    "consensus_gate": matched(
        DRAWN, "library", "all_tags", Vocabulary(tuple(t for t in SUB.targets if t not in EXCLUDING), vectors=False, consensus=True), len(SUB.targets)
    ),
    "taxonomy_mood_gate": f"""WITH {DRAWN}, passed AS ({gated("library", "all_tags", "tags")})
    SELECT row_id, {bar("tags")} AS tags FROM library LEFT JOIN passed USING (row_id)""",
    "taxonomy_genre_elevation": f"WITH {DRAWN}, {GENRE}, {SUBS} SELECT row_id, genre FROM styled",
    "taxonomy_primary_mood": f"WITH {mooded(DRAWN)}, {FINAL} SELECT row_id, {bar('moods')} AS moods, moods[1] AS mapped_mood FROM final",
    "mood_lexical_matches": matched(MOOD_LISTS, "listed", "moods", MOODS),
    "taxonomy_mood_matches": matched(DRAWN, "library", "all_tags", MOODS),
    "mood_vector_matches": _VECTORS,
    "mood_tag_matches": matched(LIBRARY, "library", "all_tags", MOOD_TAGS, 5),
    "primary_genre_vote": f"WITH {LIBRARY}, {GENRE} SELECT row_id, text_genre AS genre FROM library LEFT JOIN g_vote USING (row_id)",
    "subgenre_fallback": f"WITH {LIBRARY}, {GENRE}, {SUBS} SELECT row_id, {bar('sub_genres')} AS sub_genres FROM styled",
    "genre_elevation": f"WITH {LIBRARY}, {GENRE}, {SUBS} SELECT row_id, genre FROM styled",
    "genre_list": f"""WITH {LIBRARY}, {GENRE}, {SUBS}
    SELECT row_id, {bar("CASE WHEN text_genre IS NULL THEN sub_genres ELSE list_prepend(text_genre, sub_genres) END")} AS genres FROM styled""",
    "seeded_moods": f"""WITH {LIBRARY}, {GENRE}, {SUBS}, f AS (SELECT row_id, {_SEEDED} AS s FROM styled)
    SELECT row_id, {bar(ordered_distinct("s"))} AS moods FROM f""",
    "text_moods": f"WITH {mooded(LIBRARY)} SELECT row_id, {bar('text')} AS moods FROM mooded",
    "seed_admission": f"WITH {mooded(LIBRARY)}, {ADMITTED} SELECT row_id, {bar('kept')} AS moods FROM admitted",
    "tempo_mood_rules": f"WITH {MOOD_LISTS} SELECT row_id, {bar(tempo_checked('moods'))} AS moods FROM listed",
    "mood_conflicts": f"WITH {MOOD_LISTS}, {_CHAIN} SELECT row_id, {bar('moods')} AS moods FROM {_LAST}",
    "mood_priority_order": f"WITH {MOOD_LISTS} SELECT row_id, {bar(specific_first('moods'))} AS moods FROM listed",
    "primary_mood": f"WITH {mooded(LIBRARY)}, {FINAL} SELECT row_id, {bar('moods')} AS moods, moods[1] AS mapped_mood FROM final",
    "audio_mean_pool": f"WITH {MEANS} SELECT key, class::INT AS class, score FROM means",
    "audio_top10": f"WITH {RANKED} SELECT key, rank::INT AS rank, class::INT AS class, score FROM ranked",
    "audio_confidence_gate": f"""WITH {SURE} SELECT key, {bar("list(label ORDER BY rank) FILTER (label IS NOT NULL)")} AS labels
    FROM (SELECT DISTINCT key FROM means) LEFT JOIN sure USING (key) GROUP BY key""",
    "audio_mood_map": f"WITH {SURE} SELECT key, {bar('mapped')} AS moods FROM heard0",
    "audio_tempo_validation": f"WITH {MOOD_LISTS} SELECT row_id, {bar(tempo_valid('moods'))} AS moods FROM listed",
    "audio_standalone_rule": f"WITH {MOOD_LISTS} SELECT row_id, {bar(supported('moods'))} AS moods FROM listed",
    "audio_matched_score": f"""WITH {SURE}, keys AS (SELECT DISTINCT key FROM means),
    tempi AS (SELECT key, unnest([{", ".join("NULL" if t is None else str(t) for t in TEMPI)}]::INT[]) AS bpm FROM keys), {heard("tempi")}
    SELECT key, bpm, {bar("moods")} AS moods, round(score, 6) AS score, {bar("accepted")} AS accepted FROM heard""",
    "audio_genre_labels": f"""WITH {_AUDIO_GENRES} SELECT key, genre, {bar("sub_genres")} AS sub_genres FROM heard_genres""",
    "audio_genre_fallback": f"""WITH {LIBRARY}, {GENRE}, {SUBS}, {_AUDIO_GENRES},
    b AS (SELECT styled.*, h.genre AS h_genre, CASE WHEN text_genre IS NULL THEN coalesce(h.sub_genres, []) ELSE [] END AS h_subs
          FROM styled LEFT JOIN heard_genres h ON h.key = row_id % {RECORDINGS})
    SELECT row_id, CASE WHEN len(h_subs) > 0 THEN h_genre WHEN genre IS NOT NULL THEN genre
                WHEN h_genre = 'Rock' AND {has("sub_genres", V.PUNK_STYLES)} THEN 'Punk'
                WHEN h_genre = 'Rock' AND {has("sub_genres", V.METAL_STYLES)} THEN 'Metal' ELSE h_genre END AS genre,
           {bar("CASE WHEN len(h_subs) > 0 THEN h_subs ELSE sub_genres END")} AS sub_genres FROM b""",
    "audio_unlabelled_mood": f"""SELECT vec_id, CASE WHEN list_max(embedding[1:{len(MOODS.targets)}]) > 0
        THEN ({array(MOODS.targets)})[list_position(embedding[1:{len(MOODS.targets)}], list_max(embedding[1:{len(MOODS.targets)}]))] ELSE '' END AS moods FROM embeddings""",
    "bpm_half_even": f"SELECT reading_id, {BPM} AS bpm FROM tempo_readings",
    "cosine_matrix": f"WITH {_CENTRES} SELECT vec_id, target::INT AS target, round(c, 5) AS cosine FROM sims",
    "best_pair_match": f"""WITH {_LISTS}, b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, rank, target) AS n FROM lists)
    SELECT grp, CASE WHEN c >= 0.3 THEN 'target ' || target END AS accepted, 'target ' || target AS best, 'tag ' || vec_id AS raw, c AS score
    FROM b WHERE n = 1""",
    "rank_weighted_similarity": f"""WITH {_LISTS},
    near AS (SELECT *, row_number() OVER (PARTITION BY grp, target ORDER BY c DESC, rank) AS n FROM lists),
    eff AS (SELECT grp, target, vec_id, c * greatest(0.40::DOUBLE, 1.0::DOUBLE - rank * 0.05::DOUBLE) AS s FROM near WHERE n = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s DESC, target) AS place FROM eff WHERE s >= 0.2::DOUBLE * 0.80::DOUBLE)
    SELECT grp, (place - 1)::INT AS place, ({array(TARGETS)})[(target + 1)::INT] AS target, 'tag ' || vec_id AS raw, round(s, 8) AS score FROM r WHERE place <= 3""",
    "write_if_empty": f"""SELECT write_id,
        {", ".join(f"{bar(_merged(new, _OLD.format(f=text(f))))} AS {f}_after" for f, new in _FIELDS.items())},
        (coalesce(file_path, '') <> '' AND {_EXT} IN ('.mp3', '.flac', '.m4a', '.mp4') AND ({_CHANGED})) AS changed, modified FROM tag_writes""",
    "frame_merge": _frames(),
    "catalog_sync": f"""WITH w AS (SELECT *, try_cast(existing['bpm'][1] AS INT) AS old_bpm, coalesce(existing['genre'], []) AS og,
            coalesce(existing['mood'], []) AS om, coalesce(overwrite_tags, false) AS o FROM tag_writes),
    f AS (SELECT *, len(genres) > 0 AND (o OR len(og) = 0) AS wg, len(moods) > 0 AND (o OR len(om) = 0) AS wm FROM w)
    SELECT write_id, CASE WHEN wg THEN {bar("og")} ELSE '' END AS remove_genres, CASE WHEN wg THEN {bar("genres")} ELSE '' END AS add_genres,
           CASE WHEN wm THEN {bar("om")} ELSE '' END AS remove_moods, CASE WHEN wm THEN {bar("moods")} ELSE '' END AS add_moods, wm AS lock_moods,
           CASE WHEN bpm IS NOT NULL AND (o OR old_bpm IS NULL OR old_bpm = 0) THEN bpm END AS bpm FROM f""",
    "catalog_mood_overwrite": f"""SELECT write_id, CASE WHEN len(moods) > 0 THEN {bar("coalesce(existing['mood'], [])")} ELSE '' END AS removed,
           coalesce(moods[1], '') AS added, coalesce(moods[1] IS NOT NULL, false) AS lock_moods FROM tag_writes""",
    "file_sink_gates": f"""WITH w AS (SELECT write_id, {_EXT} AS ext, coalesce(file_path <> '' AND modified, false) AS there FROM tag_writes)
    SELECT write_id, there AND ext IN ('.mp3', '.flac', '.m4a', '.mp4') AS written, there AS in_dry_run, false AS when_disabled FROM w""",
    "catalog_merge": f"""WITH w AS (SELECT *, try_cast(existing['bpm'][1] AS INT) AS old FROM tag_writes)
    SELECT write_id, CASE WHEN bpm IS NOT NULL AND (coalesce(overwrite_tags, false) OR old IS NULL OR old = 0) THEN bpm ELSE old END AS bpm,
           {bar(_merged("moods", _OLD.format(f="'mood'")))} AS moods FROM w""",
    "mood_command": """SELECT write_id, CASE WHEN file_path <> '' AND moods[1] IS NOT NULL
        THEN 'beet modify -y path:' || file_path || ' mood=' || moods[1] END AS command FROM tag_writes""",
    "state_upsert": """WITH r AS (SELECT *, coalesce(processed_at, TIMESTAMP '1970-01-01') AS at_, lower(source) = 'audio' AS first_ FROM processed_tracks),
    n AS (SELECT *, row_number() OVER (PARTITION BY rating_key ORDER BY first_, at_ DESC, result_id DESC) AS n FROM r)
    SELECT rating_key, result_id, mapped_mood FROM n WHERE n = 1""",
    "state_stats": """SELECT count(*) AS total_processed, count(mapped_mood) AS mapped, count(*) - count(mapped_mood) AS unmapped
    FROM processed_tracks""",
}
