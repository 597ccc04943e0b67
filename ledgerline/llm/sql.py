"""DuckDB SQL for the queries that SQL can express, written from the contracts and the methods' texts."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

OP2 = f"""
WITH split AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
judged AS (
    SELECT *,
        CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
        regexp_matches(host, '(^|\\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$') AS listed
    FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""

OP3 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
sh AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def _draw(name: str) -> str:
    return f"-ln((('0x' || substr(md5(key || '|{name}'), 1, 12))::BIGINT + 1) / 281474976710656.0)"


def _least(level: str, names: list[str]) -> str:
    """The name with the least draw, all weights equal."""
    if len(names) == 1:
        return f"'{names[0]}'"
    pairs = ", ".join(f"{{'d': {_draw(f'{level}:{x}')}, 'x': '{x}'}}" for x in names)
    return f"list_sort([{pairs}])[1].x"


OP4 = f"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
    SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS hx FROM documents),
s AS (
    SELECT doc_id, key, strlen(text) + 1 AS size,
        xor(list_reduce(list_concat([4294967295], list_transform(hx, lambda x: ('0x' || x)::BIGINT)),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM d, crc),
region AS (
    -- eight shards: two regions of two racks of two shards; a ninth is a region of its own and draws against the others by weight
    SELECT *, {_least('region', ['g0', 'g1'])} AS region,
        list_sort([{{'d': {_draw('region:g0')} / 4, 'x': 'g0'}}, {{'d': {_draw('region:g1')} / 4, 'x': 'g1'}}, {{'d': {_draw('region:x8')}, 'x': 'x8'}}])[1].x AS grown_region
    FROM s),
rack AS (
    SELECT *, CASE region WHEN 'g0' THEN {_least('rack', ['k0', 'k1'])} ELSE {_least('rack', ['k2', 'k3'])} END AS rack,
        CASE grown_region WHEN 'g0' THEN {_least('rack', ['k0', 'k1'])} WHEN 'g1' THEN {_least('rack', ['k2', 'k3'])} END AS grown_rack
    FROM region),
leaf AS (
    SELECT *,
        CASE rack WHEN 'k0' THEN {_least('shard', ['0', '1'])} WHEN 'k1' THEN {_least('shard', ['2', '3'])}
                  WHEN 'k2' THEN {_least('shard', ['4', '5'])} ELSE {_least('shard', ['6', '7'])} END::INTEGER AS shard,
        CASE grown_rack WHEN 'k0' THEN {_least('shard', ['0', '1'])} WHEN 'k1' THEN {_least('shard', ['2', '3'])}
                  WHEN 'k2' THEN {_least('shard', ['4', '5'])} WHEN 'k3' THEN {_least('shard', ['6', '7'])} ELSE '8' END::INTEGER AS grown_shard
    FROM rack)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || '|block'), 1, 12))::BIGINT % 1024, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM leaf
"""

#: The common words of the quality rules.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf", "en": "the of and to in a is that for it as was",
    "es": "de la que el en y a los se del las un", "fr": "de la le et les des en un du une que est",
}


def _shares(counts: str) -> str:
    return f"list_transform({counts}, lambda x: x / list_sum({counts})::DOUBLE)"


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((z[1] + z[2]) / 2)) ELSE 0.0 END"
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({half('z[1]')} + {half('z[2]')}) / 2))))"


def _distances(source: str, reference: str) -> str:
    return f"""
    SELECT m.*, CASE WHEN n_chars >= 300 AND list_sum(r.chars) > 0 THEN {_js(_shares('m.chars'), _shares('r.chars'))} END AS dc,
           CASE WHEN n_words >= 100 AND m.common IS NOT NULL AND list_sum(r.common) > 0 THEN {_js(_shares('m.common'), _shares('r.common'))} END AS dw
    FROM {source} m LEFT JOIN {reference} r ON m.lang IS NOT DISTINCT FROM r.lang"""


def _reference(source: str) -> str:
    add = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    return f"SELECT lang, {add('chars', 6)} AS chars, {add('common', 13)} AS common FROM {source} GROUP BY lang"


def _common() -> str:
    cases = " ".join(
        f"WHEN '{lang}' THEN [" + ", ".join(f"len(list_filter(low, lambda w: w = '{x}'))" for x in listed.split()) + "]" for lang, listed in COMMON.items())
    return f"CASE lang {cases} END"


OP8 = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
counted AS (
    SELECT w.r, doc_id, lang, length(text) AS n_chars, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, md5(text) AS text_key, list_transform(ws, lambda x: lower(x)) AS low,
        [length(regexp_replace(text, '\\P{{Ll}}', '', 'g')), length(regexp_replace(text, '\\P{{Lu}}', '', 'g')), length(regexp_replace(text, '\\P{{Nd}}', '', 'g')),
         length(regexp_replace(text, '[^.,;:!?''()\\-]', '', 'g')), length(regexp_replace(text, '{WORD}', '', 'g'))] AS five
    FROM w LEFT JOIN cov USING (r)),
measured AS (
    SELECT * EXCLUDE (five, low), list_concat(five, [n_chars - list_sum(five)]) AS chars, list_concat(c, [n_words - list_sum(c)]) AS common,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM (SELECT *, {_common()} AS c FROM counted)),
votes AS (
    SELECT DISTINCT lang, text_key, CASE WHEN n_chars >= 300 THEN chars END AS chars, CASE WHEN n_words >= 100 THEN common END AS common FROM measured WHERE NOT base_failed),
shares AS (
    SELECT lang, i, round(chars[i + 1] * 2000 / list_sum(chars))::BIGINT AS step FROM votes, range(0, 6) AS t(i) WHERE chars IS NOT NULL
    UNION ALL SELECT lang, 6 + i, round(common[i + 1] * 2000 / list_sum(common))::BIGINT FROM votes, range(0, 13) AS t(i) WHERE common IS NOT NULL),
half AS (
    SELECT lang, i, step, sum(n) OVER (PARTITION BY lang, i ORDER BY step) AS run, sum(n) OVER (PARTITION BY lang, i) AS whole
    FROM (SELECT lang, i, step, count(*) AS n FROM shares GROUP BY ALL)),
medians AS (SELECT lang, i, min(step) AS m FROM half WHERE 2 * run >= whole GROUP BY ALL),
first_reference AS (
    SELECT lang, [{", ".join(f"coalesce(max(m) FILTER (i = {i}), 0)" for i in range(6))}] AS chars, [{", ".join(f"coalesce(max(m) FILTER (i = {i}), 0)" for i in range(6, 19))}] AS common
    FROM medians GROUP BY lang),
first_look AS ({_distances('measured', 'first_reference')}),
ordinary AS ({_reference("(SELECT * FROM first_look WHERE NOT base_failed AND coalesce(dc, 0) <= 0.25 AND coalesce(dw, 0) <= 0.25)")}),
reference AS (
    SELECT CASE WHEN o.chars IS NOT NULL THEN o.lang ELSE f.lang END AS lang, CASE WHEN list_max(o.chars) > 0 THEN o.chars ELSE coalesce(f.chars, o.chars) END AS chars,
           CASE WHEN list_max(o.common) > 0 THEN o.common ELSE coalesce(f.common, o.common) END AS common
    FROM ordinary o FULL JOIN first_reference f ON o.lang IS NOT DISTINCT FROM f.lang),
told AS ({_distances('measured', 'reference')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(dc <= 0.15 + 50.0 / n_chars, true) AND coalesce(dw <= 0.3, true) AS kept
FROM told
"""

OP9 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
d AS (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_concat([0.0], list_transform(list_zip(c.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d
QUALIFY rank <= 10
"""

OP10 = """
WITH turns AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
reply AS (SELECT pair_id, max(turn) AS turn, arg_max(text, turn) AS text FROM turns WHERE role = 'assistant' GROUP BY pair_id),
swap AS (SELECT a.pair_id, a.turn, b.text AS other FROM reply a LEFT JOIN reply b ON b.pair_id = xor(a.pair_id, 1)),
rejected AS (
    SELECT t.pair_id, t.turn, t.role, CASE WHEN t.role = 'assistant' AND t.turn = s.turn THEN s.other ELSE t.text END AS text
    FROM turns t LEFT JOIN swap s USING (pair_id) WHERE NOT coalesce(t.role = 'assistant' AND t.turn = s.turn AND s.other IS NULL, false)),
messages AS (
    SELECT pair_id, turn, role, text, bool_or(side = 'chosen') AS c, bool_or(side = 'rejected') AS r
    FROM (SELECT *, 'chosen' AS side FROM turns UNION ALL SELECT *, 'rejected' AS side FROM rejected) GROUP BY ALL),
parting AS (
    SELECT pair_id, min(turn) FILTER (WHERE NOT (c AND r)) AS differ, max(turn) FILTER (c) AS last_c, max(turn) FILTER (r) AS last_r FROM messages GROUP BY pair_id),
placed AS (
    SELECT m.*, coalesce(last_c >= differ AND last_r >= differ, false) AS complete, unnest(CASE WHEN differ IS NULL OR turn < differ THEN ['prompt'] WHEN c AND r THEN ['chosen', 'rejected'] WHEN c THEN ['chosen'] ELSE ['rejected'] END) AS part
    FROM messages m JOIN parting USING (pair_id)),
pieces AS (
    SELECT *, (row_number() OVER (PARTITION BY pair_id, part ORDER BY turn, role, text) - 1) // 256 AS chunk, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body FROM placed),
run AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, chunk ORDER BY turn, role, text) AS stop FROM pieces)
SELECT pair_id, part, chunk, count(*)::INTEGER AS n_turns, complete, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY turn, role, text) FILTER (WHERE part <> 'prompt' AND role = 'assistant'), '') AS loss_spans
FROM run GROUP BY pair_id, part, chunk, complete
"""


def _any_case(word: str) -> str:
    """Letters in either case, and no others that fold to them."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: (kind, pattern, group, least length of the group); the base kinds first.
SECRETS = (
    ("assign", "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"\']?\\x20*[:=]\\x20*[\"\']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ("private_key", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1), ("code_host", "gh[opsu]_[A-Za-z0-9]+", 0, 40), ("chat_bot", "xox[abprs]-[0-9A-Za-z-]+", 0, 15))


def _matches(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: a match starts after the gaps up to it and the matches before it."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT r, '{kind}' AS kind, {place} AS place, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start, length(whole[i]) AS size
    FROM (SELECT r, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {group}) AS judged, string_split_regex(text, '{p}') AS gaps FROM d) m, unnest(range(1, len(whole) + 1)) AS t(i)
    WHERE length(judged[i]) >= {least}"""


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_matches(i, *s) for i, s in enumerate(SECRETS))}),
told AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, place) FILTER (place < 3) AS base,
           string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, place) AS spans
    FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""

OP13 = f"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
    SELECT part, 16 * (len(ws) < 200)::INT + 8 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
               + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
               + 2 * regexp_matches(text, '[#$%&*|]')::INT + coalesce(doc_id > first_id, false)::INT AS code,
           count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM d JOIN firsts USING (text) LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 16), ('B', 8), ('C', 4), ('D', 2), ('E', 1)) AS v(x, b)),
orders AS (
    SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
    FROM letters l1, letters l2, letters l3, letters l4, letters l5 WHERE l1.b | l2.b | l3.b | l4.b | l5.b = 31),
steps AS (
    SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS t(step)),
sums AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (code & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (code & before = 0 AND code & bit > 0), 0) AS removed,
           coalesce(sum(n) FILTER (code & before > 0 AND code & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (code = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (code & before = 0 AND code & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (code & before = 0 AND code & bit > 0), 0) AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM sums
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": OP2, "op3_ngram_jaccard": OP3, "op4_sharding": OP4, "op8_quality_divergence": OP8, "op9_nearest_vectors": OP9, "op10_chat_preferences": OP10,
    "op11_secret_ledger": OP11, "op13_filter_audit": OP13,
}
