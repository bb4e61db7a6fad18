"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _conversations() -> str:
    """A walk over each conversation's rows that keeps, for each state of the grammar, the cheapest edits so far and the rows they leave."""
    options: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}
    for p in range(4):

        def step(q: int, cost: str, edit: str, line: str, when: str, p: int = p) -> None:
            out = f"CASE WHEN f{p}.o = '' THEN {line} ELSE f{p}.o || chr(10) || {line} END" if line else f"f{p}.o"
            options[q].append(f"CASE WHEN f{p} IS NOT NULL AND {when} THEN {{'c': f{p}.c + {cost}, 'a': f{p}.a || '{edit}', 'o': {out}}} END")

        to, role = (3, "assistant") if p == 2 else (2, "user")
        step(p, "4", "D", "", "true")
        step(to, "cut + 3", "R", f"'{role}:' || text", "NOT must")
        step(to, "cut", "K", "role || ':' || text", f"NOT must AND left(role, 1) = '{role[0]}'")
        if p == 0:
            step(1, "cut", "K", "role || ':' || text", "NOT must AND left(role, 1) = 's'")
    least = {q: f"list_min([{', '.join(v)}])" for q, v in options.items()}

    def inserted(p: str, role: str) -> str:
        return f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + 3, 'a': {p}.a || 'I', 'o': CASE WHEN {p}.o = '' THEN '{role}:' ELSE {p}.o || chr(10) || '{role}:' END}} END"

    with_user = f"list_min([g2, {', '.join(inserted(p, 'user') for p in ('g0', 'g1', 'g3'))}])"
    start = "{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}"
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS h FROM k, tab),
d AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM h WHERE h > 0),
n AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
a AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM n),
r AS (SELECT *, last = '' AS blank, last <> '' AND again AS dup, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS short FROM a),
e AS (SELECT *, blank OR dup AS must, CASE WHEN short THEN 3 ELSE 0 END AS cut, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM r),
w AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, {start} AS g0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS g1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS g2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS g3 FROM k
      UNION ALL
      SELECT c, i, {least[0]}, {least[1]}, {least[2]}, {least[3]}
      FROM (SELECT e.*, g0 AS f0, g1 AS f1, f2, list_min([g3, {inserted('f2', 'assistant')}]) AS f3
            FROM (SELECT *, {with_user} AS f2 FROM w) AS w JOIN e ON e.c = w.c AND e.i = w.i + 1)),
z AS (SELECT c, list_min([g0, g3, {inserted('f2', 'assistant')}]) AS best FROM (SELECT *, {with_user} AS f2 FROM w) AS w WHERE i = (SELECT count(*) FROM e WHERE e.c = w.c)),
s AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (short) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM k) JOIN z USING (c) LEFT JOIN s USING (c)"""


ORACLES = {
    "op11_conversations": _conversations(),
    "op12_filters": f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, part, text, {SPACE_WORDS} AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
m AS (SELECT doc_id, part, list_concat(
        CASE WHEN len(w) < 100 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN ['B'] ELSE [] END,
        CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN ['C'] ELSE [] END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN ['D'] ELSE [] END, CASE WHEN coalesce(low < doc_id, false) THEN ['E'] ELSE [] END) AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS x, o[1 : step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, o, step, x,
             sum(n) FILTER (NOT list_has_any(fails, list_append(before, x))) AS kept, sum(n) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)) AS removed,
             sum(n) FILTER (list_contains(fails, x) AND list_has_any(fails, before)) AS redundant, sum(n) FILTER (fails = [x]) AS unique_fails,
             sum(good) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)) AS good_lost, sum(toxic) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)) AS toxic_lost
      FROM c, s GROUP BY part, o, step, x)
SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM g""",
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE "C") AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op6_substrings": f"""
WITH d AS (SELECT doc_id, {SPACE_WORDS} AS w FROM documents),
v AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
m AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS low FROM v) WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM m),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS kept, count(*) AS n_kept
      FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN c USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
