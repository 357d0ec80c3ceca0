"""DuckDB SQL that gives the rows of those opN_ queries that SQL can express."""

from __future__ import annotations

#: More rounds of sharing again than there are sources in the tables that the SQL is run on.
_ROUNDS = 24


def _mixing() -> str:
    rounds, last = [], "weighed"
    for k in range(_ROUNDS):
        rounds.append(
            f"""r{k} AS (SELECT source, i, s, w, CASE WHEN goal IS NOT NULL THEN goal
    WHEN (1.5 * sum(s) OVER () - coalesce(sum(goal) OVER (), 0)) * w / (sum(w) FILTER (WHERE goal IS NULL) OVER ()) >= 2 * s THEN 2.0 * s END AS goal FROM {last})"""
        )
        last = f"r{k}"
    return f"""WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
found AS (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source),
numbered AS (SELECT source, s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM found),
weighed AS (SELECT source, i, s::DOUBLE AS s, [3.0, 1.0, 2.0][(i % 3 + 1)::INT]::DOUBLE AS w, NULL::DOUBLE AS goal FROM numbered),
{", ".join(rounds)},
goals AS (SELECT source, i, s::BIGINT AS s, coalesce(goal, (1.5 * sum(s) OVER () - coalesce(sum(goal) OVER (), 0)) * w / (sum(w) FILTER (WHERE goal IS NULL) OVER ())) AS goal FROM {last}),
worded AS (SELECT *, least(2 * s, floor(goal + 0.5)::BIGINT) AS words FROM goals),
sized AS (SELECT greatest(1, least(65536, (sum(words) + 16383) // 16384))::BIGINT AS block, sum(words)::BIGINT AS every FROM worded),
ended AS (SELECT i, (sum(words) OVER (ORDER BY i) - words)::DOUBLE AS low, (sum(words) OVER (ORDER BY i))::DOUBLE AS high FROM worded),
points AS (SELECT x.slot, x.slot * 0.6180339887498949::DOUBLE AS p FROM sized, LATERAL (SELECT unnest(range((every + block - 1) // block)) AS slot) x),
dealt AS (SELECT slot, i, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS rank FROM points, sized, ended WHERE (p - floor(p)) * every >= low AND (p - floor(p)) * every < high),
got AS (SELECT i, count(*) AS n FROM dealt GROUP BY i),
shares AS (SELECT w.source, w.i, w.s, w.goal, w.words, coalesce(g.n, 0) AS n, block FROM worded w CROSS JOIN sized LEFT JOIN got g ON g.i = w.i),
takes AS (SELECT *, CASE WHEN n * block <= 2 * s AND abs(n * block - words) <= 0.005 * words THEN n * block ELSE words END AS take FROM shares),
late AS (SELECT i, x.rank, row_number() OVER (ORDER BY x.rank - n, i) - 1 AS place FROM takes, LATERAL (SELECT unnest(range(n, (take + block - 1) // block)) AS rank) x),
schedule AS (SELECT slot, i, rank FROM dealt UNION ALL SELECT (every + block - 1) // block + place, i, rank FROM late, sized),
placed AS (SELECT d.doc_id, d.size, t.i, t.s, t.goal, t.take, t.block,
    (sum(d.size) OVER (PARTITION BY t.i ORDER BY md5('7:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS begin
    FROM docs d JOIN takes t ON t.source IS NOT DISTINCT FROM d.source)
SELECT p.doc_id, p.size, p.s AS source_size, p.goal AS target,
    (greatest(0, least(p.begin + p.size, p.take) - p.begin) + greatest(0, least(p.begin + p.s + p.size, p.take) - p.begin - p.s))::BIGINT AS taken,
    h.slot::BIGINT AS first_slot
FROM placed p LEFT JOIN schedule h ON h.i = p.i AND h.rank = p.begin // p.block AND p.size > 0 AND p.begin < p.take"""


_EMBEDDINGS = """WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT linked.b, reached.c FROM reached JOIN linked ON linked.a = reached.vec_id),
least AS (SELECT vec_id, min(c) AS component_id FROM reached GROUP BY vec_id),
counted AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted ON a = e.vec_id"""

_EQUAL_TEXTS = """SELECT doc_id, max(doc_id) OVER equal AS keep_id, count(*) OVER equal AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW equal AS (PARTITION BY coalesce(text, ''))"""


def _repair() -> str:
    """The same programme forwards: each state keeps its least (cost, edits, text so far), a row of a conversation at a time."""
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, crcs[((xor(c, b)) & 255) + 1])), 4294967295)"
    put = lambda state, role: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 5, 'a': {state}.a || 'I', 'o': {state}.o || '{role}:' || chr(10)}} END"
    drop = lambda state: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2, 'a': {state}.a || 'D', 'o': {state}.o}} END"
    keep = lambda state, i: f"CASE WHEN {state} IS NOT NULL AND NOT must AND initial = '{i}' THEN {{'c': {state}.c + late, 'a': {state}.a || 'K', 'o': {state}.o || role || ':' || text || chr(10)}} END"
    name = lambda state, role: f"CASE WHEN {state} IS NOT NULL AND NOT must THEN {{'c': {state}.c + late + 1, 'a': {state}.a || 'R', 'o': {state}.o || '{role}:' || text || chr(10)}} END"
    least = lambda *of: f"list_min([{', '.join(of)}])"
    return f"""WITH RECURSIVE crc AS (SELECT {table} AS crcs),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS code FROM conversations, crc),
harmed AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS copies FROM coded),
said AS (SELECT h.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i
    FROM (SELECT conv_id, turn, role, text, unnest(range(copies)) AS copy FROM harmed) h),
marked AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM said),
judged AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM marked),
steps AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s,
    NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS a FROM conversations
UNION ALL SELECT conv_id, i + 1, {drop("n")}, {least(drop("s"), keep("n", "s"))},
    {least(drop("u"), *[f("{0}".format(x), v) for x in ("n", "s", "a") for f, v in ((keep, "u"), (name, "user"))])}, {least(drop("a"), keep("u", "a"), name("u", "assistant"))}
    FROM (SELECT p.conv_id, p.i, j.must, j.late, j.initial, j.role, j.text, p.n, p.s, {least("p.u", put("p.n", "user"), put("p.s", "user"), put("p.a", "user"))} AS u,
        {least("p.a", put("p.u", "assistant"))} AS a FROM steps p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i)),
ended AS (SELECT conv_id, {least("n", "a", put("u", "assistant"))} AS best FROM steps QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    best.c AS cost, best.a AS audit, sha256(left(best.o, greatest(length(best.o) - 1, 0)::BIGINT)) AS repaired_sha256
FROM ended e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""


_TERMS = r"""[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"""
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RANKED = f"""WITH found AS (SELECT doc_id, regexp_extract_all({_SMALL}, '{_TERMS}') AS terms, row_number() OVER () AS r FROM documents),
sized AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM found WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS every FROM sized),
counted AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, docs),
asked AS (SELECT q, item_id, unnest(list_distinct(regexp_extract_all({_SMALL}, '{_TERMS}'))) AS term FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
scored AS (SELECT q, item_id, s.r, s.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // every))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weighed USING (term) JOIN sized s ON s.r = counted.r, whole GROUP BY q, item_id, s.r, s.doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""

SQL: dict[str, str] = {"op1_embedding_near_dedup": _EMBEDDINGS, "op7_source_mixing": _mixing(), "op11_exact_dedup": _EQUAL_TEXTS, "op12_conversation_repair": _repair(), "op13_ranked_search": _RANKED}
