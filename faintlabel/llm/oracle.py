"""SQL for the corpus queries that SQL can express; the fits, tokenizers and tree cuts are held against brute force in the tests."""

from __future__ import annotations

from faintlabel.llm import secret_scan
from faintlabel.llm.license_scan import KEYWORDS, RULES, SENTENCES

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _top_k() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _warc() -> str:
    def digit(group: int, place: int) -> str:
        value = f"('0x' || substr(h, {5 * group + 1}, 5))::INTEGER"
        return f"substr('{BASE32}', (({value} >> {15 - 5 * place}) & 31) + 1, 1)"

    digest = " || ".join(digit(g, p) for g in range(8) for p in range(4))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {digest} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, 'ok' AS status FROM d"""


def _licenses() -> str:
    known = "MAP {" + ", ".join(f"{_quoted(words)}: {_quoted(name)}" for name, words in SENTENCES.items()) + "}"
    steps = ["""
WITH k AS (SELECT {known} AS m),
s AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\n|[.!?;:][ \\t\\r\\n]'), lambda x: regexp_matches(lower(x), {words})) AS parts FROM documents),
i AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: m[trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids FROM s, k),
r0 AS (SELECT doc_id, array_to_string(ids, ',') AS sentences, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(ids, ',,') || ',' ELSE '' END AS rest, []::VARCHAR[] AS hits FROM i)""".replace("{known}", known).replace("{words}", _quoted(KEYWORDS))]  # fmt: skip
    for n, (name, sequence) in enumerate(RULES):
        wanted = _quoted("," + ",,".join(sequence) + ",")
        hit = f"CASE WHEN contains(rest, {wanted}) AND NOT list_contains(hits, {_quoted(name)}) THEN list_append(hits, {_quoted(name)}) ELSE hits END"
        steps.append(f"r{n + 1} AS (SELECT doc_id, sentences, replace(rest, {wanted}, '|') AS rest, {hit} AS hits FROM r{n})")
    return ",\n".join(steps) + f"""
SELECT doc_id, sentences, array_to_string(hits, ',') AS licenses, len(list_filter(regexp_split_to_array(rest, '[,|]+'), lambda x: x <> ''))::BIGINT AS unmatched FROM r{len(RULES)}"""


def _quotes() -> str:
    return r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
base AS (SELECT conv_id, turn, min(text) AS text FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
own AS (SELECT conv_id, turn, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS words FROM m),
wrote AS (SELECT conv_id, words, min(turn) AS origin FROM own WHERE words <> '' GROUP BY ALL),
cited AS (SELECT conv_id, turn + 1 AS turn, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS words FROM base),
parent AS (SELECT c.conv_id, c.turn, max(w.origin) AS reply_to FROM cited c JOIN wrote w USING (conv_id, words) WHERE w.origin < c.turn GROUP BY ALL),
tree AS (SELECT b.conv_id, b.turn, p.reply_to FROM base b LEFT JOIN parent p USING (conv_id, turn)),
walk AS (SELECT conv_id, turn, reply_to, turn AS root, 0::BIGINT AS depth FROM tree WHERE reply_to IS NULL
         UNION ALL SELECT t.conv_id, t.turn, t.reply_to, w.root, w.depth + 1 FROM tree t JOIN walk w ON t.conv_id = w.conv_id AND t.reply_to = w.turn)
SELECT m.conv_id, m.turn, m.role, w.reply_to, w.root, w.depth,
       regexp_replace(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: NOT starts_with(x, '>')), chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text
FROM m LEFT JOIN walk w ON m.conv_id = w.conv_id AND m.turn = w.turn"""


def _spelling() -> str:
    """CRC-32 byte by byte from its table; words as ASCII, so that an edit of a letter is one of a byte."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    accented = "".join(map(chr, range(0xC0, 0x100)))
    single = "".join(c for c in map(chr, range(33, 127)) if c not in lower)[:64]
    pair = f"levenshtein(translate(a.word, {_quoted(accented)}, {_quoted(single)}), translate(b.word, {_quoted(accented)}, {_quoted(single)})) = 1"
    return f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, j:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') AS run FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
raw AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM each),
marked AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b:
          xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM raw, crc),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM marked),
v AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1
         AND (left(a.word, length(a.word) // 2 - 1) = left(b.word, length(a.word) // 2 - 1)
              OR right(a.word, length(a.word) // 2 - 1) = right(b.word, length(a.word) // 2 - 1)) AND {pair}),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near),
told AS (SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= 5 * v.n THEN b.other END AS form,
                CASE WHEN b.other_n >= 5 * v.n THEN b.other_n END AS form_n FROM v LEFT JOIN best b ON v.word = b.word AND b.place = 1),
walk AS (SELECT word, word AS at FROM told UNION ALL SELECT w.word, t.form FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NOT NULL)
SELECT told.word, told.form, w.at AS root, told.n, told.n_near, told.form_n
FROM told JOIN walk w USING (word) JOIN told last ON last.word = w.at WHERE last.form IS NULL"""


def _secrets() -> str:
    """Places from the lengths of what lies between the matches."""
    steps, names = [], []
    for place, rule in enumerate(secret_scan.RULES):
        pattern = _quoted(rule.pattern)
        measured = f"length(regexp_extract(unnest(m), {pattern}, {rule.group}))" if rule.group else "length(unnest(m))"
        steps.append(f"""
k{place} AS (SELECT doc_id, regexp_split_to_array(text, {pattern}) AS g, regexp_extract_all(text, {pattern}) AS m FROM d WHERE regexp_matches(text, {pattern})),
l{place} AS (SELECT doc_id, unnest(g[:len(m)]) AS gap, unnest(m) AS hit, unnest(range(len(m))) AS i, {measured} AS size FROM k{place}),
s{place} AS (SELECT doc_id, {place} AS place, '{rule.name}' AS kind, size, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop, length(hit) AS width FROM l{place})""")
        names.append(f"SELECT doc_id, place, kind, stop - width AS start, stop FROM s{place} WHERE size >= {rule.least}")
    base = ", ".join(_quoted(r.name) for r in secret_scan.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in secret_scan.BASE_RULES)
    told = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{",".join(steps)},
spans AS ({" UNION ALL ".join(names)}),
found AS (SELECT doc_id, {counts}, coalesce(string_agg({told}, ',' ORDER BY start, place) FILTER (kind IN ({base})), '') AS base, string_agg({told}, ',' ORDER BY start, place) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found f ON d.doc_id = f.doc_id"""


ORACLE: dict[str, str] = {
    "op3_cover_tree": _top_k(),
    "op6_warc": _warc(),
    "op7_license_scan": _licenses(),
    "op9_quotes": _quotes(),
    "op11_spelling": _spelling(),
    "op12_secret_scan": _secrets(),
}
