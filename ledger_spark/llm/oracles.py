"""DuckDB SQL for the queries of this subpackage that SQL can express."""

# The fixed values of the chat template, as in chat.Template.
_CONTROL = ["</s>", "<<SYS>>", "<</SYS>>", "<s>", "[/INST]", "[/ROLE]", "[/TURN]", "[INST]", "[ROLE]"]


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in _CONTROL:
        out = f"replace({out}, '{mark}', '\\{mark}')"
    return out


DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
g AS (
  SELECT item, least(len(w), 10) AS k,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS gram
  FROM b WHERE len(w) > 0),
dw AS (
  SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS s,
         unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
hits AS (SELECT dw.rid, dw.s, dw.k, g.item FROM dw JOIN g ON dw.gram = g.gram AND dw.k = g.k),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, c.key IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY rid
"""

TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

MIX = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE)
           / 281474976710656::DOUBLE AS u
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w,
             source_size * 2::DOUBLE AS cap FROM p),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, max(level) OVER () * w) AS target FROM l),
v AS (SELECT source, CAST(length(bin(size)) AS DOUBLE) AS weight, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
q AS (SELECT v.source, v.weight, t.source_size, t.target,
             CASE WHEN sum(weight * words) OVER (h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0
                  THEN (target - coalesce(sum(words) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2::DOUBLE)
                       / sum(weight * words) OVER (h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS factor
      FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source
      WINDOW h AS (PARTITION BY v.source ORDER BY weight DESC)),
y AS (SELECT *, greatest(0, least(2::DOUBLE, coalesce(max(factor) OVER (PARTITION BY source), 0) * weight)) AS x FROM q),
e AS (SELECT d.*, y.source_size, y.target, y.x
      FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source AND CAST(length(bin(d.size)) AS DOUBLE) = y.weight),
o AS (SELECT *, CAST(floor(x) AS BIGINT) AS copies,
             CASE WHEN x - floor(x) > 0 AND size > 0 THEN (u / (1 - u)) / ((x - floor(x)) / (1 - (x - floor(x)))) END AS odds FROM e),
b AS (SELECT source, CAST(floor(max(target) + 0.5::DOUBLE) AS BIGINT) - CAST(sum(copies * size) AS BIGINT) AS budget FROM o GROUP BY source),
r AS (SELECT o.*, b.budget, CASE WHEN odds IS NOT NULL THEN
             sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY o.source ORDER BY odds NULLS LAST, doc_id, rid ROWS UNBOUNDED PRECEDING) END AS run
      FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source),
g AS (SELECT source AS gs, max(budget) - coalesce(sum(size) FILTER (WHERE run <= budget), 0) AS gap FROM r GROUP BY source),
c AS (SELECT source AS cs, arg_min(rid, (abs(gap - size), odds, doc_id, rid)) AS pick
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.gs WHERE run > budget AND abs(gap - size) < gap GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST((copies + CASE WHEN odds IS NULL THEN 0 WHEN run <= budget OR rid = pick THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.cs
"""

CHAT = f"""
WITH x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
y AS (
  SELECT *, length({_escaped('text')}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                                          ELSE 21 + length({_escaped('role')}) END AS chars
  FROM x)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM y GROUP BY conv_id
"""

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT rid, doc_id, unnest(range(1, len(w) - 18)) AS s,
             unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS gram
      FROM d WHERE len(w) >= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id NULLS FIRST, rid, s) AS nth FROM x),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS p FROM f WHERE nth > 1),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.rid, string_agg(word, ' ' ORDER BY words.p) AS text
         FROM words ANTI JOIN gone ON words.rid = gone.rid AND words.p = gone.p GROUP BY words.rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)
"""


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text (DuckDB has no such function): the usual polynomial, bit by bit."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


_MERKLE_LEVELS = 8  # of eight nodes a run: enough for 16 million documents of a language


def _merkle_tree(nodes: str, prefix: str) -> str:
    """CTEs prefix0 .. prefixN (tree, pos, hash, n, left, right) from (tree, pos, hash); a finished tree stays as it is."""
    out = [f"{prefix}0 AS (SELECT tree, pos, hash, count(*) OVER (PARTITION BY tree) AS n FROM {nodes})"]
    for level in range(_MERKLE_LEVELS):
        out.append(f"""{prefix}s{level} AS (
  SELECT tree, pos, n, hash,
         coalesce(string_agg(hash, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(hash, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {prefix}{level})""")
        out.append(f"""{prefix}{level + 1} AS (
  SELECT tree, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY pos)) END AS hash,
         CASE WHEN any_value(n) = 1 THEN 1 ELSE (any_value(n) + 7) // 8 END AS n
  FROM {prefix}{level} GROUP BY tree, pos // 8)""")
    return ",\n".join(out)


def _merkle_fold(source: str, prefix: str, out: str) -> str:
    """CTEs that take (rid, tree, pos, own, proof) up a tree: own is folded, proof gets the siblings."""
    steps = []
    for level in range(_MERKLE_LEVELS):
        at = source if level == 0 else f"{out}{level - 1}"
        steps.append(f"""{out}{level} AS (
  SELECT f.rid, f.tree, f.pos // 8 AS pos, CASE WHEN s.n = 1 THEN f.own ELSE sha256(s.before || f.own || s.after) END AS own,
         CASE WHEN s.n = 1 THEN f.proof ELSE f.proof || s.before || s.after END AS proof
  FROM {at} f JOIN {prefix}s{level} s ON f.tree = s.tree AND f.pos = s.pos)""")
    return ",\n".join(steps)


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LAST = _MERKLE_LEVELS - 1
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(_LOWERED)} END AS tampered
  FROM documents),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM d),
leaves AS (SELECT tree, pos, leaf AS hash FROM l),
{_merkle_tree('leaves', 'a')},
tops AS (SELECT 0 AS tree, tree AS pos, hash FROM a{_MERKLE_LEVELS}),
{_merkle_tree('tops', 'b')},
f AS (SELECT rid, tree, pos, coalesce(tampered, leaf) AS own, '' AS proof FROM l),
{_merkle_fold('f', 'a', 'g')},
h AS (SELECT rid, 0 AS tree, tree AS pos, own, proof FROM g{_LAST}),
{_merkle_fold('h', 'b', 'k')}
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(k.proof) AS proof_sha256, k.own AS folded_root,
       k.own = r.hash AS verified
FROM l JOIN k{_LAST} k USING (rid) JOIN a{_MERKLE_LEVELS} s ON l.tree = s.tree CROSS JOIN b{_MERKLE_LEVELS} r
"""


def _state(cost: str, audit: str, text: str) -> str:
    return f"{{'c': CAST({cost} AS BIGINT), 'a': {audit}, 'r': {text}}}"


def _moved(state: str, cost: str, letters: str, *lines: str) -> str:
    text = f"{state}.r"
    for line in lines:
        text = f"({text} || CASE WHEN {text} = '' THEN '' ELSE chr(10) END || {line})"
    return _state(f"{state}.c + {cost}", f"{state}.a || '{letters}'", text)


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


_NEVER = _state("1000000000", "''", "''")
_CLOSED = f"""SELECT cid, i, s0 AS t0, s1 AS t1,
  {_least('s2', *[_moved(s, '5', 'I', "'user:'") for s in ('s0', 's1', 's3')])} AS t2,
  {_least('s3', _moved('s2', '5', 'I', "'assistant:'"), *[_moved(s, '10', 'II', "'user:'", "'assistant:'") for s in ('s0', 's1')])} AS t3"""


def _stay(state: str, initial: str, role: str) -> str:
    """Keep (if the initial fits) or re-role the row after a state; never where the row must go."""
    keep = f"CASE WHEN x.initial = '{initial}' AND NOT x.gone THEN {_moved(state, '(CASE WHEN x.cut THEN 5 ELSE 0 END)', 'K', 'x.line')} ELSE {_NEVER} END"
    change = f"CASE WHEN NOT x.gone THEN {_moved(state, '(CASE WHEN x.cut THEN 6 ELSE 1 END)', 'R', f'{role} || x.text')} ELSE {_NEVER} END"
    return f"{keep}, {change}"


_USER = "'user:'"
_ASSISTANT = "'assistant:'"
REPAIR = rf"""
WITH RECURSIVE o AS (
  SELECT row_number() OVER () AS rid, conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, turn,
         coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations),
m AS (
  SELECT rid, cid, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o WHERE fault <> 0),
q AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, rid, copy) - 1 AS i FROM m),
f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut_off,
         lag(role) OVER (PARTITION BY cid ORDER BY i) AS prior
  FROM q),
x AS (
  SELECT *, role || ':' || text AS line, substr(role, 1, 1) AS initial, blank OR again AS gone, NOT blank AND NOT again AND cut_off AS cut
  FROM f),
c AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
         count(*) FILTER (WHERE prior IS NOT NULL AND substr(prior, 1, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM x GROUP BY cid),
p(cid, i, s0, s1, s2, s3) AS (
  SELECT cid, CAST(0 AS BIGINT), {_state('0', "''", "''")}, {_NEVER}, {_NEVER}, {_NEVER} FROM c
  UNION ALL
  SELECT t.cid, t.i + 1, {_moved('t0', '2', 'D')},
    {_least(_moved('t1', '2', 'D'), f"CASE WHEN x.initial = 's' AND NOT x.gone THEN {_moved('t0', '(CASE WHEN x.cut THEN 5 ELSE 0 END)', 'K', 'x.line')} ELSE {_NEVER} END")},
    {_least(_moved('t2', '2', 'D'), *[_stay(s, 'u', _USER) for s in ('t0', 't1', 't3')])},
    {_least(_moved('t3', '2', 'D'), _stay('t2', 'a', _ASSISTANT))}
  FROM ({_CLOSED} FROM p) t JOIN x ON x.cid = t.cid AND x.i = t.i),
e AS (
  SELECT cid, {_least('t0', 't3')} AS best FROM ({_CLOSED} FROM p JOIN c USING (cid) WHERE p.i = c.n))
SELECT DISTINCT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost,
       coalesce(e.best.a, '') AS audit, sha256(coalesce(e.best.r, '')) AS repaired_sha256
FROM o LEFT JOIN c USING (cid) LEFT JOIN e USING (cid)
"""
