"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import CLASSES, CONTAINMENT, TEMPLATES, window_step, window_words
from .minhash_dedup import SIMILARITY
from .mixing import WEIGHTS
from .sharding import ADDRESS_BITS, SHARD_BYTES
from .spelling import CHECKSUM_STEP, FORM_RATIO, MIN_CHARS, MIN_COUNT
from .topk_search import QUERY_STEP, SCALE, TOP

# A-Z only: DuckDB's lower() would change other letters too
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op1_extendible_shards"] = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'null')), 1, {ADDRESS_BITS // 4}))::BIGINT AS addr
  FROM documents),
b AS (
  SELECT 0 AS depth, 0::BIGINT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, list({{'a': addr, 's': n_bytes}}) AS held
  FROM r WHERE n_bytes <= {SHARD_BYTES}
  UNION ALL
  SELECT depth, prefix, sum(h.s)::BIGINT, list(h) FROM (
    SELECT b.depth + 1 AS depth, u.h.a >> ({ADDRESS_BITS} - b.depth - 1) AS prefix, u.h AS h
    FROM b, unnest(b.held) AS u(h)
    WHERE b.shard_bytes > {SHARD_BYTES} AND b.depth < {ADDRESS_BITS})
  GROUP BY depth, prefix)
SELECT r.doc_id, r.n_bytes, b.depth,
       CASE WHEN b.depth > 0 THEN lpad(ltrim(bin(b.prefix), '0'), b.depth, '0') ELSE '' END AS prefix,
       0::BIGINT AS page, b.shard_bytes
FROM r JOIN b ON b.shard_bytes <= {SHARD_BYTES} AND r.addr >> ({ADDRESS_BITS} - b.depth) = b.prefix
WHERE r.n_bytes <= {SHARD_BYTES}
UNION ALL
SELECT doc_id, n_bytes, -1, '', doc_id, n_bytes FROM r WHERE n_bytes > {SHARD_BYTES}
"""

ORACLES["op4_golden_mix"] = f"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k
  FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(k % {len(WEIGHTS)} + 1)::INT] AS weight,
             sum(source_size) OVER () * 3 / 2 AS budget FROM s),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS full_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
  FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * (budget - full_words)::DOUBLE / weight_left > 2 * source_size AS is_full FROM c),
l AS (SELECT budget - coalesce(sum(2 * source_size) FILTER (is_full), 0) AS words_left,
             sum(weight) FILTER (NOT is_full) AS weight_left
      FROM f GROUP BY budget),
t AS (SELECT source, source_size,
             CASE WHEN is_full THEN (2 * source_size)::DOUBLE
                  ELSE weight * l.words_left::DOUBLE / l.weight_left END AS target FROM f, l),
e AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, g.epoch,
         g.epoch * t.source_size + coalesce(sum(size) OVER (PARTITION BY t.source, g.epoch
            ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null') || '|' || g.epoch::VARCHAR), d.doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS epoch) AS g)
SELECT doc_id, size, source_size, target,
       sum(greatest(0, least(size, round(target)::BIGINT - start)))::BIGINT AS taken
FROM e GROUP BY doc_id, size, source_size, target
"""

ORACLES["op7_quotient_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""

ORACLES["op2_norm_bucket_search"] = f"""
WITH v AS (
  SELECT DISTINCT vec_id, [floor(x::DOUBLE * {SCALE}) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""

ORACLES["op5_bbit_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS sh
  FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= {SIMILARITY} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.r),
m AS (SELECT doc_id, min(r) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""


def _licenses() -> str:
    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    length = " ".join(f"WHEN len(w) <= {c} THEN {c}" for c in CLASSES)
    by_class = lambda f: "CASE length " + " ".join(f"WHEN {c} THEN {f(c)}" for c in CLASSES) + " END"
    cut = "[x FOR x IN string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' ') IF x <> '']"
    grams = "unnest(range(1, len(w) - 3)) AS g(i)"
    return f"""
WITH t0 AS (SELECT template, license, {cut} AS w FROM (VALUES {rows}) AS v(template, license, text)),
t1 AS (SELECT *, CASE {length} END AS length FROM t0),
t AS (SELECT DISTINCT template, license, {by_class(window_step)} AS step, {by_class(window_words)} - 4 AS whole,
             array_to_string(w[i:i + 4], ' ') AS sh FROM t1, {grams}),
m AS (SELECT template, count(*)::INTEGER AS template_shingles FROM t GROUP BY template),
d AS (SELECT doc_id, {cut} AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS sh FROM d, {grams} WHERE len(w) >= 5),
h AS (SELECT doc_id, template, license, step, k, sh
      FROM (SELECT s.doc_id, s.i, t.* FROM s JOIN t ON s.sh = t.sh) AS x,
           unnest(range(greatest(0, ceil((x.i - x.whole + 1) / x.step)::BIGINT), x.i // x.step + 1)) AS u(k)),
c AS (SELECT doc_id, template, license, (k * step)::INTEGER AS first_word, count(DISTINCT sh)::INTEGER AS shared
      FROM h GROUP BY doc_id, template, license, k, step),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY shared DESC, first_word) AS r
      FROM c JOIN m USING (template) WHERE shared * 100 >= template_shingles * {CONTAINMENT})
SELECT doc_id, license, template, shared, template_shingles, first_word FROM b WHERE r = 1
"""


ORACLES["op10_license_scan"] = _licenses()

# crc32 of a text: a table of 256 remainders, then one step for each byte
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i))"""


def _crc32(text: str) -> str:
    """The checksum of a text, in a query that reads ``crc_table`` as ``ct``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda c, b: xor(c >> 8, ct.t[xor(c & 255, b) + 1])))")


ORACLES["op12_trie_pair_spelling"] = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
checked AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, 'null') || ':' || run")} AS h FROM own, crc_table AS ct),
kept AS (
  SELECT CASE WHEN h % {CHECKSUM_STEP} = 0
              THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM checked),
w AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS (
  SELECT DISTINCT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM w, unnest(range(0, length(word))) AS p(i)),
near AS (
  SELECT DISTINCT x.word, y.word AS other, y.n AS other_n
  FROM cut AS x JOIN cut AS y ON x.a = y.a AND x.b = y.b AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION
  SELECT x.word, w.word, w.n FROM cut AS x JOIN w ON w.word = x.a || x.b
  UNION
  SELECT w.word, x.word, x.n FROM cut AS x JOIN w ON w.word = x.a || x.b),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, max(other_n) AS top_n,
         list(other ORDER BY other_n DESC, encode(other))[1] AS top FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN top_n >= {FORM_RATIO} * w.n THEN top END AS form, CASE WHEN top_n >= {FORM_RATIO} * w.n THEN top_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at, form AS up FROM f
  UNION ALL
  SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.up)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.up IS NULL
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


ORACLES["op13_path_copy_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS changed,
         {_crc32("doc_id::VARCHAR")} % 7 = 0 AS tampered
  FROM documents, crc_table AS ct),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS n FROM d),
low AS (
  SELECT tree, 0 AS level, pos, n, leaf AS node FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM low
  WHERE n > 1 GROUP BY tree, level, n, pos // 2),
s AS (SELECT tree, level AS height, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
      FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM high
  WHERE n > 1 GROUP BY level, n, pos // 2),
-- all nodes of both kinds, with the level above the leaf at which a row meets them
nodes AS (
  SELECT tree, level, pos, node FROM low WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + high.level, high.pos, high.node FROM s, high),
steps AS (
  SELECT p.tree, p.pos AS row_pos, g.level,
         CASE WHEN g.level < s.height THEN p.pos >> g.level ELSE s.pos >> (g.level - s.height) END AS place,
         s.height + (SELECT max(level) FROM high) AS total
  FROM p JOIN s ON s.tree = p.tree, LATERAL (SELECT unnest(range(0, s.height + (SELECT max(level) FROM high))) AS level) AS g),
proofs AS (
  SELECT steps.tree, row_pos, list({{'l': CASE WHEN place % 2 = 1 THEN coalesce(node, '') ELSE '' END,
                                     'r': CASE WHEN place % 2 = 0 THEN coalesce(node, '') ELSE '' END}} ORDER BY steps.level) AS proof
  FROM steps LEFT JOIN nodes ON nodes.tree = steps.tree AND nodes.level = steps.level AND nodes.pos = xor(steps.place, 1)
  GROUP BY steps.tree, row_pos),
folds AS (
  SELECT p.tree, p.pos, coalesce(proof, []) AS proof, 0 AS level, CASE WHEN tampered THEN changed ELSE leaf END AS h
  FROM p LEFT JOIN proofs ON proofs.tree = p.tree AND proofs.row_pos = p.pos
  UNION ALL
  SELECT tree, pos, proof, level + 1, sha256(proof[level + 1].l || h || proof[level + 1].r) FROM folds WHERE level < len(proof)),
top AS (SELECT node AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root,
       sha256(coalesce(array_to_string(list_transform(proof, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
       h AS folded_root, h = root AS verified
FROM p JOIN s ON s.tree = p.tree JOIN folds ON folds.tree = p.tree AND folds.pos = p.pos AND folds.level = len(folds.proof), top
"""
