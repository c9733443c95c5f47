"""SQL counterparts of the registered text queries, in DuckDB's dialect."""

from __future__ import annotations

from ionweave.llm.common import LOWER, UPPER
from ionweave.llm.license_scan import BLOCK_STEP, BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD, longest_template
from ionweave.llm.mixing import DRAW_RATE
from ionweave.llm.spelling import DELETE_EVERY, FORM_RATIO, LEAST_COUNT, LEAST_LETTERS
from ionweave.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)"""

ORACLE["op10_line_dedup"] = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
     keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
     shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
     marked AS (SELECT keyed.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLE["op3_mixing"] = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
     total AS (SELECT sum(chars) AS c, sum(pow(chars, 0.5)) AS w FROM sizes),
     rates AS (SELECT source, CASE WHEN chars > 0 THEN round(pow(chars, 0.5) / w * c / chars, 9) ELSE 0.0::DOUBLE END AS rate FROM sizes, total),
     means AS (SELECT source, greatest(1, ceil(rate / {DRAW_RATE}::DOUBLE))::BIGINT AS draws, rate / greatest(1, ceil(rate / {DRAW_RATE}::DOUBLE)) AS mean FROM rates),
     steps AS (SELECT source, draws, mean, unnest(range(0, cast(ceil(mean + 12 * sqrt(mean) + 30) AS BIGINT) + 1)) AS k FROM means),
     cdf AS (SELECT source, draws, sum(CASE WHEN mean > 0 THEN exp(k * ln(mean) - mean - lgamma(k + 1)) ELSE (k = 0)::DOUBLE END)
               OVER (PARTITION BY source ORDER BY k) AS p FROM steps),
     tables AS (SELECT source, draws, list(p) AS cdf FROM cdf GROUP BY source, draws),
     draw AS (SELECT d.*, cdf, unnest(range(1, draws + 1)) AS k FROM (SELECT row_number() OVER () AS row, * FROM documents) d
              JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
     hashed AS (SELECT *, md5('17|' || coalesce(doc_id::VARCHAR, '') || CASE WHEN k > 1 THEN '|' || k ELSE '' END) AS h FROM draw),
     drawn AS (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda c: c <= ('0x' || substr(h, 1, 13))::BIGINT::DOUBLE / pow(16, 13)))) AS n
               FROM hashed GROUP BY row, doc_id, text, lang, source, n_chars)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n::BIGINT + 1))::INTEGER AS copy FROM drawn"""


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACES = ", ".join(
    f"list_transform(list_filter(range(len(words)), lambda i: words[i + 1:i + {len(p.split())}] = {_list(p)}), lambda i: {{'at': i, 'label': '{label}'}})"
    for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', {_list(' '.join(dict.fromkeys(t.split())))}, {_list(marks)})" for label, t, marks in TEMPLATES)
_RUN_WORDS = BLOCK_STEP + max(BLOCK_STEP, longest_template())

ORACLE["op1_license_scan"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
     w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS words FROM d),
     base AS (SELECT doc_id, len(words) AS n_words, flatten([{_PLACES}]) AS places FROM w),
     lines AS (SELECT doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '{_WORD}') AS words FROM w),
     wrapped AS (SELECT doc_id, words FROM w WHERE len(words) > len(regexp_extract_all(string_split(t, chr(10))[-1], '{_WORD}'))),
     starts AS (SELECT doc_id, words, {BLOCK_WORDS} AS size, unnest(CASE WHEN len(words) > {BLOCK_WORDS}
                  THEN range(0, greatest(1, len(words) - {BLOCK_STEP}), {BLOCK_STEP}) ELSE [0] END) AS s FROM lines
                UNION ALL SELECT doc_id, words, {_RUN_WORDS}, unnest(range(0, greatest(1, len(words) - {_RUN_WORDS} + {BLOCK_STEP}), {BLOCK_STEP})) FROM wrapped),
     blocks AS (SELECT doc_id, row_number() OVER () AS block, list_distinct(words[s + 1:s + size]) AS tokens FROM starts),
     templates(label, tokens, marks) AS (VALUES {_TEMPLATES}),
     hits AS (SELECT doc_id, block, label, list_intersect(b.tokens, t.tokens) AS own, len(t.tokens) AS size, marks FROM blocks b, templates t),
     kept AS MATERIALIZED (SELECT * FROM hits WHERE len(own)::DOUBLE / size >= {THRESHOLD} - 1e-9 AND list_has_all(own, marks)),
     best AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.block = k.block AND o.label <> k.label AND len(o.own) > len(k.own) AND list_has_all(o.own, k.own))),
     found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(len(own)::DOUBLE / size) AS score FROM best GROUP BY doc_id)
SELECT doc_id, n_words, len(places) AS n_base, list_min(list_transform(places, lambda p: p.at)) AS first_word,
       list_max(list_transform(places, lambda p: p.at)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: p.label), coalesce(labels, [])))), ',') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM base LEFT JOIN found USING (doc_id)"""


def _codes_sql() -> str:
    """Rounds as a chain of tables: ``a`` has every part's nearest entry, ``b`` the entries after the round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT p.row, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v)) AS dist
          FROM p JOIN b{r} b USING (part, pos) GROUP BY ALL),
     a{r} AS MATERIALIZED (SELECT row, part, min(dist) AS dist, arg_min(entry, (dist, entry)) AS entry FROM d{r} GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT part, entry, pos, sum(v) AS s, count(*) AS c FROM p JOIN a{r} USING (row, part) GROUP BY ALL),
     b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % c) + c) % c) // c, v)::BIGINT AS v
          FROM b{r} LEFT JOIN s{r} USING (part, entry, pos))""")
    chain = ",\n     ".join(steps)
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS row, vec_id, label, ints FROM
         (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS ints FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
     p AS MATERIALIZED (SELECT row, i // (len(ints) // {PARTS}) AS part, i % (len(ints) // {PARTS}) AS pos, ints[i + 1] AS v
          FROM k, unnest(range(len(ints))) AS u(i)),
     b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, pos, v FROM p WHERE row <= {ENTRIES}),
     {chain},
     codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY row),
     books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN codes USING (row), books"""


ORACLE["op11_vector_codes"] = _codes_sql()

# The checksum is linear in the bits of a text: a table of each byte's part by its place from the end, xored, and the checksum
# of as many zero bytes.
ORACLE["op12_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
     counted AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY ALL),
     steps AS (SELECT i::BIGINT AS b, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
               UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
     tab AS MATERIALIZED (SELECT b, v FROM steps WHERE k = 8),
     longest AS (SELECT max(length(x) // 2) AS n FROM counted),
     part AS (SELECT 0 AS k, b, v FROM tab
              UNION ALL SELECT k + 1, part.b, xor(part.v >> 8, tab.v) FROM part JOIN tab ON tab.b = part.v & 255 WHERE k < (SELECT n FROM longest)),
     zeros AS (SELECT 0 AS n, 4294967295 AS v
               UNION ALL SELECT n + 1, xor(zeros.v >> 8, tab.v) FROM zeros JOIN tab ON tab.b = zeros.v & 255 WHERE n < (SELECT n FROM longest)),
     bytes AS (SELECT doc_id, run, length(x) // 2 - 1 - i AS k, ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT AS b FROM counted, unnest(range(length(x) // 2)) u(i)),
     sums AS (SELECT doc_id, run, bit_xor(v) AS s FROM bytes JOIN part USING (k, b) GROUP BY ALL),
     hashed AS (SELECT counted.run, c, xor(s, xor(4294967295, zeros.v)) AS h FROM counted JOIN sums ON sums.run = counted.run AND sums.doc_id IS NOT DISTINCT FROM counted.doc_id
                JOIN zeros ON zeros.n = length(x) // 2),
     seen AS (SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
     words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM seen WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
     less AS MATERIALIZED (SELECT word, i, word[1:i] || word[i + 2:] AS rest FROM words, unnest(range(length(word))) u(i)),
     near AS (SELECT a.word, b.word AS other FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
              UNION SELECT word, rest FROM less SEMI JOIN words ON words.word = less.rest
              UNION SELECT rest, word FROM less SEMI JOIN words ON words.word = less.rest),
     best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(o.word, (-o.n, o.word)) AS form FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
     chosen AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_RATIO} * n THEN form END AS form,
                             CASE WHEN form_n >= {FORM_RATIO} * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
     walk AS (SELECT word, word AS root FROM chosen WHERE form IS NULL
              UNION ALL SELECT chosen.word, walk.root FROM chosen JOIN walk ON chosen.form = walk.word)
SELECT word, form, root, n, n_near, form_n FROM chosen JOIN walk USING (word)"""
