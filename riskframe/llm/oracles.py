"""SQL twins of the operators' queries, where SQL can express them.

Sharding hashes, trained models, tokenizers and keyed digests are beyond SQL;
those queries are tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from riskframe.llm.licenses import COSINE, COVER, TEMPLATES, WHOLE, whole_texts

ORACLES: dict[str, str] = {}


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """CTE ``least``: (x, component) from a table of nodes (x) and one of links (a, b)."""
    return f"""
reach AS (SELECT x, x AS y FROM {nodes}
          UNION SELECT r.x, l.b FROM reach r JOIN (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}) l ON l.a = r.y),
least AS (SELECT x, min(y) AS component FROM reach GROUP BY x)"""


ORACLES["op3_metric_range_join"] = f"""
WITH RECURSIVE v AS (SELECT vec_id AS x, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT p.x AS a, q.x AS b FROM v p JOIN v q ON p.x < q.x WHERE list_cosine_similarity(p.e, q.e) >= 0.95::DOUBLE),
{_components("v", "links").strip()},
degree AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM links UNION ALL SELECT b FROM links) GROUP BY x)
SELECT x AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, x = component AS kept
FROM least LEFT JOIN degree USING (x)"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
ORACLES["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low("text")}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM
        (SELECT item_id, regexp_extract_all({_low("text")}, {_WORD}) AS w FROM benchmark) WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
          FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM b)),
wins AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
               FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM wins JOIN grams USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op10_superminhash"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS x, regexp_extract_all({_low("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT x, array_to_string(w[k:k + 4], ' ') AS g
         FROM (SELECT x, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT x, count(*) AS n FROM sets GROUP BY x),
links AS (SELECT a, b FROM (SELECT p.x AS a, q.x AS b, count(*) AS c FROM sets p JOIN sets q ON p.g = q.g AND p.x < q.x GROUP BY 1, 2)
          JOIN sizes s ON s.x = a JOIN sizes t ON t.x = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
{_components("d", "links").strip()}
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, x = component AS kept
FROM least LEFT JOIN sizes USING (x)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LISTED = [(name, f"{name} {i}", text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_WHOLE = whole_texts()
_BEST = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1"
ORACLES["op8_license_scan"] = rf"""
WITH templates(license, template, words) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for a, b, c in _LISTED)}),
tc AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest({_TERMS.format("words")}) AS term FROM templates) GROUP BY ALL),
owned AS (SELECT DISTINCT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents),
had AS (SELECT term, count(*) AS n FROM owned GROUP BY term),
idf AS (SELECT term, any_value(ln(1 + {len(_LISTED)}::DOUBLE / m) * (1 - coalesce(n, 0)::DOUBLE / ((SELECT count(text) FROM documents) + 1))) AS idf
        FROM (SELECT term, count(*) AS m FROM tc GROUP BY term) LEFT JOIN had USING (term) GROUP BY term),
tw AS (SELECT license, template, term, tf * idf AS w, sum(pow(tf * idf, 2)) OVER (PARTITION BY template) AS square FROM tc JOIN idf USING (term)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
lc AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest({_TERMS.format("line")}) AS term FROM (SELECT DISTINCT line FROM lines)) GROUP BY ALL),
lw AS (SELECT line, term, tf * coalesce(idf, ln(1 + {len(_LISTED)}::DOUBLE)) AS w FROM lc LEFT JOIN idf USING (term)),
ln AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line),
scored AS (SELECT line, license, round(sum(lw.w * tw.w) / (sqrt(any_value(square)) * any_value(ln.norm)), 6) AS score,
                  round(sum(tw.w * tw.w) / any_value(square), 6) AS covered
           FROM lw JOIN tw USING (term) JOIN ln USING (line) GROUP BY line, license, template),
said AS (SELECT doc_id, license, score FROM lines JOIN scored USING (line) WHERE score >= {COSINE} AND covered >= {COVER} {_BEST}),
known(license, term, weight) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(t)}, {w!r}::DOUBLE)" for a, own in _WHOLE.items() for t, w in own.items())}),
kn AS (SELECT license, sqrt(sum(weight * weight)) AS norm FROM known GROUP BY license),
ki AS (SELECT term, ln(1 + {len(_WHOLE)}::DOUBLE / count(*)) AS idf FROM known GROUP BY term),
dc AS (SELECT doc_id, term, (1 + ln(count(*))) * coalesce(any_value(idf), ln(1 + {len(_WHOLE)}::DOUBLE)) AS w
       FROM (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents) LEFT JOIN ki USING (term) GROUP BY doc_id, term),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dc GROUP BY doc_id),
dots AS (SELECT doc_id, license, sum(w * weight) AS dot FROM dc JOIN known USING (term) GROUP BY doc_id, license),
texts AS (SELECT doc_id, license, round(dot / (kn.norm * dn.norm), 6) AS score FROM dots JOIN kn USING (license) JOIN dn USING (doc_id)
          WHERE round(dot / (kn.norm * dn.norm), 6) >= {WHOLE} {_BEST}),
files AS (SELECT doc_id, source || '/' || lang AS folder, coalesce(t.license, s.license) AS own_license, coalesce(t.score, s.score) AS score,
                 t.license IS NOT NULL AS is_license_file
          FROM documents LEFT JOIN said s USING (doc_id) LEFT JOIN texts t USING (doc_id)),
speaks AS (SELECT folder, own_license AS given FROM files WHERE is_license_file
           QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, own_license) = 1)
SELECT doc_id, folder || '/' || doc_id || '.txt' AS path, own_license, score, coalesce(own_license, given) AS license,
       CASE WHEN own_license IS NOT NULL THEN folder || '/' || doc_id || '.txt' WHEN given IS NOT NULL THEN folder END AS licensed_by,
       is_license_file
FROM files LEFT JOIN speaks USING (folder)"""

_BYTES = "list_transform(range(len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)"
ORACLES["op11_importance_resampling"] = rf"""
WITH RECURSIVE steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
          UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_low("text")}, {_WORD}), []) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_low("text")}, {_WORD})) AS word FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS word FROM d),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}),
                                        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
           FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM b)), crc),
s AS (SELECT bucket, count(*) AS n FROM f JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)
                              / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM f JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
                  (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM d LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN place END::BIGINT AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""
