"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
 sets AS (SELECT doc_id, list_sort(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))) WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS members FROM words),
 named AS (SELECT doc_id, members, len(members) AS n, md5(array_to_string(members, ',')) AS name FROM sets),
 groups AS (SELECT name, min(doc_id) AS rep, any_value(n) AS n, any_value(members) AS members FROM named WHERE n > 0 GROUP BY 1),
 single AS (SELECT rep, n, unnest(members) AS h FROM groups),
 links AS (SELECT x.rep AS a, y.rep AS b FROM single x JOIN single y ON x.h = y.h AND x.rep <> y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
 reach AS (SELECT rep AS node, rep AS root FROM groups UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
 classes AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)
 SELECT d.doc_id, d.n AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, d.doc_id = coalesce(c.component, d.doc_id) AS kept
 FROM named d LEFT JOIN groups g ON d.name = g.name AND d.n > 0 LEFT JOIN classes c ON c.node = g.rep"""

BM25 = rf"""WITH said AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
 stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM said),
 counts AS (SELECT doc_id, any_value(size) AS size, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM said) GROUP BY doc_id, term),
 df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
 asked AS (SELECT c.doc_id AS query_id, c.term, c.tf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS weight FROM counts c JOIN df d USING (term), stats s WHERE c.doc_id % 50 = 0),
 scores AS (SELECT a.query_id, c.doc_id, round(sum(a.weight * c.tf * 2.2 / (c.tf + 1.2 * (0.25 + 0.75 * c.size / s.mean))), 9) AS score FROM asked a JOIN counts c USING (term), stats s GROUP BY 1, 2)
 SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10"""

#: The 256 remainders of CRC-32 (reversed polynomial 0xEDB88320), as a list, and the checksum of a list of bytes.
_CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"""


def _crc32(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda x, y: xor(x >> 8, crc.t[CAST(xor(x, y) & 255 AS BIGINT) + 1])), 4294967295)"


def _bytes(text: str) -> str:
    """UTF-8 bytes of characters below U+0800."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"


_DELETED = "concat(substr({0}, 1, {1} - 1), substr({0}, {1} + 1))"

SPELLING = rf"""WITH RECURSIVE {_CRC_TABLE},
 runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
 seen AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2),
 hashed AS (SELECT run, n, CAST({_crc32(_bytes("concat(doc_id, ':', run)"))} AS BIGINT) AS h FROM seen, crc),
 results AS (SELECT CASE WHEN h % 31 = 0 THEN {_DELETED.format("run", "(h % length(run) + 1)")} ELSE run END AS word, n FROM hashed),
 words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 holes AS (SELECT word, n, i, {_DELETED.format("word", "i")} AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
 near AS (SELECT x.word, y.word AS other, y.n FROM holes x JOIN holes y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.rest = y.word UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.rest = y.word),
 best AS (SELECT word, count(*) AS n_near, max(n) AS most, list(other ORDER BY n DESC, other)[1] AS other FROM near GROUP BY 1),
 forms AS (SELECT w.word, CASE WHEN b.most >= 10 * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n FROM words w LEFT JOIN best b USING (word)),
 walk AS (SELECT word, form AS place FROM forms WHERE form IS NOT NULL UNION SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.place WHERE f.form IS NOT NULL),
 ends AS (SELECT w.word, w.place AS root FROM walk w JOIN forms f ON f.word = w.place WHERE f.form IS NULL)
 SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e USING (word)"""

def _fields(*columns: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')" for c in columns) + "))"


def _tree(name: str, base: str) -> str:
    """Levels of the trees over ``base`` (tree, slot, d, n), and the children of every parent."""
    return f"""{name} AS (SELECT tree, 0 AS level, slot, d, n FROM {base} UNION ALL
  SELECT tree, level + 1, slot // 16, sha256(string_agg(d, '' ORDER BY slot)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, level, n, slot // 16),
 {name}_kids AS (SELECT tree, level, slot // 16 AS parent, list(d ORDER BY slot) AS ds FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _fold(name: str, tree: str, base: str) -> str:
    """From ``base`` (doc, tree, slot, d, n, siblings) up to the top of its tree."""
    return f"""{name} AS (SELECT doc, tree, 0 AS level, slot, d, n, siblings FROM {base} UNION ALL
  SELECT f.doc, f.tree, f.level + 1, f.slot // 16, sha256(array_to_string(list_concat(list_append(k.ds[1:f.slot % 16], f.d), k.ds[f.slot % 16 + 2:]), '')), (f.n + 15) // 16,
   concat(f.siblings, array_to_string(list_concat(k.ds[1:f.slot % 16], k.ds[f.slot % 16 + 2:]), ''))
  FROM {name} f JOIN {tree}_kids k ON k.tree = f.tree AND k.level = f.level AND k.parent = f.slot // 16 WHERE f.n > 1)"""


MERKLE = f"""WITH RECURSIVE {_CRC_TABLE},
 hashed AS (SELECT row_number() OVER () AS doc, doc_id, source, {_fields("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
  {_fields("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low, coalesce({_crc32(_bytes("CAST(doc_id AS VARCHAR)"))} % 5 = 0, false) AS hit FROM documents, crc),
 leaves AS (SELECT doc, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n, leaf, CASE WHEN hit THEN low ELSE leaf END AS other FROM hashed),
 nodes AS (SELECT tree, slot, leaf AS d, n FROM leaves),
 {_tree("low", "nodes")},
 tops AS (SELECT 0 AS tree, tree AS slot, d, count(*) OVER () AS n FROM low WHERE n = 1),
 {_tree("high", "tops")},
 changed AS (SELECT doc, tree, slot, other AS d, n, '' AS siblings FROM leaves),
 {_fold("up", "low", "changed")},
 reached AS (SELECT u.doc, 0 AS tree, u.tree AS slot, u.d, t.n, u.siblings FROM up u JOIN tops t ON t.slot = u.tree WHERE u.n = 1),
 {_fold("further", "high", "reached")}
 SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, sha256(f.siblings) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
 FROM leaves l JOIN tops s ON s.slot = l.tree JOIN further f ON f.doc = l.doc AND f.n = 1 CROSS JOIN (SELECT d FROM high WHERE n = 1) r"""

SQL = {"op11_merkle_manifest": MERKLE, "op12_spelling_forms": SPELLING, "op2_bm25_top_k": BM25, "op9_near_duplicates": NEAR_DUPLICATES}
