"""SQL that gives the rows of corpus queries which SQL can express, for comparison on small tables."""

from __future__ import annotations

from vintara.llm import merkle, spelling


def _crc_table() -> list[int]:
    """What each byte adds to a CRC-32 (the reflected polynomial of ISO 3309)."""
    found = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        found.append(value)
    return found


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr({digits}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    step = f"xor(c >> 8, CAST(({_crc_table()})[CAST((xor(c, b) & 255) + 1 AS INTEGER)] AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in merkle.COLUMNS) + ")"


_LOWER = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"


def _tree(name: str, leaves: str) -> str:
    """The nodes of the trees over ``leaves`` (``grp, size, place, leaf``), and their runs of siblings."""
    return f"""{name}_nodes AS (
    SELECT grp, size, 0 AS level, place, leaf AS digest FROM {leaves}
    UNION ALL
    SELECT grp, size, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM {name}_nodes
    WHERE size > pow(8, level) GROUP BY grp, size, level, place // 8),
  {name}_runs AS (SELECT grp, level, place // 8 AS run, list(digest ORDER BY place) AS kids FROM {name}_nodes WHERE size > pow(8, level) GROUP BY ALL),
  {name}_roots AS (SELECT grp, arg_max(digest, level) AS root FROM {name}_nodes WHERE place = 0 GROUP BY grp)"""


def _walk(name: str, start: str) -> str:
    """What each row of ``start`` (``row, grp, place, folded, proof``) is folded to on its way to the root."""
    kids = "kids[1:(place % 8)]", "kids[(place % 8) + 2:]"
    left, right = (f"coalesce(array_to_string({part}, ''), '')" for part in kids)
    return f"""{name}_walk AS (
    SELECT row, grp, 0 AS level, place, folded, proof FROM {start}
    UNION ALL
    SELECT w.row, w.grp, w.level + 1, w.place // 8, sha256({left} || folded || {right}), proof || {left} || {right}
    FROM {name}_walk w JOIN {name}_runs r ON r.grp = w.grp AND r.level = w.level AND r.run = w.place // 8),
  {name}_ends AS (SELECT row, grp, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM {name}_walk GROUP BY ALL)"""


MERKLE = f"""WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS grp, {_leaf('text')} AS leaf,
           CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS folded FROM documents),
  placed AS (SELECT *, count(*) OVER (PARTITION BY grp) AS size, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows),
  {_tree('own', 'placed')},
  tops AS (SELECT '' AS grp, count(*) OVER () AS size, row_number() OVER (ORDER BY grp) - 1 AS place, root AS leaf, grp AS name FROM own_roots),
  {_tree('top', 'tops')},
  own_start AS (SELECT row, grp, place, folded, '' AS proof FROM placed),
  {_walk('own', 'own_start')},
  top_start AS (SELECT e.row, '' AS grp, t.place, e.folded, e.proof FROM own_ends e JOIN tops t ON t.name = e.grp),
  {_walk('top', 'top_start')}
  SELECT p.doc_id, p.leaf, o.root AS subroot, t.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = t.root AS verified
  FROM placed p JOIN own_roots o USING (grp) JOIN top_ends e USING (row) CROSS JOIN top_roots t"""


_RUN = "[A-Za-z\\u00C0-\\u00FF]+".encode().decode("unicode_escape")
_HASH = crc32("doc_id || ':' || run")

SPELLING = f"""WITH RECURSIVE runs AS (
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{_RUN}')), '{merkle.UPPER}', '{merkle.LOWER}') AS run FROM documents),
  counted AS (SELECT coalesce(doc_id, '') AS doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY ALL),
  hashed AS (SELECT run, n, {_HASH} AS h FROM counted),
  spoiled AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word, n FROM hashed),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoiled WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
  cuts AS (SELECT word, n, i, left(word, i) || substr(word, CAST(i + 2 AS INTEGER)) AS rest FROM words, unnest(range(0, length(word))) AS u(i)),
  pairs AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word),
  forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.FORM_RATIO} * n THEN other END AS form,
            CASE WHEN m >= {spelling.FORM_RATIO} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
  chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL
    SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next WHERE c.next IS NOT NULL)
  SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""
