"""SQL that gives the rows of the numbered queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

#: CRC-32 has no function there: its table by the polynomial's rule, and a fold over the bytes of an ASCII text.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def crc(text: str, table: str = "crc_table.t") -> str:
    bytes_ = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def merkle_sql(levels: int = 16) -> str:
    """Trees of up to 3 ** levels leaves a source and as many sources: a level of nodes after the other, then proofs folded likewise."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    ctes = [
        f"crc_table AS ({CRC_TABLE})",
        f"""docs AS (SELECT *, coalesce('=' || source, '-') AS g, sha256({head} || {field("text")}) AS leaf,
  CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({head} || {field("replace(text, chr(10), '')")}) END AS spoilt FROM documents, crc_table)""",
        "leaves AS (SELECT g, doc_id, leaf, coalesce(spoilt, leaf) AS spoilt, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs)",
    ]

    def tree(name: str, start: str) -> None:
        """Levels name0, name1, ... of (g, i, n, h), n being the nodes of g on that level; a root alone stays as it is."""
        ctes.append(f"{name}0 AS ({start})")
        for k in range(levels):
            ctes.append(
                f"{name}{k + 1} AS (SELECT g, i // 3 AS i, any_value((n + 2) // 3) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 3)"
            )

    def proofs(name: str, start: str, out: str) -> None:
        """out: (g, i, p, f): siblings of each leaf joined in order, and the leaf folded with them."""
        ctes.append(f"{out}0 AS ({start})")
        for k in range(levels):
            ctes.append(
                f"""{name}s{k} AS MATERIALIZED (SELECT g, i // 3 AS r, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}{k} GROUP BY g, i // 3),
{out}{k + 1} AS (SELECT a.id, a.g, a.i // 3 AS i,
  CASE WHEN s.n = 1 THEN a.p ELSE a.p || array_to_string(list_filter(s.hs, lambda x, j: j <> a.i % 3 + 1), '') END AS p,
  CASE WHEN s.n = 1 THEN a.f ELSE sha256(array_to_string(list_transform(s.hs, lambda x, j: CASE WHEN j = a.i % 3 + 1 THEN a.f ELSE x END), '')) END AS f
  FROM {out}{k} a JOIN {name}s{k} s ON a.g = s.g AND a.i // 3 = s.r)"""
            )

    tree("t", "SELECT g, i, n, leaf AS h FROM leaves")
    ctes.append(f"sources AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t{levels})")
    tree("u", "SELECT '' AS g, i, n, subroot AS h FROM sources")
    proofs("t", "SELECT g || ':' || i AS id, g, i, '' AS p, spoilt AS f FROM leaves", "a")
    proofs("u", f"SELECT a.id, '' AS g, s.i, a.p, a.f FROM a{levels} a JOIN sources s ON a.g = s.g", "b")
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(b.p) AS proof_sha256, b.f AS folded_root, b.f = r.h AS verified
FROM leaves l JOIN sources s ON l.g = s.g JOIN b{levels} b ON b.id = l.g || ':' || l.i CROSS JOIN u{levels} r"""
    )


def conversation_repair_sql() -> str:
    """The same edits by a recursion from the last turn: of each grammar state the least (cost, audit) of what follows, as one text that sorts so."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda cost, letters, v: f"printf('%08d', CAST(left({v}, 8) AS BIGINT) + {cost}) || '{letters}' || substr({v}, 9)"
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    turned = {0: 2, 1: 2, 2: 3, 3: 2}
    never = "'90000000'"

    def turn(q: int) -> str:
        kept = "".join(f" WHEN x = '{x}' THEN {add('cut', 'K', f'v{to}')}" for (state, x), to in after.items() if state == q)
        return f"least({add(2, 'D', f'v{q}')}, CASE WHEN gone THEN {never} ELSE least({add('cut + 1', 'R', f'v{turned[q]}')}, CASE{kept} ELSE {never} END) END) AS u{q}"

    def inserted(q: int) -> str:
        one, two = turned[q], turned[turned[q]]
        return f"least(u{q}, {add(5, 'I', f'u{one}')}, {add(10, 'II', f'u{two}')})"

    told = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    return f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE}),
kinds AS (SELECT conv_id, turn, {told("role")} AS role, {told("text")} AS text, {crc(told("conv_id") + " || ':' || " + told("turn"))} % 20 AS kind FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, {white}) AS body FROM damaged),
judged AS (SELECT *, left(role, 1) AS x, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS ended_badly,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
turns AS (SELECT conv_id, i, role, text, x, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND ended_badly AS truncated, blank OR again AS gone, CASE WHEN ended_badly THEN 5 ELSE 0 END AS cut, pair FROM judged),
summed AS (SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
spans AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM damaged GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS i, '00000000' AS v0, '00000010II' AS v1, '00000005I' AS v2, '00000000' AS v3 FROM summed
  UNION ALL
  SELECT conv_id, i, {", ".join(map(inserted, range(4)))} FROM (
    SELECT t.conv_id, t.i, {", ".join(map(turn, range(4)))} FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1)),
chosen AS (SELECT conv_id, CAST(left(v0, 8) AS BIGINT) AS cost, substr(v0, 9) AS audit FROM best WHERE i = 1),
letters AS (SELECT conv_id, p, audit[p] AS letter, length(regexp_replace(audit[:p], 'I', '', 'g')) AS i, length(regexp_replace(audit[p:], 'D', '', 'g')) AS from_end
  FROM chosen, unnest(range(1, length(audit) + 1)) AS u(p)),
lines AS (SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN t.role WHEN from_end % 2 = 1 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p) AS body
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, CAST(coalesce(g.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
  coalesce(k.cost, 0) AS cost, coalesce(k.audit, '') AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN summed s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN spans g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""
