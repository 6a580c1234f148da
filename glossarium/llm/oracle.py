"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import decontaminate as de
from . import license_scan as ls
from .warc import SHARED_FROM

_SPACES = r"'[\x20\x09-\x0D]+'"

OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACES}), lambda x: x <> '') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(y) FROM r WHERE r.x = w.doc_id), w.doc_id) AS component_id, greatest((SELECT count(*) FROM l WHERE l.x = w.doc_id) - 1, 0) AS n_links FROM w LEFT JOIN n ON w.doc_id = n.doc_id"""

OP4 = rf"""WITH w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {_SPACES}), lambda x: x <> '') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY 1),
gone AS MATERIALIZED (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN first USING (s) WHERE d < doc_id) GROUP BY 1),
kept AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w) w LEFT JOIN (SELECT doc_id, unnest(ks) AS k, true AS g FROM gone) g USING (doc_id, k) WHERE g IS NULL GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id"""

OP5 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {SHARED_FROM} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= {SHARED_FROM} AND page_id <> first THEN first END AS refers_to FROM q"""


def _canonical(table: str, key: str) -> str:
    """(key, form, raw): canonical forms and words of a table's texts."""
    ws = r"[\x20\x09-\x0D]"
    step = lambda text, pattern, by: f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    form = step(step("bare", rf"(^|{ws})\p{{N}}[^\x20\x09-\x0D]*", r"\1#n"), rf"(^|{ws})\p{{Lu}}\p{{Ll}}[^\x20\x09-\x0D]*", r"\1#p")
    form = step(f"lower({form})", rf"(#n{ws}+)(?:{'|'.join(de.UNITS)})({ws}|$)", r"\1#u\2")
    words = lambda x: f"list_filter(string_split_regex({x}, {_SPACES}), lambda x: x <> '')"
    bare = step("coalesce(text, '')", r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return f"SELECT {key}, {words(form)} AS form, {words('bare')} AS raw FROM (SELECT {key}, {bare} AS bare FROM {table})"


def op1() -> str:
    n, slot = de.WINDOW, "('#n', '#u', '#p')"
    counts = f"len(list_filter(form, lambda c: c NOT IN {slot})) >= {de.FIXED}"
    lowered = lambda which: f"list_transform(range(1, {n} + 1), lambda j: CASE WHEN form[j] = '#p'{which} THEN lower(raw[j]) ELSE form[j] END)"
    return rf"""WITH b AS MATERIALIZED ({_canonical("benchmark", "item_id")}), d AS MATERIALIZED ({_canonical("documents", "doc_id")}),
place AS (SELECT * FROM (SELECT item_id, i - 1 AS place, form[i:i + {n - 1}] AS form, raw[i:i + {n - 1}] AS raw FROM (SELECT *, unnest(range(1, len(form) - {n - 2})) AS i FROM b WHERE len(form) >= {n})) WHERE {counts}),
many AS (SELECT item_id, count(DISTINCT place) AS in_item FROM place GROUP BY 1),
bw AS MATERIALIZED (SELECT DISTINCT item_id, place, in_item, raw AS item_raw, f AS item_form, array_to_string(f, ' ') AS s FROM (SELECT item_id, place, raw, unnest([form, {lowered("")}, {lowered(" AND j = 1 AND place = 0")}]) AS f FROM place) JOIN many USING (item_id)),
dw AS (SELECT doc_id, i - 1 AS pos, raw[i:i + {n - 1}] AS raw, array_to_string(form[i:i + {n - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(form) - {n - 2})) AS i FROM d WHERE len(form) >= {n})),
hit AS MATERIALIZED (SELECT doc_id, item_id, in_item, pos, place, pos - place AS diag, item_form, item_raw, raw, count(*) OVER (PARTITION BY doc_id, item_id, pos - place) AS votes FROM dw JOIN bw USING (s)),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, pos ORDER BY votes DESC, diag) = 1),
step AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, item_id ORDER BY diag) >= {n} THEN 1 ELSE 0 END AS new FROM best),
occ AS MATERIALIZED (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY diag) AS occ FROM step),
slot AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, occ, pos, place, item_form[j] AS kind, item_raw[j] AS said, raw[j] AS now, pos + j AS spot FROM (SELECT *, unnest(range(1, {n} + 1)) AS j FROM occ) WHERE item_form[j] IN {slot}),
vote AS MATERIALIZED (SELECT *, sum(votes) OVER (PARTITION BY doc_id, item_id, occ, kind, said) AS summed FROM (SELECT doc_id, item_id, occ, kind, said, now, count(DISTINCT spot) AS votes FROM slot GROUP BY ALL)),
pick AS (SELECT *, 3 * votes >= 2 * summed OR now = said AND NOT max(3 * votes >= 2 * summed) OVER (PARTITION BY doc_id, item_id, occ, kind, said) AS chosen FROM vote),
fit AS MATERIALIZED (SELECT doc_id, item_id, occ, kind, said, now FROM pick WHERE chosen QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, occ, kind, now ORDER BY votes DESC, now = said DESC, said) = 1),
bad AS (SELECT DISTINCT doc_id, item_id, occ, pos, place FROM slot s WHERE NOT EXISTS (SELECT 1 FROM fit f WHERE f.doc_id = s.doc_id AND f.item_id = s.item_id AND f.occ = s.occ AND f.kind = s.kind AND f.said = s.said AND f.now = s.now)),
differ AS (SELECT doc_id, item_id, occ, pos, place, max(said <> now) AS differs FROM slot GROUP BY ALL),
found AS (SELECT o.doc_id, o.item_id, in_item, count(DISTINCT place) AS n_windows, max(coalesce(differs, false)) AS changed FROM (SELECT * FROM occ ANTI JOIN bad USING (doc_id, item_id, occ, pos, place)) o LEFT JOIN differ USING (doc_id, item_id, occ, pos, place) GROUP BY 1, 2, 3),
whole AS (SELECT item_id, ' ' || lower(array_to_string(raw, ' ')) || ' ' AS s FROM b WHERE len(raw) >= {de.SHORTEST} AND item_id NOT IN (SELECT item_id FROM place WHERE place > 0)),
every AS (SELECT doc_id, item_id, n_windows, n_windows / in_item AS coverage, changed FROM found WHERE n_windows / in_item >= {de.COVERED}
UNION ALL SELECT doc_id, item_id, 1, 1.0, false FROM d JOIN whole ON contains(' ' || lower(array_to_string(raw, ' ')) || ' ', s))
SELECT doc_id, item_id, max(n_windows)::BIGINT AS n_windows, max(coverage)::DOUBLE AS coverage, max(changed) AS changed FROM every GROUP BY 1, 2"""


def op10() -> str:
    rows = [(label, text, True) for label, text in ls.PHRASES] + [(label, text, False) for label, text in ls.TEXTS]
    values = ", ".join(f"({k}, '{label}', '{text}', {str(exact).lower()})" for k, (label, text, exact) in enumerate(rows))
    g = ls.GRAM
    return rf"""WITH t AS (SELECT tpl, label, exact, string_split(x, ' ') AS w FROM (VALUES {values}) v(tpl, label, x, exact)),
tg AS (SELECT tpl, label, exact, len(w) - {g - 1} AS grams, i - 1 AS tpos, array_to_string(w[i:i + {g - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {g - 2})) AS i FROM t)),
d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {g - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {g - 2})) AS i FROM d WHERE len(w) >= {g})),
hit AS MATERIALIZED (SELECT doc_id, tpl, label, exact, grams, tpos, pos, pos - tpos AS diag FROM dg JOIN tg USING (s)),
line AS (SELECT doc_id, tpl, label, exact, grams, diag, list(DISTINCT tpos) AS seen, min(pos) AS a FROM hit GROUP BY ALL),
mark AS (SELECT *, CASE WHEN exact THEN 1 ELSE coalesce((diag - lag(diag) OVER (PARTITION BY doc_id, tpl ORDER BY diag) > {ls.NEAR})::INT, 1) END AS new FROM line),
isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diag) AS isle FROM mark),
span AS (SELECT doc_id, tpl, label, exact, grams, isle, len(list_distinct(flatten(list(seen)))) AS votes, min(a) AS a FROM isle GROUP BY ALL),
ok AS (SELECT *, votes / grams AS share FROM span WHERE CASE WHEN exact THEN votes = grams ELSE votes / grams >= {ls.COVERED} END)
SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(a) FILTER (exact) AS n_base, (min(a) FILTER (exact))::BIGINT AS first_word, (max(a) FILTER (exact))::BIGINT AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score FROM d LEFT JOIN ok ON d.doc_id = ok.doc_id GROUP BY 1"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit with the usual reflected polynomial."""
    one = "list_reduce(list_prepend(xor(c, x), range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)), lambda c, x: {one}))"


OP11 = f"""WITH m AS MATERIALIZED (SELECT doc_id, text, lang, source, {_crc32("doc_id::VARCHAR")} % 16 AS m FROM documents),
late AS MATERIALIZED (SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM m WHERE m IS DISTINCT FROM 0
UNION ALL SELECT -1 - doc_id, text, lang, source FROM m WHERE m = 5),
early AS (SELECT doc_id AS k, text, lang, source FROM m),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM early e WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.k = e.k)),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k) AS i FROM late l WHERE NOT EXISTS (SELECT 1 FROM early WHERE early.k = l.k)),
pair AS (SELECT true AS keyed, e.k AS old_key, l.k AS new_key, e.text AS t0, l.text AS t1, e.lang AS l0, l.lang AS l1, e.source AS s0, l.source AS s1 FROM early e JOIN late l ON e.k = l.k
UNION ALL SELECT false, a.k, b.k, a.text, b.text, a.lang, b.lang, a.source, b.source FROM a FULL JOIN b ON a.i = b.i AND (a.text = b.text OR a.text IS NULL AND b.text IS NULL)),
said AS (SELECT *, concat_ws(',', CASE WHEN t0 IS DISTINCT FROM t1 THEN 'text' END, CASE WHEN l0 IS DISTINCT FROM l1 THEN 'lang' END, CASE WHEN s0 IS DISTINCT FROM s1 THEN 'source' END) AS differs FROM pair)
SELECT coalesce(new_key, old_key) AS key, old_key, CASE WHEN old_key IS NULL THEN 'insert' WHEN new_key IS NULL THEN 'delete' WHEN NOT keyed THEN 'rekey' WHEN differs = '' THEN 'same' ELSE 'update' END AS op,
CASE WHEN old_key IS NULL OR new_key IS NULL THEN '' ELSE differs END AS changed, CASE WHEN new_key IS NOT NULL THEN sha256(coalesce(t1, '~') || chr(10) || coalesce(l1, '~') || chr(10) || coalesce(s1, '~')) END AS row_sha256 FROM said"""


def op12(levels: int = 6) -> str:
    """Level by level: k<i> has the nodes of level i, n of them in each tree; a tree of one node stays as it is.

    levels: enough for 16 ** levels rows of a source, and as many sources.
    """
    texts = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text")
    row = lambda *t: "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')" for x in t) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, source, {row(*texts)} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {row(*texts[:4], lower)} ELSE {row(*texts)} END AS now FROM documents)",
        "a0 AS MATERIALIZED (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n, doc_id, leaf, now FROM d)",
    ]

    def tree(p: str) -> None:
        for k in range(levels):
            ctes.append(f"{p}g{k} AS MATERIALIZED (SELECT tree, i // 16 AS g, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {p}{k} GROUP BY ALL)")
            if k + 1 < levels:
                ctes.append(f"{p}{k + 1} AS MATERIALIZED (SELECT tree, CASE WHEN n = 1 THEN 0 ELSE g END AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, CASE WHEN n = 1 THEN 1 ELSE (n + 15) // 16 END AS n FROM {p}g{k})")

    tree("a")
    ctes.append(f"b0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, source FROM (SELECT tree AS source, h FROM a{levels - 1}))")
    tree("b")
    ctes.append("l0 AS (SELECT doc_id, leaf, tree AS source, i, now AS f, '' AS proof FROM a0)")
    last = "l0"

    def up(p: str, key: str) -> None:
        nonlocal last
        for k in range(levels - 1):
            j, at = len(ctes), f"{last}.i % 16"
            left, right = f"array_to_string(hs[1:({at})::INT], '')", f"array_to_string(hs[({at})::INT + 2:], '')"
            ctes.append(f"l{j} AS (SELECT doc_id, leaf, source, CASE WHEN n = 1 THEN 0 ELSE {last}.i // 16 END AS i, CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {last} JOIN {p}g{k} g ON g.tree IS NOT DISTINCT FROM {key} AND g.g = {last}.i // 16)")
            last = f"l{j}"

    up("a", "source")
    j = len(ctes)
    ctes.append(f"m{j} AS (SELECT doc_id, leaf, b0.source, b0.i, f, proof, h AS subroot FROM {last} JOIN b0 ON b0.source IS NOT DISTINCT FROM {last}.source)")
    ctes.append("s AS (SELECT source AS of, h AS subroot FROM b0)")
    last = f"m{j}"
    up("b", "0")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last} JOIN s ON s.of IS NOT DISTINCT FROM {last}.source CROSS JOIN (SELECT h AS root FROM b{levels - 1})"


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": op1(), "op3_jaccard_join": OP3, "op4_super_kmers": OP4, "op5_warc_index": OP5, "op10_license_diagonals": op10(), "op11_snapshot_diff": OP11, "op12_merkle_manifest": op12()}
