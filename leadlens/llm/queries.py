"""The registered queries of this package and their SQL."""

from __future__ import annotations

from leadlens.llm.collisions import op11_collisions
from leadlens.llm.curve import op8_curve
from leadlens.llm.feistel import op6_feistel
from leadlens.llm.permuterm import op13_permuterm
from leadlens.llm.pseudolik import op5_pseudolik
from leadlens.llm.reshard import op10_reshard
from leadlens.llm.rtree import op7_rtree
from leadlens.llm.rules import op9_rules
from leadlens.llm.secrets import op1_secrets
from leadlens.llm.spotsigs import op3_spotsigs
from leadlens.llm.tiling import op4_tiling
from leadlens.llm.wavelet import op2_wavelet
from leadlens.llm.whiten import op12_whitening

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_wavelet": op2_wavelet,
    "op3_spotsigs": op3_spotsigs,
    "op4_tiling": op4_tiling,
    "op5_pseudolik": op5_pseudolik,
    "op6_feistel": op6_feistel,
    "op7_rtree": op7_rtree,
    "op8_curve": op8_curve,
    "op9_rules": op9_rules,
    "op10_reshard": op10_reshard,
    "op11_collisions": op11_collisions,
    "op12_whitening": op12_whitening,
    "op13_permuterm": op13_permuterm,
}
#: DuckDB SQL. Token files, trained models, keyed permutations and random draws have none.
ORACLE: dict[str, str] = {
    "op7_rtree": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
points AS (SELECT s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
flat AS (SELECT rep, n, unnest(s) AS g FROM points),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM flat a JOIN flat b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS x, rep AS y FROM points UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
groups AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, len(d.s) AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(c, d.doc_id) END AS component_id
FROM sets d LEFT JOIN points p ON d.s = p.s LEFT JOIN groups ON p.rep = groups.x
""",
}
