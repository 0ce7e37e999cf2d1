"""Registered queries: memory formatting and budgeted context assembly."""

from __future__ import annotations


from memlake.config import NOW
from memlake.functions.format import format_memory
from memlake.operators import candidates as C
from memlake.operators import context as X
from memlake.plans.common import r6, register
from memlake.plans.memory_queries import SCORE_SQL, tier_sql
from memlake.sources import fixtures as FX

H7 = "substr(hash, 1, 7)"
PROJ = "CASE WHEN project IS NOT NULL AND project <> '' THEN concat(' @', project) ELSE '' END"
TAGS = "CASE WHEN len(tags) > 0 THEN concat(' [', array_to_string(tags, ', '), ']') ELSE '' END"


def _hdr(mark: str) -> str:
    return f"concat('## {mark} [', {H7}, ']', {PROJ}, {TAGS}, ' (score: ', printf('%.2f', score), ')')"


RECALL = f"chr(10), '> Recall full: hash `', {H7}, '`'"
B_HOT = f"concat({_hdr('🔴')}, chr(10), full_text)"
B_WARM = f"concat({_hdr('🟡')}, chr(10), summary_text, {RECALL})"
B_COOL = f"concat({_hdr('🔵')}, chr(10), essence_text, {RECALL})"
B_FADED = f"concat('## ⚪ [', {H7}, ']', {PROJ}, ' — ', essence_text, ' _(recall to restore)_')"


#: The text of a row at its own tier, from columns hash, project, tags, the three texts, score and fidelity.
TEXT_SQL = (f"CASE fidelity WHEN 'hot' THEN {B_HOT} WHEN 'warm' THEN {B_WARM} WHEN 'cool' THEN {B_COOL} "
            f"WHEN 'faded' THEN {B_FADED} ELSE '' END")


def u16(x: str) -> str:
    return f"CAST(length({x}) + length(regexp_replace({x}, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) AS BIGINT)"


@register("format_memory", f"""
sc AS (SELECT *, {SCORE_SQL} AS score FROM memories),
t AS (SELECT *, {tier_sql('score')} AS fidelity FROM sc)
SELECT hash, fidelity, round(score, 6) AS score,
  CASE fidelity WHEN 'hot' THEN {B_HOT} WHEN 'warm' THEN {B_WARM} WHEN 'cool' THEN {B_COOL}
                WHEN 'faded' THEN {B_FADED} ELSE '' END AS text
FROM t""")
def q_format_memory(spark, sf):
    """Every memory rendered at its own fidelity tier."""
    m = C.scored(FX.memories(spark, sf), NOW)
    return m.select("hash", "fidelity", r6("score").alias("score"), format_memory("fidelity").alias("text"))


CAND_BY_PROJECT = """cand AS (
  SELECT *, project AS g, row_number() OVER (PARTITION BY project ORDER BY importance DESC, last_accessed DESC, hash) AS crank
  FROM memories WHERE sensitivity <> 'secret' AND project IS NOT NULL QUALIFY crank <= 50)"""

PACK_TMPL = """sc AS (SELECT *, {score} AS score FROM cand),
blk AS (
  SELECT g, crank, hash, score, {tier} AS tier,
    {bh} AS bh, {bw} AS bw, {bc} AS bc, {bf} AS bf
  FROM sc),
lens AS (SELECT *, {lh} AS lh, {lw} AS lw, {lc} AS lc, {lf} AS lf FROM blk),
agg AS (
  SELECT g, list({{'h': hash, 't': tier, 'lh': lh, 'lw': lw, 'lc': lc, 'lf': lf,
                         'bh': bh, 'bw': bw, 'bc': bc, 'bf': bf}} ORDER BY score DESC, crank) AS items
  FROM lens GROUP BY g),
folded AS (
  SELECT g, list_reduce(items, lambda acc, it: CASE
      WHEN acc.stop OR it.t = 'gone' THEN acc
      WHEN it.t = 'hot' AND it.lh <= 8000 - acc.used
        THEN {{'used': acc.used + it.lh, 'stop': false, 'out': list_append(acc.out, {{'h': it.h, 't': 'hot', 'l': it.lh, 'b': it.bh}})}}
      WHEN it.t IN ('hot', 'warm') AND it.lw <= 8000 - acc.used
        THEN {{'used': acc.used + it.lw, 'stop': false, 'out': list_append(acc.out, {{'h': it.h, 't': 'warm', 'l': it.lw, 'b': it.bw}})}}
      WHEN it.t IN ('hot', 'warm', 'cool') AND it.lc <= 8000 - acc.used
        THEN {{'used': acc.used + it.lc, 'stop': false, 'out': list_append(acc.out, {{'h': it.h, 't': 'cool', 'l': it.lc, 'b': it.bc}})}}
      WHEN it.lf <= 8000 - acc.used
        THEN {{'used': acc.used + it.lf, 'stop': false, 'out': list_append(acc.out, {{'h': it.h, 't': 'faded', 'l': it.lf, 'b': it.bf}})}}
      ELSE {{'used': acc.used, 'stop': true, 'out': acc.out}} END,
    {{'used': 0::BIGINT, 'stop': false, 'out': []::STRUCT(h VARCHAR, t VARCHAR, l BIGINT, b VARCHAR)[]}}) AS st
  FROM agg),
sel AS (SELECT g, unnest(range(1, len(st.out) + 1)) AS pos, unnest(st.out) AS c FROM folded)"""


def pack_sql() -> str:
    return PACK_TMPL.format(score=SCORE_SQL, tier=tier_sql("score"), bh=B_HOT, bw=B_WARM, bc=B_COOL, bf=B_FADED,
                            lh=u16("bh"), lw=u16("bw"), lc=u16("bc"), lf=u16("bf"))


PACK_SQL = CAND_BY_PROJECT + ",\n" + pack_sql()


@register("context_selection", f"""{PACK_SQL}
SELECT g AS project, pos, c.h AS hash, c.t AS tier, c.l AS block_len FROM sel""")
def q_context_selection(spark, sf):
    """Per project: which memories the 8000-char context holds, at which tier."""
    it = X.packed_items(FX.memories(spark, sf), NOW)
    return it.select("project", "pos", "hash", "tier", "block_len")


CONTEXT_TEXT_SQL = """count(*) AS n_items, CAST(sum(c.l) AS BIGINT) AS used_chars,
  concat('# λ-Memory', chr(10), '_', CAST(count(*) AS VARCHAR), ' memories loaded | ~',
         CAST(CAST(floor(sum(c.l) / 4.0 + 0.5) AS BIGINT) AS VARCHAR), '/2000 tokens | ',
         CAST(sum(c.l) AS VARCHAR), ' chars_', chr(10), chr(10),
         string_agg(c.b, chr(10) ORDER BY pos)) AS context"""


@register("context_block", f"""{PACK_SQL}
SELECT g AS project, {CONTEXT_TEXT_SQL}
FROM sel GROUP BY g""")
def q_context_block(spark, sf):
    """Context request for every project: the assembled context text."""
    return X.context_blocks(X.packed_items(FX.memories(spark, sf), NOW))
