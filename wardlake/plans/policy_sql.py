"""Checking SQL for policy resolution and decisions over the check rows."""

from __future__ import annotations

from wardlake import fixed
from wardlake.plans import inputs, sql

RULES = "rules AS " + sql.values(
    [(i, *r) for i, r in enumerate(fixed.POLICY_RULES)],
    "pos, use_case, geography, check_name, block_threshold, flag_threshold, on_timeout",
)

ALIASES = "aliases AS " + sql.values(
    [(name, 0, name) for name in (*inputs.CHECK_NAMES, "sensitive_data", "system_prompt_leakage")]
    + [(name, 1, other) for name, other in fixed.CHECK_ALIASES.items()],
    "check_name, alias, c",
)

_D = fixed.POLICY_DEFAULTS

RESOLVED = f"""{inputs.CHECKS}, {RULES}, {ALIASES},
    ranked AS (SELECT k.use_case, k.geography, k.check_name, r.block_threshold, r.flag_threshold, r.on_timeout,
        row_number() OVER (PARTITION BY k.use_case, k.geography, k.check_name ORDER BY a.alias,
          CASE WHEN r.use_case = k.use_case THEN 0 ELSE 2 END + CASE WHEN r.geography = k.geography THEN 0 ELSE 1 END, r.pos) AS n
      FROM (SELECT DISTINCT use_case, geography, check_name FROM checks) k JOIN aliases a USING (check_name)
      JOIN rules r ON r.check_name = a.c AND (r.use_case = k.use_case OR coalesce(r.use_case, '*') = '*')
        AND (r.geography = k.geography OR coalesce(r.geography, '*') = '*')),
    resolved AS (SELECT c.*, coalesce(r.block_threshold, {_D['block_threshold']})::DOUBLE AS block_threshold,
        coalesce(r.flag_threshold, {_D['flag_threshold']})::DOUBLE AS flag_threshold, coalesce(r.on_timeout, '{_D['on_timeout']}') AS on_timeout
      FROM checks c LEFT JOIN ranked r ON r.n = 1 AND c.use_case = r.use_case AND c.geography = r.geography AND c.check_name = r.check_name)"""

JUDGED = f"""{RESOLVED},
    judged AS (SELECT * EXCLUDE (verdict), CASE WHEN verdict = 'skipped' THEN 'skipped' WHEN score >= block_threshold THEN 'fail'
      WHEN score >= flag_threshold THEN 'warn' ELSE 'pass' END AS verdict FROM resolved)"""

DECIDED = f"""{JUDGED},
    marked AS (SELECT *, verdict = 'fail' OR (verdict = 'skipped' AND on_timeout = 'block') AS stops,
        verdict = 'warn' OR (verdict = 'skipped' AND on_timeout = 'allow_with_flag') AS warns FROM judged),
    folded AS (SELECT event_id, interaction_id, session_id, direction, use_case, geography, created_at,
        min_by({{'name': check_name, 'score': score, 'v': verdict, 't': block_threshold, 'l': layer}}, pos) FILTER (stops) AS s,
        list({{'r': CASE WHEN verdict = 'skipped' THEN 'Timeout on ' || check_name ELSE 'Warning on ' || check_name || ' (score: ' || printf('%.2f', score) || ')' END,
          'l': CASE WHEN verdict <> 'skipped' THEN layer END}} ORDER BY pos) FILTER (warns) AS w,
        coalesce(max(score) FILTER (verdict <> 'skipped'), 0) AS top FROM marked GROUP BY ALL),
    decided AS (SELECT event_id, interaction_id, session_id, direction, use_case, geography, created_at,
        CASE WHEN s IS NOT NULL THEN 'block' WHEN len(w) > 1 THEN 'escalate' WHEN len(w) = 1 THEN 'flag' ELSE 'allow' END AS action,
        CASE WHEN s IS NOT NULL THEN 'high' WHEN len(w) > 0 THEN 'medium' ELSE 'low' END AS tier,
        CASE WHEN s.v = 'skipped' THEN 1.0 WHEN s IS NOT NULL THEN s.score ELSE top END::DOUBLE AS confidence,
        CASE WHEN s.v = 'skipped' THEN 'Timeout on ' || s.name
          WHEN s IS NOT NULL THEN 'Failed ' || s.name || ' check (score: ' || printf('%.2f', s.score) || ' >= ' || s.t || ')'
          WHEN len(w) > 1 THEN 'Multiple warnings: ' || array_to_string(list_transform(w, lambda x: x.r), ', ')
          WHEN len(w) = 1 THEN w[1].r ELSE 'All checks passed' END AS reason,
        CASE WHEN s.v = 'skipped' THEN NULL WHEN s IS NOT NULL THEN s.l WHEN len(w) > 0 THEN w[1].l END AS blocked_by_layer,
        'v1' AS policy_version FROM folded)"""
