"""All registered queries and their SQL."""

from __future__ import annotations

from earshot.plans import fittings, forms, scores, signals, studies, work

QUERIES = scores.QUERIES | signals.QUERIES | work.QUERIES | studies.QUERIES | forms.QUERIES | fittings.QUERIES
SQL = scores.SQL | signals.SQL | work.SQL | studies.SQL | forms.SQL | fittings.SQL
