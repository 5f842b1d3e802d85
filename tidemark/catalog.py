"""All queries by name, and the SQL that checks them."""

from __future__ import annotations

from tidemark.operators import answers, audit, calibration, call_matching, classify, data_prep, generation, generator, injection, intervals, matching, perturb, rectangles, reference, replies, runs, samplers, scenes, splitting, statistics, structured, templates, tool_queries, traces
from tidemark.sources import run_files
from tidemark.streaming import records

QUERIES = {**tool_queries.QUERIES, **templates.TEMPLATES, **matching.QUERIES, **perturb.QUERIES, **calibration.QUERIES, **injection.QUERIES, **rectangles.QUERIES, **generator.QUERIES, **samplers.QUERIES, **audit.QUERIES, **intervals.QUERIES, **structured.QUERIES, **call_matching.QUERIES, **reference.QUERIES, **splitting.QUERIES, **runs.QUERIES, **data_prep.QUERIES, **statistics.QUERIES, **traces.QUERIES, **records.QUERIES, **generation.QUERIES, **classify.QUERIES, **answers.QUERIES, **scenes.QUERIES, **replies.QUERIES, **run_files.QUERIES}
ORACLE_SQL = {**tool_queries.ORACLE_SQL, **templates.ORACLE_SQL, **matching.ORACLE_SQL, **perturb.ORACLE_SQL, **calibration.ORACLE_SQL, **injection.ORACLE_SQL, **rectangles.ORACLE_SQL, **generator.ORACLE_SQL, **samplers.ORACLE_SQL, **audit.ORACLE_SQL, **intervals.ORACLE_SQL, **structured.ORACLE_SQL, **call_matching.ORACLE_SQL, **reference.ORACLE_SQL, **splitting.ORACLE_SQL, **runs.ORACLE_SQL, **data_prep.ORACLE_SQL, **statistics.ORACLE_SQL, **traces.ORACLE_SQL, **records.ORACLE_SQL, **generation.ORACLE_SQL, **classify.ORACLE_SQL, **answers.ORACLE_SQL, **scenes.ORACLE_SQL, **replies.ORACLE_SQL, **run_files.ORACLE_SQL}
