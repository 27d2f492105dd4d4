"""Registered queries of the lineage library and their oracles."""

from tracelake.jobs import code_jobs, file_jobs, graph_jobs, match_jobs

_ENTRIES = {**match_jobs.ENTRIES, **graph_jobs.ENTRIES, **file_jobs.ENTRIES, **code_jobs.ENTRIES}
QUERIES = {name: run for name, (run, _) in _ENTRIES.items()}
ORACLES = {name: sql for name, (_, sql) in _ENTRIES.items() if sql}
