"""presswork: sector news digests as Spark jobs.

Landed article JSON and raw web pages go in; ranked, enriched, laid-out digest
tables come out.  Everything is a DataFrame transformation; see README.md.
"""
