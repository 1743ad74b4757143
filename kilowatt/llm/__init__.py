"""Training-data operators: thirteen corpus operators and their registered queries.

Nothing outside this folder imports it; the driver entry adds its queries
only when the folder is there.
"""
