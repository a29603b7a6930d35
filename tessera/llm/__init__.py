"""Training-data operators: ten corpus operators and the queries over them.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is there.
"""
