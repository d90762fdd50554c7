"""Operators: they take and give DataFrames.

None starts a job but ``columns.attach_source_table``, which looks for hot configurations, and
``ids.allocate_ids``, which stages its rows.
"""
