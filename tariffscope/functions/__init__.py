"""Expression helpers. Unless noted they take and return SQL expression text.

Text keeps a whole expression in one call to Spark, so building a wide plan
costs little; nothing in here starts a job.
"""
