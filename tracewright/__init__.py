"""Audit-log correlation on Spark: filter, label, window, cluster and evaluate API audit records."""
