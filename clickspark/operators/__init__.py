"""Operators: functions from tables to tables, with column names as parameters."""
