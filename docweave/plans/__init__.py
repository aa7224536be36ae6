"""Whole queries over the tables, by subject, each with SQL to check it by where SQL can express it."""
