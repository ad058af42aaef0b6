"""Registered queries: an operator on whole tables, and the SQL that says the same."""
