"""Compositions of operators: test-table mappings, pipelines and registered queries."""
