"""From text to syntax tree: lexer, nodes and parser."""

from millrace.plans.parser import parse_script, parse_select, parse_sql

__all__ = ["parse_script", "parse_select", "parse_sql"]
