"""Whole jobs built from the operators: index runs, tools, configuration, locks."""
