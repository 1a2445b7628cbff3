"""Outputs of developers' commands as short tables: one parser for each tool, found by hint or by detection."""
