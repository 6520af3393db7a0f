"""Readers that turn provider dumps into record, edge and reject tables, and snapshot writers."""
