"""Adapter views over plain tables and the registered queries with their SQL twins."""
