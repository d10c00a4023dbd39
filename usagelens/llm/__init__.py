"""Training-data operators: tokenising, near duplicates, decontamination, sharding, chat, filters.

Nothing outside this folder imports it. Each module holds one operator and its ``opN_*`` query;
``entries.py`` gathers the queries and their SQL.
"""
