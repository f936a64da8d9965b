"""Conversation-memory analytics as PySpark DataFrame operators.

``functions``  column expressions (text, tokens, dates, budgets)
``operators``  DataFrame -> DataFrame operators over many chats at once
``sources``    readers and writers
``streaming``  Structured Streaming versions of the ledger operators
``plans``      named queries over the sample tables, with oracle SQL
"""

__version__ = "0.1.0"
